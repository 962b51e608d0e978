"""The fetch log: statistics, the adaptive limiter as a fold, early stops, due jobs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MIN_MS, MAX_MS, COOLDOWN_MS, PATIENCE = 5000, 120_000, 600_000, 3


def fetch_stats(log: DataFrame, by: list[str]) -> DataFrame:
    """Requests, successes, challenges, failures and milliseconds by the given columns."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("successes"), F.count_if("challenge").alias("challenges"), F.count_if(~F.col("ok") & ~F.col("challenge")).alias("failures"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))


STATE = "interval_ms long, in_row long, cooldown_until long, requests long, challenges long"
START = (MIN_MS, 0, None, 0, 0)


def limiter_step(state: tuple, kind: str, at_ms: int) -> tuple:
    """The limiter's state after an event of kind success, challenge or failure.

    State: interval_ms, in_row (consecutive challenges), cooldown_until, requests, challenges. A
    cool-down that has run out by the event's time is over, and challenges count anew.
    """
    interval, in_row, until, requests, challenges = state
    if until is not None and at_ms >= until:
        in_row, until = 0, None
    if kind == "success":
        interval, in_row, until = (max(MIN_MS, int(interval * 0.8 + 0.5)) if interval > MIN_MS else interval), 0, None
    elif kind == "challenge":
        interval, in_row, challenges = min(MAX_MS, max(1000, interval * 2)), in_row + 1, challenges + 1
        if in_row >= PATIENCE:
            until = at_ms + COOLDOWN_MS
    else:
        interval = min(MAX_MS, int(interval * 1.5 + 0.5))
    return interval, in_row, until, requests + 1, challenges


class Chunk:
    """What a run of one key's events does to the limiter's state, whatever the state before.

    The interval before can be any of ``starts`` (sorted); it becomes the value at the last start that isn't above it, as every
    event's effect is monotone. For the challenges in a row there are four states before: none, one, two, or a cool-down with an end that isn't known here; after a
    success all are one. A chunk whose state before is known has that as its only start.
    """

    def __init__(self, starts: np.ndarray, whole: bool) -> None:
        self.starts, self.values, self.whole = starts, starts, whole
        # in a row (in a cool-down: how many more), end of the cool-down, and whether this is the unknown cool-down
        self.rows = [[0, None, False]] if whole else [[0, None, False], [1, None, False], [2, None, False], [0, None, True]]
        self.which = [0] if whole else [0, 1, 2, 3]
        self.first_mark = self.last_at = None
        self.requests = self.challenges = 0

    def _interval(self, step, times: int) -> None:
        for _ in range(times):
            values = step(self.values)
            if (values == self.values).all():
                return
            kept = np.append(True, values[1:] != values[:-1])
            self.values, self.starts = values[kept], self.starts[kept]

    def _meet(self) -> None:
        """States that became one are followed once."""
        seen: list = []
        for k, w in enumerate(self.which):
            row = self.rows[w]
            self.which[k] = next((j for j, x in enumerate(seen) if x == row), len(seen))
            if self.which[k] == len(seen):
                seen.append(row)
        self.rows = seen

    def run(self, kind: int, at: np.ndarray) -> None:
        """Events of one kind in a row (0 success, 1 challenge, 2 failure), in order of time."""
        n = len(at)
        self.requests += n
        if kind != 2 and self.first_mark is None:
            self.first_mark = int(at[0])
        if kind == 0:
            self._interval(lambda x: np.where(x > MIN_MS, np.maximum(MIN_MS, (x * 0.8 + 0.5).astype(np.int64)), x), n)
            self.rows, self.which = [[0, None, False]], [0] * len(self.which)
        elif kind == 1:
            self.challenges += n
            self._interval(lambda x: np.minimum(MAX_MS, np.maximum(1000, x * 2)), n)
            for t in at.tolist():
                for row in self.rows:
                    if row[1] is not None and t >= row[1]:
                        row[:] = [0, None, False]
                    row[0] += 1
                    if row[2] or row[0] >= PATIENCE:
                        row[1] = t + COOLDOWN_MS
            self._meet()
        else:
            self._interval(lambda x: np.minimum(MAX_MS, (x * 1.5 + 0.5).astype(np.int64)), n)
            for row in self.rows:
                if row[1] is not None and at[-1] >= row[1]:
                    row[:] = [0, None, False]
        self.last_at = int(at[-1])

    def told(self) -> dict:
        ends = [self.rows[w] for w in self.which]
        return {
            "whole": self.whole, "starts": self.starts.tolist(), "ends": self.values.tolist(), "in_rows": [r[0] for r in ends], "untils": [r[1] for r in ends], "open": [r[2] for r in ends],
            "first_mark": self.first_mark, "last_at": self.last_at, "n": self.requests, "n_challenges": self.challenges,
        }


CHUNK = "whole boolean, starts array<long>, ends array<long>, in_rows array<long>, untils array<long>, open array<boolean>, first_mark long, last_at long, n long, n_challenges long"


def after_chunk(state: tuple, chunk: dict) -> tuple:
    """The limiter's state after a chunk, from the state before it."""
    interval, in_row, until, requests, challenges = state
    ends = chunk["ends"][bisect_right(chunk["starts"], interval) - 1]
    k = in_row
    if until is not None:
        # Until the first event that isn't a failure nothing but time can end a cool-down.
        over = chunk["first_mark"] if chunk["first_mark"] is not None else chunk["last_at"]
        k = 0 if over >= until else 3
    k = min(k, len(chunk["in_rows"]) - 1)
    end_row, end_until = chunk["in_rows"][k], chunk["untils"][k]
    if chunk["open"][k]:
        end_row, end_until = in_row + end_row, until if end_until is None else end_until
    return ends, end_row, end_until, requests + chunk["n"], challenges + chunk["n_challenges"]


def _streamed(batches: Iterator[pa.RecordBatch], key: str, add: Callable, told: Callable, fields: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Fold sorted rows key by key, holding one key's state: ``add`` takes the state (None at first), whether the key is the task's first, and a piece of its rows."""
    own, state, first, begun = None, None, True, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, done = batch.column(batch.schema.get_field_index(key)), []
        text = keys.dictionary_encode()
        codes = np.asarray(text.indices.fill_null(-1))
        cuts = [0, *(np.nonzero(codes[1:] != codes[:-1])[0] + 1).tolist(), len(codes)]
        columns = {f: batch.column(batch.schema.get_field_index(f)) for f in fields}
        for a, b in zip(cuts, cuts[1:], strict=False):
            value = keys[a].as_py()
            if begun and value != own:
                done.append({key: own} | told(state))
                state, first = None, False
            own, begun = value, True
            state = add(state, first, {f: c.slice(a, b - a) for f, c in columns.items()})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if begun:
        yield pa.RecordBatch.from_pylist([{key: own} | told(state)], schema=schema)


KINDS = ("success", "challenge", "failure")
_LISTS = [("whole", pa.bool_()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("in_rows", pa.list_(pa.int64())), ("untils", pa.list_(pa.int64())), ("open", pa.list_(pa.bool_())), *[(x, pa.int64()) for x in ("first_mark", "last_at", "n", "n_challenges")]]


def limiter_chunks(events: DataFrame, key: str, by: str = "at_ms") -> DataFrame:
    """(key, first_at, first_id, CHUNK): what each chunk of a key's events, sorted by time (``by``) and id, does to the limiter's state.

    Chunks are cut by ranges of (key, time, id), so a key of very many events lies in many tasks. A task's first key may have begun
    in the task before, so it is followed from every start; all others from the known one.
    """
    key_type = pa.field(key, to_arrow_type(events.schema[key].dataType))
    schema = pa.schema([key_type, ("first_at", pa.int64()), ("first_id", pa.int64()), *_LISTS])

    def add(state, first, columns):
        at, ids = np.asarray(columns["at_ms"]), columns["id"]
        kinds = np.asarray(columns["code"])
        if state is None:
            starts = np.arange(MIN_MS, MAX_MS + 1) if first else np.array([MIN_MS])
            state = (columns["by"][0].as_py(), ids[0].as_py(), Chunk(starts, not first))
        cuts = [0, *(np.nonzero(kinds[1:] != kinds[:-1])[0] + 1).tolist(), len(kinds)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            state[2].run(int(kinds[a]), at[a:b])
        return state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, key, add, lambda s: {"first_at": s[0], "first_id": s[1], **s[2].told()}, ["at_ms", "by", "id", "code"], schema)

    code = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1).otherwise(2)
    thin = events.select(key, F.col("at_ms").cast("long").alias("at_ms"), F.col(by).cast("long").alias("by"), F.col("id").cast("long").alias("id"), code.alias("code"))
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = thin.repartitionByRange(tasks, key, "by", "id").sortWithinPartitions(key, "by", "id")
    return placed.mapInArrow(run, f"{key} {events.schema[key].dataType.simpleString()}, first_at long, first_id long, {CHUNK}")


def limiter_fold(events: DataFrame, key: str, by: str = "at_ms") -> DataFrame:
    """The limiter's state per key after its events (id, kind, at_ms) in order of time and id; ``by`` is a finer time than milliseconds, if there is one.

    The state depends on every event before, yet a key isn't bound to a task: chunks are folded side by side (``limiter_chunks``), and the
    few that a key has are put together in order. Events have a time and an id; a null key is a key.
    """
    key_type = pa.field(key, to_arrow_type(events.schema[key].dataType))
    names = [f.split()[0] for f in STATE.split(", ")]
    schema = pa.schema([key_type, *[(n, pa.int64()) for n in names]])

    def add(state, first, columns):
        for chunk in pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).to_pylist():
            state = after_chunk(START if state is None else state, chunk)
        return state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, key, add, lambda s: dict(zip(names, s, strict=True)), [n for n, _ in _LISTS], schema)

    chunks = limiter_chunks(events, key, by)
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = chunks.repartition(tasks, key).sortWithinPartitions(key, "first_at", "first_id")
    return together.mapInArrow(run, f"{key} {events.schema[key].dataType.simpleString()}, {STATE}")


def paced(requests: DataFrame, key: str, interval_ms: int = MIN_MS) -> DataFrame:
    """When each request (id, at_ms) of a key may go: no sooner than asked, and an interval after the one before."""
    order = Window.partitionBy(key).orderBy("at_ms", "id")
    n = F.row_number().over(order)
    # the k-th one waits for the latest of all earlier ones and the intervals between
    return requests.withColumn("n", n).withColumn("go_ms", F.max(F.col("at_ms") - F.col("n") * interval_ms).over(order) + F.col("n") * interval_ms).drop("n")


def probe_blocked(log: DataFrame, key: str, window_ms: int = 30 * 60_000) -> DataFrame:
    """``log`` with blocked_until, the end of the window that the last challenge before opened, and whether it still holds."""
    before = Window.partitionBy(key).orderBy("at_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.when(F.col("kind") == "challenge", F.col("at_ms") + window_ms)).over(before)
    return log.withColumn("blocked_until", until).withColumn("blocked", F.coalesce(F.col("at_ms") < F.col("blocked_until"), F.lit(False)))


def recent(log: DataFrame, n: int, by: str = "id") -> DataFrame:
    """The last n entries of a log, the oldest of them first."""
    return log.orderBy(F.col(by).desc()).limit(n).orderBy(by)


def early_stop(attempts: DataFrame, batch: str, order: str, failures: int = 3) -> DataFrame:
    """(batch, attempted, ok, failed, stopped_early): a batch ends when it has ``failures`` and no success.

    ``attempts`` has a boolean ok. Attempts after the end aren't made.
    """
    upto = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = (F.coalesce(F.sum((~F.col("ok")).cast("int")).over(before), F.lit(0)) >= failures) & (F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0)) == 0)
    ends = (F.sum((~F.col("ok")).cast("int")).over(upto) >= failures) & (F.sum(F.col("ok").cast("int")).over(upto) == 0)
    made = attempts.withColumn("over", done).withColumn("ends", ends).filter(~F.col("over"))
    return made.groupBy(batch).agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.bool_or("ends").alias("stopped_early"))


def due_jobs(jobs: DataFrame, last_runs: DataFrame, as_of: Column) -> DataFrame:
    """(job, minutes_since, due): jobs with an interval that have waited it out or never ran."""
    waited = F.timestamp_diff("MINUTE", F.col("ran_at"), as_of)
    return jobs.join(last_runs, "job", "left").select("job", waited.alias("minutes_since"), ((F.col("every_minutes") > 0) & (F.col("ran_at").isNull() | (waited >= F.col("every_minutes")))).alias("due"))


def retry_delay_ms(remaining_ms: Column) -> Column:
    """A second past the cool-down, at least five seconds and at most a quarter of an hour."""
    return F.least(F.greatest(remaining_ms + 1000, F.lit(5000)), F.lit(900_000))


def sync_counters(outcomes: DataFrame) -> DataFrame:
    """One row of a sync: matched, written, unchanged and errors. What the errors say: ``sync_errors``."""
    return outcomes.agg(F.count_if(F.col("via") != "none").alias("matched"), F.count_if("written").alias("written"), F.count_if(~F.col("written") & F.col("error").isNull() & (F.col("via") != "none")).alias("unchanged"), F.count("error").alias("errors"))


def sync_errors(outcomes: DataFrame) -> DataFrame:
    """(error, n): the messages of a sync, a row each."""
    return outcomes.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))
