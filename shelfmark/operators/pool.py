"""Work on rows by a bounded number of tasks, with results in the rows' order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_map(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, tasks: int, order: str) -> DataFrame:
    """What ``work`` makes of rows, by at most ``tasks`` tasks at a time, in order of a column that it passes on."""
    return rows.repartition(tasks).mapInArrow(work, schema).orderBy(order)
