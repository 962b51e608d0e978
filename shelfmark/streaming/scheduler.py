"""Periodic jobs: a tick as a streaming trigger, and single-flight jobs with their last status."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class Jobs:
    """Named jobs, each run at most once at a time, with what the last run came to."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.status: dict[str, dict[str, Any]] = {}

    def run(self, name: str, task: Callable[[], Any]) -> Any:
        """Run a job; None without running it if it runs already. What it raises is recorded and raised."""
        with self._lock:
            own = self.status.setdefault(name, {"running": False, "started": None, "finished": None, "result": None, "error": None})
            if own["running"]:
                return None
            own |= {"running": True, "started": _now(), "error": None}
        try:
            result = task()
            own["result"] = result if isinstance(result, str) else json.dumps(result, default=str)
            return result
        except Exception as e:
            own["error"] = str(e)
            raise
        finally:
            own |= {"running": False, "finished": _now()}


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def start(spark: SparkSession, jobs: Jobs, due: Callable[[datetime], list[tuple[str, Callable[[], Any]]]], every: str = "60 seconds") -> StreamingQuery:
    """Every tick, run the jobs that are due, one after the other; a failing job doesn't keep the others from running.

    Ticks are micro-batches, which never overlap. ``due`` decides by itself what is due (``operators.telemetry.due_jobs``).
    """

    def tick(_, __) -> None:
        for name, task in due(datetime.now(timezone.utc)):
            try:
                jobs.run(name, task)
            except Exception:
                continue  # its status tells

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick).trigger(processingTime=every).start()
