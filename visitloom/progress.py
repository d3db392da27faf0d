"""Counts and progress of running jobs: metrics are gathered by the job that does the work, never by a second one."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counts:
    """Metrics of the first action over an observed table."""

    def __init__(self, names: list[str]):
        self.names, self.observation = names, Observation()

    def get(self) -> dict[str, int] | None:
        """The metrics; None if the plan was found empty before it ran and what observes it was left out."""
        try:
            return self.observation.get
        except Py4JJavaError as e:
            if "AssertionError" not in str(e.java_exception):
                raise
            return None

    def or_zero(self) -> dict[str, int]:
        return self.get() or dict.fromkeys(self.names, 0)


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Counts]:
    """``df`` and counts that have ``rows`` and the given aggregates once an action over ``df`` has ended."""
    seen = Counts(["rows", *metrics])
    return df.observe(seen.observation, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]), seen


@dataclass(frozen=True)
class Tasks:
    """Tasks that are done, running and known so far, over the stages of the jobs that run."""

    done: int
    running: int
    total: int


class Progress:
    """Calls ``report`` with ``Tasks`` every ``seconds`` while the block lasts, and once at its end, over the jobs of the application that ran meanwhile.

    Stages that have ended are kept at their full count, so tasks that are done never go back.
    """

    def __init__(self, spark: SparkSession, report: Callable[[Tasks], None], seconds: float = 1.0):
        self.spark, self.report, self.seconds = spark, report, seconds
        self._stages: dict[int, tuple[int, int, int]] = {}
        self._over = threading.Event()

    def look(self) -> Tasks:
        sc = self.spark.sparkContext
        tracker = sc.statusTracker()
        ids = {s for j in tracker.getActiveJobsIds() if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        for s in ids | self._stages.keys():
            info = tracker.getStageInfo(s)
            if info:
                self._stages[s] = (max(info.numCompletedTasks, self._stages.get(s, (0,))[0]), info.numActiveTasks, info.numTasks)
            elif s in self._stages:
                self._stages[s] = (self._stages[s][2], 0, self._stages[s][2])
        return Tasks(*[sum(x) for x in zip(*self._stages.values())] or (0, 0, 0))

    def _watch(self) -> None:
        while not self._over.wait(self.seconds):
            self.report(self.look())

    def __enter__(self) -> "Progress":
        self._thread = InheritableThread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *error) -> None:
        self._over.set()
        self._thread.join()
        self.report(self.look())
