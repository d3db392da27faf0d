"""Stages: skip what is done, fail fast on what is missing, run what does not depend on each other at once."""

from __future__ import annotations

import contextlib
import graphlib
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from .config import RunConfig


class MissingInput(FileNotFoundError):
    pass


class ServiceDown(ConnectionError):
    pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store its scheme names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Stage:
    """``fn(spark, config, *inputs)`` gives the table that is kept at ``output``.

    ``inputs`` are paths of tables: outputs of other stages, or tables that must be there. ``services`` are URLs that must answer, within ``patience`` seconds,
    before any task is started that would call them.
    """

    name: str
    output: str
    fn: Callable[..., DataFrame]
    inputs: tuple[str, ...] = field(default=())
    services: tuple[str, ...] = field(default=())
    patience: float = 60.0

    def run(self, spark: SparkSession, config: RunConfig) -> str:
        done, mark = f"{self.output}/_SUCCESS", f"{self.output}.config"
        if exists(spark, done) and exists(spark, mark) and spark.read.text(mark, wholetext=True).first()[0].strip() == config.fingerprint():
            return "skipped"
        for path in self.inputs:
            if not exists(spark, path):
                raise MissingInput(f"{self.name} needs {path}")
        for url in self.services:
            from .operators.clients import healthy

            if not healthy(url, self.patience):
                raise ServiceDown(f"{self.name} needs {url}")
        self.fn(spark, config, *[spark.read.parquet(p) for p in self.inputs]).write.mode("overwrite").parquet(self.output)
        spark.range(1).selectExpr("'" + config.fingerprint().replace("'", "\\'") + "' AS value").coalesce(1).write.mode("overwrite").text(mark)
        return "ran"


def run_stages(spark: SparkSession, config: RunConfig, stages: Iterable[Stage], tag: str = "visitloom") -> dict[str, str]:
    """Stages in order, under a job tag by which ``cancel`` finds them."""
    with tagged(spark, tag):
        return {s.name: s.run(spark, config) for s in stages}


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs that this thread starts in the block are under a tag of the application, which any thread can cancel."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str = "visitloom") -> None:
    """Ends all running jobs of a tag; their stages fail and those that wait for them are blocked."""
    spark.sparkContext.cancelJobsWithTag(tag)


def order_of(stages: Iterable[Stage]) -> dict[str, set[str]]:
    """The names of the stages that each stage waits for: those whose output it reads. Two stages may share neither a name nor an output."""
    stages = list(stages)
    by_output = {s.output: s.name for s in stages}
    if len(by_output) < len(stages) or len({s.name for s in stages}) < len(stages):
        raise ValueError("two stages share a name or an output")
    return {s.name: {by_output[p] for p in s.inputs if p in by_output} for s in stages}


def run_graph(spark: SparkSession, config: RunConfig, stages: Iterable[Stage], at_once: int = 4, tag: str = "visitloom", report: Callable[[str, str], None] | None = None) -> dict[str, str]:
    """What became of each stage: ``ran``, ``skipped``, ``failed: why`` or ``blocked by`` the stages that it waited for in vain.

    A stage starts as soon as those whose outputs it reads have ended, up to ``at_once`` of them at the same time. One that fails takes along what depends on it and
    nothing else. All jobs are under a tag, by which ``cancel`` ends them. ``report`` gets the name and the state of each stage as it ends. A circle of stages is an error before
    anything runs.
    """
    named = {s.name: s for s in stages}
    before = order_of(named.values())
    graph = graphlib.TopologicalSorter(before)
    graph.prepare()
    out: dict[str, str] = {}

    def run(stage: Stage) -> str:
        try:
            with tagged(spark, tag):
                return stage.run(spark, config)
        except Exception as e:
            return f"failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]

    def end(name: str, state: str) -> None:
        out[name] = state
        if report:
            report(name, state)
        graph.done(name)

    with ThreadPoolExecutor(at_once) as pool:
        running: dict = {}
        while graph.is_active():
            for name in graph.get_ready():
                lost = sorted(b for b in before[name] if out[b] not in ("ran", "skipped"))
                if lost:
                    end(name, f"blocked by {', '.join(lost)}")
                else:
                    running[pool.submit(inheritable_thread_target(spark)(run), named[name])] = name
            if running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    end(running.pop(f), f.result())
    return out
