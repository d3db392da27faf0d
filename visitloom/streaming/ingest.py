"""Resumable ingestion: what the log has is skipped, the rest processed, the log appended, the output rebuilt."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import unprocessed
from ..progress import Counts, counted
from ..sources.sinks import log_processed, processed_ids, save_table


class Round(NamedTuple):
    """What a round of ``resume`` met: rows of the source, rows skipped since the log has their id, ids that were new, rows written."""

    rows: int
    skipped: int
    new: int
    written: int


def _marked(source: DataFrame, key: str, done: DataFrame) -> tuple[DataFrame, Counts]:
    """``source`` with ``__done`` where the log has the id, and counts of all rows and of those."""
    ids = done.select(F.col("id").alias("__id"), F.lit(True).alias("__done")).distinct()
    return counted(source.join(ids, F.col(key).cast("string") == F.col("__id"), "left").drop("__id"), skipped=F.count_if(F.col("__done")))


def resume(spark: SparkSession, source: DataFrame, key: str, transform: Callable[[DataFrame], DataFrame], log: str, output: str) -> Round:
    """One round over a batch source. Running it twice gives what running it once gives.

    The counts are gathered by the two jobs that write the log and the output; nothing is read again for them. Rows without an id are met but neither logged nor written.
    """
    done = processed_ids(spark, log)
    todo, new = counted(unprocessed(source, done, key).select(key).where(F.col(key).isNotNull()).distinct())
    log_processed(todo, log)
    # by now the log has every id
    marked, met = _marked(source, key, done)
    out, written = counted(transform(marked.where(F.col(key).isNotNull()).drop("__done")))
    save_table(out, output)
    return Round(*met.or_zero().values(), new.or_zero()["rows"], written.or_zero()["rows"])


def ingest_stream(stream: DataFrame, key: str, transform: Callable[[DataFrame], DataFrame], log: str, output: str, checkpoint: str,
                  report: Callable[[int, Round], None] | None = None):
    """The same for files that keep arriving: each micro-batch writes the rows of ids that the log does not have.

    A batch has a folder of its own, which a batch that runs again overwrites, and is logged last: a crash between the two writes repeats no row.
    ``report`` gets the number of each batch and its counts, gathered by the jobs that write.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        marked, met = _marked(df, key, processed_ids(df.sparkSession, log))
        fresh = marked.where(F.col("__done").isNull() & F.col(key).isNotNull()).drop("__done")
        out, written = counted(transform(fresh))
        out.write.mode("overwrite").parquet(f"{output}/epoch={epoch}")
        seen = met.get() or {"rows": df.count(), "skipped": marked.where("__done").count()}
        ids, new = counted(fresh.select(key).distinct())
        log_processed(ids, log)
        if report:
            report(epoch, Round(seen["rows"], seen["skipped"], new.or_zero()["rows"], written.or_zero()["rows"]))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
