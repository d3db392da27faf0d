"""Sinks: tables, exports and the log of processed ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import exists


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """The canonical form; overwriting makes a rerun harmless."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """JSON lines; ``partition_by`` gives a folder for each model and category, say."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def export_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("category", "model")) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed by a join key, so later joins on it need no shuffle: in place of an index."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def processed_ids(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.schema("id string").parquet(path)


def log_processed(ids: DataFrame, path: str) -> None:
    ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct().write.mode("append").parquet(path)


def export_vectors_text(df: DataFrame, path: str) -> None:
    """``word v1 .. vd`` lines."""
    df.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)
