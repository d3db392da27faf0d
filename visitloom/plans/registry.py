"""Named queries over the driver's tables and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import visits
from ..sources import adapters
from . import history, judging, termsets

_PLANS = (history, termsets, judging)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patient's last history window, as the sentence of each of its visits."""
    w = visits.windows(adapters.sentences(spark, sf_dir), F.col("sentence"), history.N)
    last = w.groupBy("patient_id").agg(F.max_by("window", "end_idx").alias("window"), F.max("end_idx").alias("end_idx"))
    return last.select("patient_id", "end_idx", F.array_join("window", " | ").alias("history"))


def queries() -> dict:
    return {k: f for p in _PLANS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PLANS for k, s in p.SQL.items()}
