"""Samples that a rerun repeats: rows are ranked by a hash of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, all if there are fewer."""
    return df.orderBy(ticket(F.col(key), seed), key).limit(n)


#: Samples of tasks that one task merges.
FAN_IN = 32


def bottom_k(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` distinct keys of least ticket, in one column: the sample of ``sample_n`` over a population that repeats keys and is too large to sort or to gather.

    Each task keeps its ``n`` least tickets and hands on no more; samples are merged ``FAN_IN`` at a time, so no task meets more than that many. A repeated key
    has one ticket and counts once. Null keys take no part; all keys if there are fewer.
    """
    kind = df.schema[key].dataType.simpleString()

    def least(tables):
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = None
        for t in tables:
            t = pa.table(t) if kept is None else pa.concat_tables([kept, t])
            t = t.group_by(["ticket", "k"]).aggregate([("grp", "min")]).rename_columns(["ticket", "k", "grp"])
            kept = t.take(pc.select_k_unstable(t, n, [("ticket", "ascending"), ("k", "ascending")])) if t.num_rows > n else t
        return kept

    def of_task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kept = least(pa.table({"ticket": b.column(0), "k": b.column(1), "grp": pa.array([0] * b.num_rows, pa.int64())}) for b in batches)
        if kept is not None:
            grp = pa.array([TaskContext.get().partitionId() // FAN_IN] * kept.num_rows, pa.int64())
            yield from kept.set_column(2, "grp", grp).to_batches()

    def merged(t):
        import pyarrow as pa

        grp = t["grp"][0].as_py() // FAN_IN
        kept = least([t.select(["ticket", "k", "grp"])])
        return kept.set_column(2, "grp", pa.array([grp] * kept.num_rows, pa.int64()))

    shape = f"ticket string, k {kind}, grp long"
    out = df.where(F.col(key).isNotNull()).select(ticket(F.col(key), seed).alias("ticket"), F.col(key).alias("k")).mapInArrow(of_task, shape)
    # three turns hold for 32 768 tasks with groups of at most FAN_IN samples, the sort below merges what is left of more
    for _ in range(3):
        out = out.groupBy("grp").applyInArrow(merged, shape)
    return out.select("ticket", "k").distinct().orderBy("ticket", "k").limit(n).select(F.col("k").alias(key))


def sample_per_group(df: DataFrame, group: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(ticket(F.col(key), seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def similar_pairs(buckets: DataFrame, per_bucket: int = 10, cap: int = 5, seed: int = 42) -> DataFrame:
    """chapter, term, counterpart: up to ``cap`` pairs of up to ``per_bucket`` members of each chapter."""
    s = sample_per_group(buckets.select("chapter", "patient_id").distinct(), ["chapter"], "patient_id", per_bucket, seed)
    p = s.alias("a").join(s.alias("b"), "chapter").where("a.patient_id < b.patient_id").select(
        "chapter", F.col("a.patient_id").alias("patient_1"), F.col("b.patient_id").alias("patient_2"))
    w = Window.partitionBy("chapter").orderBy(ticket(F.concat_ws("-", "patient_1", "patient_2"), seed), "patient_1", "patient_2")
    return p.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def dissimilar_pairs(buckets: DataFrame, n: int = 50, per_bucket: int = 10, seed: int = 42) -> DataFrame:
    """patient_1, patient_2: up to ``n`` pairs from different chapters, never of a patient with itself."""
    s = sample_per_group(buckets.select("chapter", "patient_id").distinct(), ["chapter"], "patient_id", per_bucket, seed)
    p = s.alias("a").join(s.alias("b"), F.col("a.chapter") < F.col("b.chapter")).where("a.patient_id <> b.patient_id")
    p = p.select(F.least("a.patient_id", "b.patient_id").alias("patient_1"), F.greatest("a.patient_id", "b.patient_id").alias("patient_2")).distinct()
    return p.orderBy(ticket(F.concat_ws("-", "patient_1", "patient_2"), seed), "patient_1", "patient_2").limit(n)
