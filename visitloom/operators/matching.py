"""Document frequencies and greedy one-to-one matching of predicted and actual terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema


def idf_registry(terms: DataFrame, patients: DataFrame, smooth: bool = False) -> DataFrame:
    """term, df, idf = ln(N / (df + 1)), with N all patients, also those without terms. ``smooth`` adds one to N: never negative."""
    df = terms.select("patient_id", "term").where("term <> ''").distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = patients.agg(F.countDistinct("patient_id").alias("n"))
    return df.join(F.broadcast(n)).select("term", "df", F.log((F.col("n") + (1 if smooth else 0)) / (F.col("df") + 1.0)).alias("idf"))


def candidates(actual: DataFrame, predicted: DataFrame, library: DataFrame, idf: DataFrame, vec: str = "vec", epsilon: float = 1e-8) -> DataFrame:
    """patient_id, category, ai, pi, similarity, weights of every actual and predicted term of a patient and category.

    ai ranks actual terms by idf, highest first, then position; terms without a vector are left out, without an idf count 1.
    """
    from pyspark.sql import Window

    from ..functions import vectors as V

    lib = library.select("category", "term", V.doubles(F.col(vec)).alias("v")).withColumn("v", V.unit(F.col("v"), epsilon))
    reg = idf.select("term", "idf")
    a = actual.join(lib, ["category", "term"]).join(reg, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    p = predicted.join(lib, ["category", "term"]).join(reg, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    key = Window.partitionBy("patient_id", "category")
    a = a.select("patient_id", "category", "pos", F.col("term").alias("actual_term"), F.col("v").alias("av"), F.col("idf").alias("actual_idf"),
                 F.row_number().over(key.orderBy(F.desc("idf"), "pos")).alias("ai"))
    p = p.select("patient_id", "category", F.col("pos").alias("pi"), F.col("term").alias("predicted_term"), F.col("v").alias("pv"), F.col("idf").alias("predicted_idf"))
    both = a.join(p, ["patient_id", "category"]).withColumn("similarity", V.dot(F.col("av"), F.col("pv")))
    product = F.col("actual_idf") * F.col("predicted_idf")
    # a negative product has no root; such a pair never matches
    weight = F.when(product >= 0, F.greatest(F.col("similarity"), F.lit(0.0)) * F.sqrt(F.greatest(product, F.lit(0.0)))).otherwise(0.0)
    return both.withColumn("weight", weight).drop("av", "pv")


def greedy(cands: DataFrame, order: str = "ai") -> DataFrame:
    """patient_id, category, actual_term, predicted_term, similarity, idfs, weighted_score of the matched pairs.

    Actual terms choose in ``order``; each takes the unused predicted term of the largest positive weight, on ties the first.
    """
    info = ["actual_term", "predicted_term", "similarity", "actual_idf", "predicted_idf"]
    own = cands.where(F.col("weight") > 0).groupBy("patient_id", "category", F.col(order).alias("o")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("nw"), "pi", *info))).alias("options"))
    lists = own.groupBy("patient_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "options"))), lambda x: x["options"]).alias("turns"))
    kind = lists.schema["turns"].dataType.elementType.simpleString()

    def step(acc, options):
        free = F.filter(options, lambda z: ~F.exists(acc, lambda m: m["pi"] == z["pi"]))
        return F.concat(acc, F.slice(free, 1, 1))

    matched = lists.select("patient_id", "category", F.explode(F.aggregate("turns", F.array().cast(kind), step)).alias("m"))
    return matched.select("patient_id", "category", *[f"m.{c}" for c in info], (-F.col("m.nw")).alias("weighted_score"))


def scores(matches: DataFrame, patients: DataFrame) -> DataFrame:
    """patient_id, one score per category, overall: categories without a match score 0 and count in the mean."""
    grid = patients.select("patient_id").distinct().crossJoin(F.broadcast(patients.sparkSession.createDataFrame([(c,) for c in schema.CATEGORIES], "category string")))
    total = matches.groupBy("patient_id", "category").agg(F.sum("weighted_score").alias("score"))
    full = grid.join(total, ["patient_id", "category"], "left").fillna(0.0, ["score"])
    per = [F.sum(F.when(F.col("category") == c, F.col("score"))).alias(c) for c in schema.CATEGORIES]
    return full.groupBy("patient_id").agg(*per, F.avg("score").alias("overall"))
