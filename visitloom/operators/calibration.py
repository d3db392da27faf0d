"""Pairs of patients judged by a model and by their vectors: the table of all metrics, and the check of both on pairs whose answer is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import models, neighbors, pairs, sampling


def scored_pairs(of: DataFrame, narratives: DataFrame, a: str, b: str, make=models.StubLLM, tries: int = 5, in_flight: int = 1) -> DataFrame:
    """``of`` with llm_relevance_score of the narratives (key, narrative) of both ends; pairs with an end that has none go.

    A narrative is written once a key, not once a pair, and equal questions are asked once.
    """
    key = narratives.columns[0]
    side = lambda end, name: narratives.select(F.col(key).alias(end), F.col("narrative").alias(name))
    both = of.join(side(a, "__one"), a).join(side(b, "__two"), b)
    return models.relevance(both, "__one", "__two", make, tries, in_flight).drop("__one", "__two")


def pair_metrics(vectors: DataFrame, narratives: DataFrame, key: str, vec: str, make=models.StubLLM, in_flight: int = 1) -> DataFrame:
    """cosine_similarity, euclidean_distance and llm_relevance_score of each unordered pair, the lesser key first; only keys with a vector and a narrative."""
    known = vectors.join(narratives.select(F.col(narratives.columns[0]).alias(key)), key, "left_semi")
    return scored_pairs(neighbors.pairwise_metrics(known, key, vec), narratives, f"{key}_1", f"{key}_2", make, in_flight=in_flight)


def known_pairs(buckets: DataFrame, per_bucket: int = 10, cap: int = 5, n: int = 50, seed: int = 42) -> DataFrame:
    """pair_type, patient_1, patient_2: pairs from one chapter are ``similar``, from different chapters ``dissimilar``; a pair of several chapters counts once."""
    alike = sampling.similar_pairs(buckets, per_bucket, cap, seed).select(F.lit("similar").alias("pair_type"), "patient_1", "patient_2").distinct()
    return alike.unionByName(sampling.dissimilar_pairs(buckets, n, per_bucket, seed).select(F.lit("dissimilar").alias("pair_type"), "patient_1", "patient_2"))


def calibrate(buckets: DataFrame, vectors: DataFrame, narratives: DataFrame, make=models.StubLLM, per_bucket: int = 10, cap: int = 5, n: int = 50, seed: int = 42, in_flight: int = 1) -> DataFrame:
    """pair_type, patient_1, patient_2, llm_relevance_score, cosine_similarity of ``known_pairs``.

    ``vectors`` are (patient_id, vec), ``narratives`` (patient_id, narrative); patients that lack either are left out. A good judge scores similar pairs above dissimilar ones.
    """
    asked = scored_pairs(known_pairs(buckets, per_bucket, cap, n, seed), narratives, "patient_1", "patient_2", make, in_flight=in_flight)
    both = pairs.with_vectors(asked, vectors, "patient_id", "vec", "patient_1", "patient_2")
    cos = V.cosine(V.doubles(F.col("vec_1")), V.doubles(F.col("vec_2")))
    return both.select("pair_type", "patient_1", "patient_2", "llm_relevance_score", cos.alias("cosine_similarity"))
