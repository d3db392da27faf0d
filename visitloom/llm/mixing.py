"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are folded to cells (source, language, topic) with their tokens. The
cells' weights are raked in turn to the target share of each source,
language and topic. A document is kept with a probability in proportion to its cell's
raked weight per token, decided by a hash of its id, so that a rerun keeps
the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shuffles, written

MARGINS = ("source", "lang", "topic")
#: Cells up to this many are sent to all executors; more are joined by a shuffle.
BROADCAST_CELLS = 20_000


def token_weight(text: Column) -> Column:
    """Words of the text and one end token, so that no document weighs nothing."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("bigint")


def topic_of(text: Column, weight: Column) -> Column:
    """The form that a text has, as its topic: short, list (few words a line), long or prose."""
    lines = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\n")) + 1
    return (
        F.when(weight <= 50, "short").when(weight < 12 * lines, "list").when(weight > 1000, "long").otherwise("prose")
    )


def cells_of(docs: DataFrame) -> DataFrame:
    """Cells with their tokens, of rows that have the margins' columns and n_tokens."""
    return docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its present shares to a power, normalised; under 1 flattens."""
    by = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))
    return by.select(margin, (F.col("target") / F.sum("target").over(Window.partitionBy(F.lit(0)))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, tolerance: float = 1e-6, most: int = 120) -> DataFrame:
    """``cells`` with weight: shares that meet the targets, one margin after another.

    ``rounds`` times, then again as often while a margin is off by more than ``tolerance`` of all tokens, at most ``most`` times: margins that
    contradict each other are met as nearly as they can be. A value without a target gets weight 0; targets of values that no cell has are left out and the
    rest scaled up, so weights sum to 1.
    """
    w = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m, t in targets.items():
        present = F.sum(F.col("__t")).over(Window.partitionBy(F.lit(0)))
        t = t.groupBy(m).agg(F.sum("target").alias("__t")).join(cells.select(m).distinct(), m, "left_semi")
        w = w.join(t.select(m, (F.col("__t") / present).alias(f"__{m}")), m, "left").fillna(0.0, [f"__{m}"])
    for k in range(most):
        if k % 3 == 0:  # plans stay small
            w = written(w, "cells")
        if k and k % rounds == 0 and _largest_miss(w, list(targets)) <= tolerance:
            break
        for m in targets:
            total = F.sum("weight").over(Window.partitionBy(m))
            w = w.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"__{m}") / total).otherwise(0.0))
    return w.drop(*[f"__{m}" for m in targets])


def _largest_miss(w: DataFrame, margins: list[str]) -> float:
    """How far the weight of a value of a margin is from its target at most."""
    miss = None
    for m in margins:
        t = w.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"__{m}")).alias("miss")).select("miss")
        miss = t if miss is None else miss.unionByName(t)
    return miss.agg(F.max("miss")).first()[0] or 0.0


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: the first 48 bits of an md5 hash."""
    h = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, doc_id: str = "doc_id",
        text: str = "text", rounds: int = 12, seed: int = 7, topic: Column | None = None) -> DataFrame:
    """``docs`` with topic, n_tokens, probability and kept; one row per input row.

    Targets are given per margin or are the present shares tempered by ``powers``.
    The probability is the raked weight per token over the largest such, so the kept
    tokens meet the raked shares in expectation and the fullest cell is kept whole. ``topic`` is a column of the documents' topics (null counts as the
    empty string); unless given, the form of the text stands in for it. Null sources and
    languages count as the empty string; null and empty texts weigh one token; repeated rows with one id are kept or left
    together. An empty table gives an empty result. Columns with the names of results are replaced.
    """
    own = ("topic", "n_tokens", "probability", "kept")
    carry = [c for c in docs.columns if c not in own]
    given = [] if topic is None else [topic.cast("string").alias("__topic")]
    d = docs.select(*carry, token_weight(F.col(text)).alias("n_tokens"), *given)
    d = d.withColumns({"topic": topic_of(F.col(text), F.col("n_tokens")) if topic is None else F.coalesce(F.col("__topic"), F.lit("")), "__source": F.coalesce("source", F.lit("")), "__lang": F.coalesce("lang", F.lit(""))})
    cells = written(cells_of(d.select(F.col("__source").alias("source"), F.col("__lang").alias("lang"), "topic", "n_tokens")), "cells")
    powers = powers or {"source": 0.7, "lang": 0.8, "topic": 0.9}
    aim = {m: (targets or {}).get(m) for m in MARGINS}
    aim = {m: tempered(cells, m, powers[m]) if t is None else t for m, t in aim.items()}
    rates = written(rake(cells, aim, rounds).select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("rate")), "rates")
    drop_shuffles(cells)
    top = rates.agg(F.max("rate")).first()[0] or 1.0
    rates = rates.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), "topic", (F.col("rate") / top).alias("probability"))
    if rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    return d.join(rates, ["__source", "__lang", "topic"], "left").select(
        *carry, "topic", "n_tokens", F.coalesce("probability", F.lit(0.0)).alias("probability"),
        (uniform(F.col(doc_id), seed) < F.coalesce("probability", F.lit(0.0))).alias("kept"),
    )
