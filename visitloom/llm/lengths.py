"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are folded to (length, documents) in each task, so what is shuffled is
bounded by the distinct lengths. Suffix sums are taken in two levels: blocks of
neighbouring lengths, then lengths within a block, so no task sorts all lengths.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import prepare_workers, written

#: Lengths in a block of the two-level suffix sums.
BLOCK = 1024


def histogram(docs: DataFrame, text: str = "text", paths: tuple[str, str | None] | None = None) -> DataFrame:
    """(n_tokens, docs): how many texts have each encoded length, without an end id; a null or empty text has length 0."""
    prepare_workers(docs.sparkSession)
    json_path, ranks = paths or tokens.default_paths()

    def count(batches):
        import pyarrow as pa

        encode, seen = tokens.encoder(json_path, ranks), Counter()
        for b in batches:
            seen.update(len(encode(t.as_py())) for t in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "docs"])

    one = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long, docs long")
    return one.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def summarise(hist: DataFrame) -> DataFrame:
    """One row per length with suffix sums, so that every context limit can be answered from one row.

    docs_at_least, tokens_at_least: documents of this length or more and their
    tokens. truncated_total: tokens that are left when each document is cut at this
    length. quantile: share of documents of this length or less. Rows of equal length are added up first;
    rows with a null length or count are ignored; no rows give no rows.
    """
    h = hist.where("n_tokens IS NOT NULL AND docs IS NOT NULL").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))
    h = written(h, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))  # it is read twice, and costs much to make
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum(F.col("docs") * F.col("n_tokens")).alias("bt"))
    over, later = Window.orderBy(F.desc("block")), Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    above = over.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("t0"),
        F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"),
    )
    h = h.join(blocks, "block").select(
        "n_tokens", "docs", "all_docs", "all_tokens",
        (F.sum("docs").over(later) + F.col("d0")).alias("docs_at_least"),
        (F.sum(F.col("docs") * F.col("n_tokens")).over(later) + F.col("t0")).alias("tokens_at_least"),
    )
    return h.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(summary: DataFrame, limit: int) -> int:
    """Tokens left when each document is cut at ``limit``, for any limit; 0 for no documents."""
    row = summary.where(F.col("n_tokens") >= limit).orderBy("n_tokens").first()
    if row is None:
        row = summary.orderBy(F.desc("n_tokens")).first()
        return row["truncated_total"] if row else 0
    # all shorter documents are whole: what this row has from them, and the limit from the rest
    return row["truncated_total"] - row["docs_at_least"] * (row["n_tokens"] - limit)


def length_at(summary: DataFrame, share: float) -> int | None:
    """The least length that ``share`` of the documents do not exceed; None for no documents."""
    row = summary.where(F.col("quantile") >= share).orderBy("n_tokens").first()
    return row["n_tokens"] if row else None
