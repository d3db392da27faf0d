"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote. The first four return the columns of
``documents``; the last returns the packed pieces. What a stage decides takes effect:
rejected, emptied, repeated and unsampled documents are gone from the next one on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm import lines, minhash, mixing, packing, quality
from visitloom.llm.common import table, written


#: Columns that stages read; all others are carried through under names that no operator uses.
READ = ("doc_id", "text", "lang", "source")


def _through(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``judge`` leaves, with the columns of ``docs`` as they were, whatever their names."""
    inner = {c: c if c in READ else f"__in{i}" for i, c in enumerate(docs.columns)}
    out = judge(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the base limits and are no outliers of their language and source.

    Null, empty and blank texts fail the base limits and go. Texts are read whole, however long. Rows that repeat are judged alike and all
    stay or all go. Null languages and sources are a group of their own; a null doc_id is no reason to go. Extra columns
    pass through, those with names of the operator's results too. An empty table gives an empty one.
    """
    return _through(docs, lambda d: quality.judge(d).where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; n_chars is that of the new text.

    A document of which only blanks are left goes; its lines are all elsewhere. Null and empty texts have no lines and stay. Lines of any
    length are compared. Rows that repeat a doc_id are one document: their common lines stay in each. Rows with a null
    doc_id keep what no other document has. Extra columns pass through; an empty table gives an empty one.
    """
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    out = _through(docs, lambda d: lines.dedup_lines(d, exact_words=1).where(~emptied | F.col("text").isNull()))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, one without an id only if none has one.

    Rows are told apart by id and text, so other texts under a repeated id stay; of rows that repeat both one stays. Null, empty and blank
    texts are like no other and stay. Texts are read whole. Extra columns pass through; an empty table gives an empty one.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), hashed.alias("hash"))
    found = minhash.near_duplicates(docs.select(key.alias("__key"), "text"), width=2, doc_id="__key")
    rows = found.groupBy("doc_id").agg(F.max("kept").alias("__kept"), F.count("*").alias("__n")).where("NOT __kept OR __n > 1")
    rows = written(rows.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.hash").alias("__hash"), "__kept", "__n"), "rows")
    few = F.broadcast(rows) if rows.limit(minhash.BROADCAST_IDS + 1).count() <= minhash.BROADCAST_IDS else rows
    marked = docs.join(few, F.col("doc_id").eqNullSafe(F.col("__id")) & (hashed == F.col("__hash")), "left")
    single = marked.where("__n IS NULL OR __kept AND __n = 1").select(*docs.columns)
    again = rows.where("__kept AND __n > 1")
    if again.isEmpty():
        return single
    return single.unionByName(marked.where("__kept AND __n > 1").dropDuplicates(["__id", "__hash"]).select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the raked shares of sources, languages and topics.

    Null and empty texts weigh one token and are sampled like others; texts are weighed whole. Rows that repeat an id are kept or left
    together, null ids too. Extra columns pass through, those with names of the operator's results too. An empty table gives an empty one.
    """
    return _through(docs, lambda d: mixing.mix(d).where("kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, packed into sequences of at most 2048 tokens.

    A null or empty text is its end token alone. Texts of any length are cut into pieces. Rows that repeat are all packed. Other
    columns are dropped; an empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizers and edit-similar groups are beyond SQL: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packing_stage:
            docs = written(docs, name.replace(" ", "-"))
    return docs
