"""Pairs: of all rows in blocks, of terms that share a code, of terms and synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a block, and blocks at least, so that small tables use all cores.
BLOCK_ROWS, LEAST_BLOCKS = 1024, 8
#: Rows of a block of vectors at most: 128 MB of 64 doubles.
MOST_ROWS = 262_144


def blocks_for(df: DataFrame, rows: int | None = None) -> int:
    """So many blocks that none holds much more than ``rows`` rows, ``BLOCK_ROWS`` if not said."""
    return max(LEAST_BLOCKS, -(-df.count() // (rows or BLOCK_ROWS)))


def vector_blocks(df: DataFrame) -> int:
    """Blocks of vectors: the 36 cells of ``LEAST_BLOCKS``, and no more until a block has ``MOST_ROWS``, so that rows sent grow just as the rows up to two million."""
    return max(LEAST_BLOCKS, -(-df.count() // MOST_ROWS))


def blocked(df: DataFrame, key: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Two sides on which ``__cell`` is equal for each pair of rows exactly once: all pairs as an equi-join.

    Rows are dealt into blocks by a hash; the left side goes to the cells of its row, the right side to those of its column.
    A cell holds one block of each side and no side is broadcast.
    """
    b = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    d = df.withColumn("__b", b)
    left = d.withColumn("__o", F.explode(every)).withColumn("__cell", F.col("__b") * blocks + F.col("__o")).drop("__b", "__o")
    right = d.withColumn("__o", F.explode(every)).withColumn("__cell", F.col("__o") * blocks + F.col("__b")).drop("__b", "__o")
    return left, right


def unordered_pairs(df: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """Each unordered pair of rows: columns of both with the suffixes _1 and _2, the lesser key first."""
    left, right = blocked(df, key, blocks or blocks_for(df))
    one = left.select("__cell", *[F.col(c).alias(f"{c}_1") for c in df.columns])
    two = right.select("__cell", *[F.col(c).alias(f"{c}_2") for c in df.columns])
    return one.join(two, "__cell").where(F.col(f"{key}_1") < F.col(f"{key}_2")).drop("__cell")


def pairs_by_code(terms: DataFrame, term: str = "term", code: str = "code") -> DataFrame:
    """term, counterpart: distinct terms that share a code, the lesser first; null codes pair nothing."""
    t = terms.where(F.col(code).isNotNull() & F.col(term).isNotNull()).select(F.col(code).alias("c"), F.col(term).alias("t")).distinct()
    return t.alias("a").join(t.alias("b"), "c").where("a.t < b.t").select(F.col("a.t").alias("term"), F.col("b.t").alias("counterpart")).distinct()


def mapped(terms: DataFrame, table: DataFrame, key: str, table_key: str, value: str, order: str) -> DataFrame:
    """``terms`` with the value that its key maps to; both keys as strings, of repeated keys the last row counts."""
    m = table.groupBy(F.col(table_key).cast("string").alias("__k")).agg(F.max_by(value, order).alias(value))
    return terms.join(m, F.col(key).cast("string") == F.col("__k"), "left").drop("__k")


def medication_pairs(terms: DataFrame, mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Pairs by the mapped code; terms in none of these are paired by their own."""
    m = mapped(terms, mapping, "code", key, value, order)
    by_map = pairs_by_code(m.dropna(subset=[value]).select("term", F.col(value).alias("code")))
    left = terms.join(ends(by_map), "term", "left_anti")
    return by_map.unionByName(pairs_by_code(left)).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """Distinct terms of a pair table."""
    return pairs.select(F.explode(F.array("term", "counterpart")).alias("term")).distinct()


def lonely(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct terms that are in no pair."""
    return terms.select("term").distinct().join(ends(pairs), "term", "left_anti")


def synonym_pairs(terms: DataFrame, synonym: Column) -> DataFrame:
    """Canonical pairs of terms with their synonym; none if it is empty or the term itself."""
    s = terms.select("term", synonym.alias("s")).where("s <> '' AND s <> term")
    return s.select(F.least("term", "s").alias("term"), F.greatest("term", "s").alias("counterpart")).distinct()


def both_in(pairs: DataFrame, sample: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose ends are both in a sample of keys."""
    keys = sample.select(F.col(sample.columns[0]).alias("__k")).distinct()
    return pairs.join(keys, F.col(a) == F.col("__k"), "left_semi").join(keys, F.col(b) == F.col("__k"), "left_semi")


def keys_of(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct keys over both columns of a pair table."""
    return pairs.select(F.col(a).alias("key")).union(pairs.select(F.col(b).alias("key"))).distinct()


def canonical(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def not_present(pairs: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that ``known`` has in neither direction."""
    k = known.select(*[c.alias(n) for c, n in zip(canonical(a, b), ("__a", "__b"))])
    lo, hi = canonical(a, b)
    return pairs.join(k, (lo == F.col("__a")) & (hi == F.col("__b")), "left_anti")


def with_vectors(pairs: DataFrame, vectors: DataFrame, key: str, vec: str, a: str, b: str) -> DataFrame:
    """Pairs with the vectors of both ends; pairs with an end that has none go."""
    v1, v2 = vectors.select(F.col(key).alias(a), F.col(vec).alias("vec_1")), vectors.select(F.col(key).alias(b), F.col(vec).alias("vec_2"))
    return pairs.join(v1, a).join(v2, b)


def symmetric(pairs: DataFrame, a: str, b: str, value: str, diagonal: float) -> DataFrame:
    """Long form of a square matrix: both directions and the diagonal."""
    both = pairs.select(a, b, value).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), value))
    keys = both.select(a).distinct()
    return both.unionByName(keys.select(a, F.col(a).alias(b), F.lit(diagonal).alias(value))).distinct()


def square(matrix: DataFrame, a: str, b: str, value: str, keys: list) -> DataFrame:
    """The wide form, for a stated list of keys."""
    return matrix.groupBy(a).pivot(b, keys).agg(F.first(value))


def diagonal_of(name: str) -> float:
    """1 for similarities, the top of the scale for scores, 0 for distances."""
    return 9.0 if "score" in name else 1.0 if "similarity" in name else 0.0
