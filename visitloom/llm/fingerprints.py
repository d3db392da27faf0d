"""I-Match fingerprints: hashes of the terms of a text that lie in a band of document frequencies, under several random lexicons.

Terms are runs of letters, digits and characters beyond ASCII, lower-cased, and stand as 64-bit hashes. The lexicon has the terms whose inverse document frequency
``ln(N / df)``, as a share of ``ln N``, lies in a band: neither the words of every text nor those of a few. A text's distinct terms in it are sorted and
hashed, then hashed again under random subsets of the lexicon: a number of lanes, in each of which every level drops half of what the
level before it kept. Coarse subsets tell texts apart, fine ones outlast an edit. Which terms a subset keeps follows from bits of their
hashes. All is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

#: All ASCII characters that are neither letters nor digits.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LANES, LEVELS = 5, 12
#: A text with fewer terms in the band is fingerprinted by all its terms.
LEAST_TERMS = 8
#: Largest lexicon that is sent to every task; beyond it texts are joined with it.
SENT_TERMS = 1_000_000
#: Rows and bytes of a range of documents, and ranges at most.
RANGE_ROWS, RANGE_BYTES, MOST_RANGES = 4096, 1 << 24, 1 << 14
EMPTY = "-"


def terms(text: Column, seed: int = 7) -> Column:
    """Distinct terms of a text as hashes, sorted; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), APART), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed)))))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = (0.2, 0.8), seed: int = 7) -> DataFrame:
    """h: terms of ``docs`` with ``band[0] <= ln(N / df) / ln(N) <= band[1]``, N the number of rows; written, since every text is held against it.

    Null and empty texts have no terms but count as rows. All rows count, repeated ones too. Empty for fewer than two rows.
    """
    n = docs.count()
    most, least = (n ** (1 - x) for x in band)
    df = docs.select(F.explode(terms(F.col(text), seed)).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return written(df.where((F.col("df") >= max(least, 1.0)) & (F.col("df") <= most) & F.lit(n > 1)).select("h"), "lexicon")


def in_band(rows: DataFrame, key: list[str], columns: list[str], lex: DataFrame, sent_terms: int = SENT_TERMS) -> DataFrame:
    """``rows`` with each of ``columns`` (arrays of hashes) cut to those of the lexicon and sorted, as ``<column>_band``; ``key`` is unique.

    Hashes meet the lexicon one a row and are gathered again by key; a lexicon of at most ``sent_terms`` is sent to every task, which leaves
    the rows where they are, a larger one is joined by a shuffle. All other columns travel in one row of each key.
    """
    known = lex.withColumn("known", F.lit(True))
    known = F.broadcast(known) if lex.count() <= sent_terms else known
    info = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    none = F.lit(None).cast(rows.select(info.alias("i")).schema["i"].dataType)
    sides = [F.struct(F.lit(-1).alias("side"), F.array(F.lit(0)).cast("array<bigint>").alias("hs"), info.alias("info"))]
    sides += [F.struct(F.lit(i).alias("side"), F.col(c).alias("hs"), none.alias("info")) for i, c in enumerate(columns)]
    single = rows.select(*key, F.explode(F.array(*sides)).alias("s")).select(*key, "s.side", "s.info", F.explode("s.hs").alias("h"))
    kept = single.join(known, "h", "left").where("known OR side = -1")
    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("h")))).alias(f"{c}_band") for i, c in enumerate(columns)]
    out = kept.groupBy(*key).agg(F.first("info", ignorenulls=True).alias("info"), *lists)
    return out.select("info.*", *[f"{c}_band" for c in columns])


def _hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def signature(band: Column, every: Column, whole: Column) -> Column:
    """The fingerprint of a text from its terms in the band, all its terms and its hash: a hash of the sorted list, then eight digits for each lane and level.

    A subset that holds none of the terms has a dash. A text without any terms has its own hash and dashes.
    """
    def levels(hs, lane):
        # each list from the one before it
        def narrower(acc, level):
            kept = F.filter(acc["hs"], lambda h: F.getbit(h, level + LEVELS * lane) == 0)
            digits = lambda k: F.when(F.size(k) > 0, F.right(_hex(F.xxhash64(k)), F.lit(8))).otherwise(EMPTY)
            return let(kept, lambda k: F.struct(k.alias("hs"), F.concat(acc["out"], F.array(digits(k))).alias("out")))

        start = F.struct(hs.alias("hs"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, narrower, lambda acc: acc["out"])

    def lanes(hs):
        return F.concat(*[levels(hs, lane) for lane in range(LANES)])

    used = F.when(F.size(band) >= LEAST_TERMS, band).otherwise(every)
    return F.concat_ws(".", _hex(F.when(F.size(every) > 0, F.xxhash64(used)).otherwise(whole)), let(used, lanes))


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets that hold a term of either text, the share in which both have the same: 1 for equal fingerprints, 0 where no subset holds any."""
    pairs = F.arrays_zip(F.slice(F.split(a, r"\."), 2, LANES * LEVELS).alias("a"), F.slice(F.split(b, r"\."), 2, LANES * LEVELS).alias("b"))
    def share(z):
        some = F.filter(z, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
        return F.size(F.filter(z, lambda p: (p["a"] == p["b"]) & (p["a"] != EMPTY))) / F.greatest(F.size(some), F.lit(1))
    return F.when(a == b, 1.0).otherwise(let(pairs, share))


def fingerprint(docs: DataFrame, lex: DataFrame, text: str = "text", key: str = "doc_id", sent_terms: int = SENT_TERMS) -> DataFrame:
    """``docs`` with fingerprint, under a lexicon of any corpus; ``key`` is unique.

    Equal texts have equal fingerprints; null is an empty text. Other columns pass, one named fingerprint is replaced.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"], terms(F.col(text)).alias("__t"))
    own = in_band(own, [key], ["__t"], lex, sent_terms)
    return own.withColumn("fingerprint", signature(F.col("__t_band"), F.col("__t"), F.xxhash64(F.coalesce(text, F.lit(""))))).drop("__t", "__t_band")


def ranges(docs: DataFrame, rows: int = RANGE_ROWS, size: int = RANGE_BYTES) -> Column:
    """A column that deals documents (doc_id, hash, text) into ranges of their order: by doc_id, nulls first, then the hash of the text.

    Bounds are quantiles of the ids, kept in the plan, so a retried task deals alike. An id that fills more than a range, or none, is cut by the hash.
    """
    n, none, n_bytes = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    k = min(MOST_RANGES, max(1, -(-n // rows), -(-n_bytes // size)))
    at = [i / k for i in range(1, k)]
    found = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * k))).first()[0] if at else []
    found = sorted(found or [])
    bounds = sorted(set(found))
    wide = max(1, math.isqrt(len(bounds)))
    upto = lambda bs, v: F.size(F.filter(bs, lambda b: b <= v))
    longs = lambda bs: F.array(*map(F.lit, bs)).cast("array<bigint>")
    v, coarse = F.col("doc_id"), bounds[::wide]
    fine = F.array(longs([]), *[longs(bounds[i * wide + 1: (i + 1) * wide]) for i in range(len(coarse))])
    bucket = let(upto(longs(coarse), v), lambda c: F.when(c > 0, (c - 1) * wide + 1).otherwise(0) + upto(F.get(fine, c), v))
    often = {b: found.count(b) for b in bounds if found.count(b) > 1}
    # the hash in order, as one of so many equal slices
    cut = lambda m: F.least(F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * m).cast("int"), m - 1)
    slices = F.try_element_at(F.create_map(*[F.lit(x) for b in often.items() for x in b]), v) if often else F.lit(None).cast("int")
    slot = F.coalesce(cut(slices), F.lit(MOST_RANGES))
    blank = cut(F.lit(max(1, -(-none * k // max(n, 1)))))
    return F.when(v.isNull(), -1 - MOST_RANGES + blank).otherwise(bucket * (2 * MOST_RANGES) + slot).cast("bigint")


def with_next(docs: DataFrame, rows: int = RANGE_ROWS, size: int = RANGE_BYTES) -> DataFrame:
    """part, pos, last, doc_id, text, next_text: documents with the text that follows in order of their ids, the first behind the last.

    Rows of one id follow each other by the hash of their text. Each range of ids is put in order by a task of its own; behind its
    own rows it has the first of the next range, marked ``last``, without a next text. Null texts are empty.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    d = d.withColumn("part", ranges(d, rows, size))
    firsts = d.groupBy("part").agg(F.min(F.struct("doc_id", "hash")).alias("f"))
    # a row for each range
    order = Window.orderBy("part")
    to = F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = written(firsts.select(F.col("part").alias("of"), "f", to.alias("to")), "firsts")
    heads = d.join(firsts, (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("hash") == F.col("f.hash")))
    heads = heads.groupBy("to").agg(F.min("text").alias("text"))
    own = d.select("part", F.lit(False).alias("last"), "doc_id", "hash", "text")
    every = own.unionByName(heads.select(F.col("to").alias("part"), F.lit(True).alias("last"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("hash"), "text"))
    w = Window.partitionBy("part").orderBy("last", "doc_id", "hash", "text")
    return every.select("part", F.row_number().over(w).alias("pos"), "last", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last quarter, rounded down, replaced by as many first code points of ``other``, or all it has."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(other, F.lit(1), quarter))


def edit_test(docs: DataFrame, band: tuple[float, float] = (0.2, 0.8), rows: int = RANGE_ROWS, size: int = RANGE_BYTES, sent_terms: int = SENT_TERMS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: how fingerprints of ``docs`` outlast an edit.

    The edited text ends in a quarter of the next document's, see ``edited`` and ``with_next``. near_edited is the likeness of a text's fingerprint to that
    of its edited text, near_next to that of the next document's text. The lexicon comes from ``docs`` themselves.

    A null text is empty; empty texts are alike. Rows that repeat all count and follow each other; null ids come first. Texts are read whole. Other columns are ignored; an
    empty table gives an empty one, a single document is its own next one.
    """
    lex = lexicon(docs, band=band)
    d = with_next(docs, rows, size).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    d = d.select("part", "pos", "last", "doc_id", F.length("text").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("own_hash"), F.xxhash64("edited").alias("edited_hash"),
                 terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("other"))
    d = in_band(d, ["part", "pos"], ["own", "other"], lex, sent_terms)
    d = d.withColumns({"fingerprint": signature(F.col("own_band"), F.col("own"), F.col("own_hash")), "edited_fingerprint": signature(F.col("other_band"), F.col("other"), F.col("edited_hash"))})
    d = d.select("part", "pos", "last", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                 F.lead("fingerprint").over(Window.partitionBy("part").orderBy("pos")).alias("next_fingerprint"))
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    return d.where("NOT last").select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
                                      near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
