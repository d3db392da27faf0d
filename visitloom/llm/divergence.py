"""Divergence of sources by their words: exact distances between the term distributions of every two sources of a language.

Occurrences are counted in tasks and added up by term. A language keeps the terms that enough of its documents have. The distance of two sources is a
sum over all kept terms, split in three: what it would be if neither source had any of the terms, a number for each pair; a correction
for each heavy term, one that many sources have, from dense tiles of terms by sources; and corrections for light terms from their postings only, one for each source that has a term and one for
each two sources that share it. All are whole numbers, so the parts add up exactly in any order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare_workers, written

#: Terms that a task counts before it hands its counts on, and bytes of text it takes in at once.
HELD = 400_000
#: Sources of a block, terms of a tile, pairs of a source and a posting that are expanded at once.
SOURCES, TILE, EXPAND = 256, 2048, 2_000_000
#: Postings for each part that a language's terms are dealt into.
PART_ROWS = 32_768

_KEPT = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: Bytes of a text to terms set apart by blanks: ASCII letters lower-cased, all other ASCII characters blanks, the rest as it is.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b for b in _KEPT)
COUNTS = "lang string, source string, term binary, n long, docs long"


def _count(batches):
    """Occurrences and documents of each term by language and source; a row without a term for each language and source."""
    import pyarrow as pa

    def rows(held):
        for (lang, source), terms in held.items():
            n = len(terms) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([None, *terms], pa.binary()),
                pa.array([0, *[v[0] for v in terms.values()]], pa.int64()), pa.array([0, *[v[1] for v in terms.values()]], pa.int64())], ["lang", "source", "term", "n", "docs"])

    held, size = {}, 0
    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, b.column(2)):
            terms = held.setdefault((lang, source), {})
            before = len(terms)
            own: dict[bytes, int] = {}
            for t in text.as_py().translate(TO_TERMS).split():
                own[t] = own.get(t, 0) + 1
            for t, n in own.items():
                was = terms.get(t)
                if was is None:
                    terms[t] = [n, 1]
                else:
                    was[0] += n
                    was[1] += 1
            size += len(terms) - before
            if size > HELD:
                yield from rows(held)
                held, size = {}, 0
    yield from rows(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of each term of ``docs`` (text, lang, source; null: empty); a row with a null term for each language and source."""
    prepare_workers(docs.sparkSession)
    flat = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # one shuffle by term serves the counts and the frequencies below
    dealt = flat.mapInArrow(_count, COUNTS).repartition("lang", "term")
    return dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: str, terms: str, unit: int) -> Column:
    """``1 + floor(unit * (n + 5) / (total + 5 * terms))`` exactly; null where there are no terms."""
    return F.expr(f"CAST(CAST({unit} AS DECIMAL(20,0)) * CAST({n} + 5 AS DECIMAL(18,0)) DIV nullif({total} + 5 * {terms}, 0) AS BIGINT) + 1")


def _corrections(table):
    """One cell: what the terms of a part add to the distance of each two sources of two blocks, beyond that of two sources without them."""
    import pyarrow as pa

    lang, rows, cols = table["lang"][0].as_py(), table["rows"][0].as_py(), table["cols"][0].as_py()
    col = {c: table[c].to_numpy(zero_copy_only=False) for c in ("g", "p", "heavy", "side")}
    none = table["term"].is_null().to_numpy(zero_copy_only=False)
    ids = table["term"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    sides = []
    for side in (0, 1):
        own = (col["side"] == side) if rows != cols else np.full(len(none), True)
        base = np.sort(np.rec.fromarrays([col["g"][own & none], col["p"][own & none]], names="g,p"), order="g")
        at = own & ~none
        order = np.lexsort((col["g"][at], ids[at]))
        post = [v[at][order] for v in (ids, col["g"], col["p"], col["heavy"])]
        post[1] = np.searchsorted(base["g"], post[1])
        sides.append((base["g"], base["p"].astype(np.int64), post))
    (ga, pa0, a), (gb, pb0, b) = sides
    flat = np.abs(pa0[:, None] - pb0[None, :])
    total = _dense(a, b, pa0, pb0, flat) + _sparse(a, b, pa0, pb0, flat)
    i, j = np.nonzero(ga[:, None] < gb[None, :])
    i, j = (v[total[i, j] != 0] for v in (i, j))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(ga[i], pa.int32()), "b": pa.array(gb[j], pa.int32()), "more": pa.array(total[i, j], pa.int64())})


def _dense(a, b, pa0, pb0, flat):
    """Heavy terms: tiles of terms by sources, absolute differences added up over the terms."""
    out = np.zeros_like(flat)
    heavy = np.union1d(a[0][a[3]], b[0][b[3]])
    for lo in range(0, len(heavy), TILE):
        some = heavy[lo: lo + TILE]
        tiles = []
        for (ids, g, p, _), p0 in ((a, pa0), (b, pb0)):
            tile = np.repeat(p0[:, None], len(some), axis=1)
            x, y = np.searchsorted(ids, [some[0], some[-1] + 1])
            at = np.searchsorted(some, ids[x:y])
            on = some[np.minimum(at, len(some) - 1)] == ids[x:y]
            tile[g[x:y][on], at[on]] = p[x:y][on]
            tiles.append(tile)
        for k, row in enumerate(tiles[0]):
            out[k] += np.abs(row[None, :] - tiles[1]).sum(axis=1) - flat[k] * len(some)
    return out


def _one_sided(post, mine, others):
    """For each source with light terms and each other: |p - other's floor| less the distance of their floors, over the source's terms."""
    _, g, p, heavy = post
    out = np.zeros((len(mine), len(others)), np.int64)
    for k in range(len(mine)):
        own = np.sort(p[(g == k) & ~heavy])
        if len(own):
            upto = np.r_[0, np.cumsum(own)]
            n = np.searchsorted(own, others)
            out[k] = (n * others - upto[n]) + (upto[-1] - upto[n] - (len(own) - n) * others) - len(own) * np.abs(mine[k] - others)
    return out


def _sparse(a, b, pa0, pb0, flat):
    """Light terms: corrections for either source, then for each two postings of one term what these leave."""
    out = _one_sided(a, pa0, pb0) + _one_sided(b, pb0, pa0).T
    (ia, ga, va), (ib, gb, vb) = [[v[~s[3]] for v in s[:3]] for s in (a, b)]
    lo, hi = np.searchsorted(ib, ia, "left"), np.searchsorted(ib, ia, "right")
    n = hi - lo
    ends = np.cumsum(n)
    at = 0
    while at < len(ia):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPAND, "right")))
        k = np.repeat(np.arange(at, upto), n[at:upto])
        m = lo[k] + np.arange(len(k)) - np.repeat(ends[at:upto] - n[at:upto] - (ends[at - 1] if at else 0), n[at:upto])
        x, y, p, q = ga[k], gb[m], va[k], vb[m]
        np.add.at(out, (x, y), np.abs(p - q) - np.abs(p - pb0[y]) - np.abs(q - pa0[x]) + flat[x, y])
        at = upto
    return out


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, unit: int = 1_000_000_000, heavy_share: float = 0.25) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language lie apart, and the terms that set a source apart from its language.

    Terms are runs of ASCII letters, lower-cased, and characters beyond ASCII. A language keeps the terms that at least ``min_docs`` of its documents
    have; each source and the language as a whole give a kept term ``p = 1 + floor(unit * (count + 5) / (all + 5 * terms))``. Part ``pair``: item is each other source of
    the language, value the sum of ``|p - q|`` over all kept terms. Part ``term``: item is each kept term that the source has and uses more than the language, value by how much, the first ``top`` only.
    Ranks are by value, largest first, then item by its bytes. A term is heavy if more than ``heavy_share`` of the language's sources have it.

    Null text, lang and source are empty. Rows that repeat all count. A source without terms, or a language that keeps none, has pairs all the same, at 0 if none is kept; a
    language of one source has no pairs. Texts are read whole. Other columns are ignored; an empty table gives an empty one.
    """
    key = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("df", F.sum("docs").over(key)).withColumn("having", F.count("*").over(key)).withColumn("in_lang", F.sum("n").over(key))
    kept = written(counts.where(F.col("term").isNull() | (F.col("df") >= min_docs)).select("lang", "source", "term", "n", "having", "in_lang"), "terms")
    sources = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("own"))
    each = kept.where("term IS NOT NULL").groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = sources.join(each, "lang", "left").fillna(0, ["terms", "lang_total"])
    in_lang = Window.partitionBy("lang")
    groups = groups.withColumn("g", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("groups", F.count("*").over(in_lang))
    groups = groups.withColumn("parts", F.ceil(F.sum("own").over(in_lang) / F.lit(PART_ROWS)).cast("int")).withColumn("floor", share("0", "total", "terms", unit))
    groups = written(groups, "groups")

    postings = kept.where("term IS NOT NULL").join(groups.drop("own"), ["lang", "source"])
    postings = postings.withColumn("p", share("n", "total", "terms", unit))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = postings.withColumn("value", F.col("p") - share("in_lang", "lang_total", "terms", unit)).where("value > 0")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    return terms.unionByName(_pairs(postings, groups, heavy_share).withColumn("rank", F.row_number().over(by)))


def _pairs(postings: DataFrame, groups: DataFrame, heavy_share: float) -> DataFrame:
    """lang, source, part, item, value of every two sources of a language."""
    rows = postings.select("lang", "term", "g", "p", "groups", (F.col("having") > heavy_share * F.col("groups")).alias("heavy"),
                           F.array(F.pmod(F.xxhash64("term"), F.greatest("parts", F.lit(1))).cast("int")).alias("in"))
    floors = groups.where("terms > 0 AND groups > 1").select("lang", F.lit(None).cast("binary").alias("term"), "g", F.col("floor").alias("p"), "groups", F.lit(False).alias("heavy"),
                                                             F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1).alias("in"))
    block = F.floor(F.col("g") / SOURCES).cast("int")
    blocks = F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / SOURCES).cast("int"))
    cells = F.transform(blocks, lambda o: F.struct(F.least(block, o).alias("rows"), F.greatest(block, o).alias("cols"), F.when(block <= o, 0).otherwise(1).alias("side")))
    dealt = rows.where("groups > 1").unionByName(floors).withColumn("part", F.explode("in")).withColumn("cell", F.explode(cells))
    dealt = dealt.select("lang", "part", "cell.rows", "cell.cols", "cell.side", "term", "g", "p", "heavy")
    more = dealt.groupBy("lang", "part", "rows", "cols").applyInArrow(_corrections, "lang string, a int, b int, more long")
    more = more.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))

    end = lambda s: groups.select("lang", F.col("g").alias(s), F.col("source").alias(f"source_{s}"), F.col("floor").alias(f"floor_{s}"), "terms")
    two = end("a").join(end("b").drop("terms"), "lang").where("a < b").join(more, ["lang", "a", "b"], "left")
    value = F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("floor_a") - F.col("floor_b")) + F.coalesce("more", F.lit(0))).otherwise(0)
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return two.select("lang", value.alias("value"), ways.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
