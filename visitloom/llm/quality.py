"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. For every (language, source)
a minimum-covariance-determinant estimate is fitted from three deterministic starts (the medians with
the median deviations, with the covariance of squashed and with that of signed scores). From each start, concentrate: mean and covariance of the
chosen share of rows, distances of all rows, choose the nearest again. After two steps the start of least determinant
goes on until its determinant falls no further. Rows whose squared Mahalanobis distance from the fitted centre is beyond a
chi-square quantile are rejected.

Every figure of a group is a sum or a histogram that is folded before the
shuffle, so a group with a third of all rows costs no more than any other; no
group is ever gathered. The statistics are kept in whole thousandths, and everything is counted or summed as integers,
so a retried task gives the same estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shuffles, let, words, written

#: Names of the vector's components.
DIMS = ("length", "word", "symbol", "repeat", "upper")
#: Least standard deviation of each: a group without spread rejects no small difference.
FLOOR = {"length": 0.8, "word": 0.3, "symbol": 0.5, "repeat": 0.15, "upper": 0.15}
SCALE = 1000
#: Groups with fewer rows are fitted together with all others of their language.
MIN_GROUP = 50
#: Statistics are counted in steps of this many thousandths for medians, between these ends.
GRAIN, ENDS = 5, 30_000
#: Distances are counted in so many steps each time that they double.
GRADES = 64
#: A fit goes on while half the logarithm of its determinant falls by more than this.
SETTLED = 1e-3
#: Group estimates up to this many are sent to all executors; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000


def repeated_words(tokens: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in the list, the first occurrences included."""
    def of(ws):
        grams = F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3),
            lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("g"), i.alias("p")),
        )
        return let(F.array_sort(grams), covered)

    def covered(s):
        twice = F.filter(
            s,
            lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)),
        )
        at = F.array_sort(F.transform(twice, lambda x: x["p"]))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0), lambda a, x: a + x))

    return F.when(F.size(tokens) < 4, F.lit(0)).otherwise(let(tokens, of)).cast("bigint")


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper (all long) of the whole text.

    Null or empty text: zeros.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = ["__words", "__lines"]
    d = docs.withColumns({"__words": words(F.col(text)), "__lines": lines})
    return d.select(
        *[F.col(c) for c in docs.columns],
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.regexp_count(t, F.lit(r"[A-Z]")).cast("bigint").alias("n_upper"),
    ).drop(*names)


def vector(s=F.col) -> dict[str, Column]:
    """The transformed statistics, each about symmetric for ordinary prose."""
    n = F.greatest(s("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(s("word_chars"), F.lit(1)).cast("double")
    share = F.least(s("n_repeat_words") / n, F.lit(1.0))
    return {
        "length": F.log(n),
        "word": chars / n,
        "symbol": F.log(1.0 + 100.0 * s("n_symbols") / n),
        "repeat": F.sqrt(share),
        "upper": F.sqrt(s("n_upper") / chars),
    }


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None,
          half: float = 0.75, steps: int = 40, level: float = 1 - 1e-7) -> DataFrame:
    """``carry`` (default: all columns) with the base statistics, base_failed, distance (squared) and kept.

    One row per input row; repeated rows are judged alike. base_failed: fewer
    than 50 words, or more than half of the words in repeated 3-word windows.
    Rows that fail take no part in the fit and are never kept; null, empty and
    blank texts are among them. Null languages and sources count as the empty string. Groups under
    ``MIN_GROUP`` rows share one estimate per language, those of too small
    languages one for all. An empty table gives an empty result. ``half`` is the share of rows
    that a fit holds (of rows as far away as the last, all); its covariance is scaled to that of the whole of a normal
    group. A fit takes at most ``steps`` steps, far more than it needs. ``level`` is the share of a normal group within the cutoff: ordinary texts
    spread wider than that, so it is near 1. Columns of
    ``docs`` with the names of results are replaced.
    """
    cutoff = chi_square_quantile(level, len(DIMS))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "distance", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in own]
    d = base_statistics(docs.select(*{c: None for c in [*carry, text, lang, source]}), text)
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    parts = {f"__x{k}": F.round(v * SCALE).cast("bigint") for k, v in enumerate(vector().values())}
    d = d.withColumns({**parts, "__lang": F.coalesce(F.col(lang), F.lit("")), "__source": F.coalesce(F.col(source), F.lit(""))})
    d = written(d.select(*carry, *own[:7], *parts, "__lang", "__source"), "quality")
    groups = written(_groups(d), "groups")
    # every table of the fit has at most a row for each of these
    send = F.broadcast if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else lambda t: t
    rows = d.join(send(groups), ["__lang", "__source"], "left")
    fit = written(_fit(written(rows.where("NOT base_failed").select("g", *parts), "vectors"), half, steps, send), "estimates")
    drop_shuffles(d)
    scored = _distance(rows.join(send(fit), "g", "left"))
    return scored.select(
        *carry, *own[:7], "distance",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def _groups(d: DataFrame) -> DataFrame:
    """__lang, __source, g: the group whose estimate holds for these rows."""
    fine = d.where("NOT base_failed").groupBy("__lang", "__source").agg(F.count("*").alias("n"))
    per_lang = Window.partitionBy("__lang")
    return fine.select(
        "__lang", "__source", "n",
        F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n"))).over(per_lang).alias("rest"),
    ).select(
        "__lang", "__source",
        F.when(F.col("n") >= MIN_GROUP, F.to_json(F.struct("__lang", "__source")))
        .when(F.col("rest") >= MIN_GROUP, F.to_json(F.struct("__lang"))).otherwise("{}").alias("g"),
    )


def chi_square(x: float, k: float) -> float:
    """Distribution function of chi-square with ``k`` degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h, term, total, n = k / 2, x / 2, 2 / k, 2 / k, 0
    while term > total * 1e-17:
        n += 1
        term *= h / (a + n)
        total += term
    return total * math.exp(a * math.log(h) - h - math.lgamma(a))


def chi_square_quantile(level: float, k: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < level else (lo, mid)
    return hi


def consistency(half: float, k: int) -> float:
    """What the covariance of the nearest ``half`` of a normal group is to be scaled by."""
    return half / chi_square(chi_square_quantile(half, k), k + 2)


def _quantile(t: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The least ``value`` (whole) that at least ``share`` of the rows of a key do not exceed, from the counts of values."""
    counts = t.groupBy(*keys, value).agg(F.count("*").alias("n"))
    at = Window.partitionBy(*keys)
    counts = counts.select(*keys, value, F.sum("n").over(at.orderBy(value)).alias("upto"), F.sum("n").over(at).alias("all"))
    return counts.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min(value).alias(name))


def _starts(x: DataFrame, send) -> DataFrame:
    """g, start, centre m0.. and Cholesky factor l00.. of the three starts of each group."""
    k = range(len(DIMS))

    def medians(t, values):
        parts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.least(F.greatest(v, F.lit(-ENDS)), F.lit(ENDS)) / GRAIN).alias("v")) for i, v in enumerate(values)])).alias("p")
        m = _quantile(t.select("g", parts).select("g", "p.i", "p.v"), ["g", "i"], "v", 0.5, "m")
        return m.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, (F.col("m") * GRAIN).cast("bigint"))).alias(f"c{i}") for i in k])

    middle = written(medians(x, [F.col(f"__x{i}") for i in k]), "medians")
    away = medians(x.join(send(middle), "g"), [F.abs(F.col(f"__x{i}") - F.col(f"c{i}")) for i in k])
    away = away.select("g", *[F.sqrt(F.pow(1.4826 * F.col(f"c{i}"), 2) + (SCALE * FLOOR[DIMS[i]]) ** 2).alias(f"s{i}") for i in k])
    centre = written(middle.join(away, "g"), "centres")
    d = x.join(send(centre), "g").select("g", *[((F.col(f"__x{i}") - F.col(f"c{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in k])
    d = d.withColumn("r", F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in k), F.lit(0.0)), F.lit(1e-6)))
    million = lambda v: F.round(v * 1e6).cast("bigint")
    sums = d.groupBy("g").agg(F.count("*").alias("n"), *[a for i in k for j in range(i + 1) for a in (
        F.sum(million(F.tanh(f"z{i}") * F.tanh(f"z{j}"))).alias(f"t{i}{j}"), F.sum(million(F.col(f"z{i}") * F.col(f"z{j}") / F.col("r"))).alias(f"u{i}{j}"))])
    of = {0: lambda i, j: F.lit(1.0 if i == j else 0.0), 1: lambda i, j: F.col(f"t{i}{j}") / (1e6 * F.col("n")), 2: lambda i, j: F.col(f"u{i}{j}") * len(DIMS) / (1e6 * F.col("n"))}
    base = written(sums.join(centre, "g"), "starts")
    out = None
    for start, at in of.items():
        cov = base.select("g", F.lit(start).alias("start"), *[F.col(f"c{i}").cast("double").alias(f"m{i}") for i in k],
                          *[(at(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"p{i}{j}") for i in k for j in range(i + 1)])
        est = _factor(cov)
        out = est if out is None else out.unionByName(est)
    return out


def _fit(x: DataFrame, half: float, steps: int, send) -> DataFrame:
    """g -> centre m0.. and Cholesky factor l00.. of the concentrated covariance of least determinant found."""
    x = x.select("g", *[f"__x{i}" for i in range(len(DIMS))])
    est = _starts(x, send)
    est = _step(x, est, half, send)
    est = written(_step(x, written(est, "estimates"), half, send), "estimates")
    least = F.min_by(F.struct(*[c for c in est.columns if c != "g"]), F.struct("size", "start"))
    best = written(est.groupBy("g").agg(least.alias("e")).select("g", "e.*"), "estimates")
    names = [c for c in best.columns if c != "g"]
    for _ in range(max(steps - 2, 0)):
        nxt = _step(x, best, half, send).select("g", F.struct(*names).alias("next"))
        both = best.select("g", F.struct(*names).alias("e")).join(nxt, "g")
        fell = F.col("next.size") < F.col("e.size") - SETTLED
        both = written(both.select("g", F.when(fell, F.col("next")).otherwise(F.col("e")).alias("e"), fell.alias("fell")), "estimates")
        best = both.select("g", "e.*")
        if both.where("fell").isEmpty():
            break
    return best


def _step(x: DataFrame, est: DataFrame, half: float, send) -> DataFrame:
    """The estimates of the rows nearest to ``est``: of each group and start the share ``half``, and all as near as the last of them.

    Rows are added up by how far away they are, then these sums from the nearest on: one pass over the rows.
    """
    k = range(len(DIMS))
    d = _distance(x.join(send(est), "g")).withColumn("grade", F.floor(F.log2(F.col("distance") + 1.0) * GRADES).cast("int"))
    firsts, seconds = [f"t{i}" for i in k], [f"p{i}{j}" for i in k for j in range(i + 1)]
    sums = d.groupBy("g", "start", "grade").agg(
        F.count("*").alias("n"),
        *[F.sum(f"__x{i}").alias(f"t{i}") for i in k],
        *[F.sum((F.col(f"__x{i}") * F.col(f"__x{j}")).cast("decimal(38,0)")).alias(f"p{i}{j}") for i in k for j in range(i + 1)],
    )
    group = Window.partitionBy("g", "start")
    upto = group.orderBy("grade")
    sums = sums.select("g", "start", "grade", F.sum("n").over(group).alias("all"), *[F.sum(c).over(upto).alias(c) for c in ["n", *firsts, *seconds]])
    sums = sums.where(F.col("n") >= F.ceil(F.col("all") * half)).groupBy("g", "start").agg(F.min_by(F.struct("n", *firsts, *seconds), "grade").alias("s")).select("g", "start", "s.*")
    mean = sums.select("g", "start", "n", *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in k], *[F.col(c).cast("double").alias(c) for c in seconds])
    scale = consistency(half, len(DIMS))
    return _factor(mean.select("g", "start", *[f"m{i}" for i in k], *[
        (scale * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"p{i}{j}") for i in k for j in range(i + 1)]))


def _factor(d: DataFrame) -> DataFrame:
    """g, start, m0.., the Cholesky factor l00.. of the covariance p00.. and size, half the logarithm of its determinant."""
    k = range(len(DIMS))
    for i in k:
        for j in range(i + 1):
            a = F.col(f"p{i}{j}")
            if i == j:
                a = F.greatest(a, F.lit(0.0)) + (SCALE * FLOOR[DIMS[i]]) ** 2
            for h in range(j):
                a = a - F.col(f"l{i}{h}") * F.col(f"l{j}{h}")
            # the floor on the diagonal keeps every pivot at its square or more, up to rounding
            v = F.sqrt(F.greatest(a, F.lit((SCALE * FLOOR[DIMS[i]]) ** 2 * 0.5))) if i == j else a / F.col(f"l{j}{j}")
            d = d.withColumn(f"l{i}{j}", v)
    size = sum((F.log(F.col(f"l{i}{i}")) for i in k), F.lit(0.0))
    return d.select("g", "start", *[f"m{i}" for i in k], *[f"l{i}{j}" for i in k for j in range(i + 1)], size.alias("size"))


def _distance(d: DataFrame) -> DataFrame:
    """``d`` with distance: the squared Mahalanobis distance, by forward substitution."""
    k = range(len(DIMS))
    names = [f"__z{i}" for i in k]
    for i in k:
        a = F.col(f"__x{i}") - F.col(f"m{i}")
        for j in range(i):
            a = a - F.col(f"l{i}{j}") * F.col(names[j])
        d = d.withColumn(names[i], a / F.col(f"l{i}{i}"))
    return d.withColumn("distance", sum((F.col(z) * F.col(z) for z in names), F.lit(0.0))).drop(*names)
