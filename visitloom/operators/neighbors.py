"""Pairwise metrics and nearest neighbours over vectors: blocks of rows meet in cells, tile by tile, each a matrix product in a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import one_thread, ship_package
from . import stats
from .pairs import vector_blocks
from .sampling import bottom_k

#: Rows of a tile, the part of a cell that is worked out at once: a matrix of 512 KB, which stays in the cache of a core.
TILE_ROWS = 256
#: Tasks that cells are dealt to at most.
CELL_TASKS = 512
#: Squared distances under this share of the squared norms are taken again from the differences.
CLOSE = 1e-4
#: Counters of a metric's values in a task, and different values that are sent to all executors at most, 16 bytes each.
DENSE, RANKED = 1 << 24, 4_000_000
#: Values of a metric that a task holds, 8 bytes each, before they are counted at once.
HELD = 1 << 22
#: Values of a metric whose counts are sent as one row.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS


def _units(x):
    import numpy as np

    norms = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=norms != 0)


def _cosines(x, y):
    """Cosine similarities of the rows of two matrices, 0 for a zero vector."""
    return _units(x) @ _units(y).T


def _norms(x):
    """Squared norms of the rows of a matrix, and one over their norms; 0 for a zero vector."""
    import numpy as np

    squares = (x * x).sum(1)
    return squares, np.divide(1.0, np.sqrt(squares), out=np.zeros_like(squares), where=squares != 0)


def _distances(x, y, products=None, squares=None):
    """Euclidean distances of the rows of two matrices, by norms and products; where these cancel, by differences. Products and squared norms may be given."""
    import numpy as np

    left, right = squares or ((x * x).sum(1), (y * y).sum(1))
    left, right = left[:, None], right[None, :]
    square = -2 * (x @ y.T if products is None else products)
    square += left
    square += right
    # rows of which some pair may cancel, then the pairs
    near = np.nonzero(square.min(axis=1) < CLOSE * (left[:, 0] + right.max()))[0]
    i, j = np.nonzero(square[near] < CLOSE * (left[near] + right))
    i = near[i]
    for at in range(0, len(i), 65_536):
        d = x[i[at: at + 65_536]] - y[j[at: at + 65_536]]
        square[i[at: at + 65_536], j[at: at + 65_536]] = (d * d).sum(1)
    np.maximum(square, 0, out=square)
    return np.sqrt(square, out=square)


def _matrix(column):
    import numpy as np

    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1)


def _over_cells(vectors: DataFrame, key: str, vec: str, blocks: int | None, work: Callable, columns: str) -> DataFrame:
    """What ``work(keys, matrix, keys, matrix, same)`` yields, lists of columns, of every two blocks and of each block with itself (``same``), keys in order.

    Rows are dealt into blocks by a hash. Two blocks meet in one cell, so a row is sent once for each block and each pair is worked out once. Rows without a key or a vector take
    no part, all vectors must have one length. ``columns`` may name the type of the keys as ``{key}``.
    """
    ship_package(vectors.sparkSession)
    single = vectors.schema[vec].dataType.simpleString() == "array<float>"  # sent as they are, half as long
    v = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("k"), (F.col(vec) if single else V.doubles(F.col(vec))).alias("v"))
    blocks = blocks or vector_blocks(v)
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    dealt = v.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).alias("second"), "k", "v")
    kind = v.schema["k"].dataType.simpleString()
    columns = columns.format(key=kind)
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        one_thread()
        table = pa.Table.from_batches(list(batches))
        same = table["one"][0].as_py() == table["two"][0].as_py()
        table = table.sort_by("k")
        one = table.filter(pc.invert(table["second"]))
        two = one if same else table.filter(table["second"])
        held = table.schema.field("k").type
        types = [kinds[c.split()[1]] if c.split()[0] not in ("k_1", "k_2") else held for c in columns.split(", ")]
        del table
        if one.num_rows and two.num_rows:
            for values in work(one["k"].to_numpy(), _matrix(one["v"]), two["k"].to_numpy(), _matrix(two["v"]), same):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types)], names)

    tasks = min(4 * (blocks * (blocks + 1) // 2), CELL_TASKS)  # most cells have a task of their own
    return dealt.repartition(tasks, "one", "two").groupBy("one", "two").applyInArrow(run, columns)


def _tiles(k1, x, k2, y, same):
    """The tiles of a cell: keys and rows of both sides, and which of their pairs count; None if all do."""
    for i in range(0, len(k1), TILE_ROWS):
        for j in range(i if same else 0, len(k2), TILE_ROWS):
            a, b = k1[i: i + TILE_ROWS], k2[j: j + TILE_ROWS]
            yield a, x[i: i + TILE_ROWS], b, y[j: j + TILE_ROWS], a[:, None] < b[None, :] if same else None


#: The metrics of a pair.
METRICS = {"cosine_similarity": _cosines, "euclidean_distance": _distances}


def pairwise_metrics(vectors: DataFrame, key: str, vec: str, blocks: int | None = None, metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """cosine_similarity and euclidean_distance of each unordered pair, the lesser key first; only those of ``metrics`` are worked out.

    A row for each pair leaves a task a tile at a time; what is sent beforehand grows with the rows.
    """
    def pairs(*cell):
        import numpy as np

        for k1, x, k2, y, which in _tiles(*cell):
            values = [METRICS[m](x, y) for m in metrics]
            i, j = np.nonzero(np.full((len(k1), len(k2)), True) if which is None else which)
            a, b = k1[i], k2[j]
            turn = a > b
            yield np.where(turn, b, a), np.where(turn, a, b), *[v[i, j] for v in values]

    p = _over_cells(vectors, key, vec, blocks, pairs, "k_1 {key}, k_2 {key}, " + ", ".join(f"{m} double" for m in metrics))
    return p.withColumnsRenamed({"k_1": f"{key}_1", "k_2": f"{key}_2"})


def fold_pairs(vectors: DataFrame, key: str, vec: str, start: Callable, add: Callable, result: Callable, columns: str, blocks: int | None = None) -> DataFrame:
    """A few rows for each cell instead of one for each pair: ``add(state, cosines, distances)`` folds the pairs of a tile, ``distances()`` works these out.

    ``result(state)`` yields lists of columns. Pairs are those of ``pairwise_metrics``. Both metrics come from one matrix product of a tile.
    """
    def fold(k1, x, k2, y, same):
        import numpy as np

        state = start()
        one, two = _norms(x), _norms(y)
        # with each row of a tile its norms
        x, y = np.column_stack([x, *one]), np.column_stack([y, *two])
        for _, a, _, b, which in _tiles(k1, x, k2, y, same):
            some = lambda m: m.ravel() if which is None else m[which]  # noqa: B023, E731
            products = a[:, :-2] @ b[:, :-2].T
            cos = products * a[:, -1:]
            cos *= b[:, -1]
            state = add(state, some(cos), lambda: some(_distances(a[:, :-2], b[:, :-2], products, (a[:, -2], b[:, -2]))))  # noqa: B023
        yield from result(state)

    return _over_cells(vectors, key, vec, blocks, fold, columns)


def metric_histogram(vectors: DataFrame, key: str, vec: str, lo: float, hi: float, bins: int, digits: int = 9) -> DataFrame:
    """bin, n: the histogram of ``stats.histogram`` of the cosine similarities of all pairs, folded in the cells. What is no number goes to the last bin."""
    def add(counts, cos, away):
        import numpy as np

        at = np.round(cos, digits)
        at -= lo
        at /= (hi - lo) / bins
        np.clip(np.floor(at, out=at), 0, bins - 1, out=at)
        if np.isnan(at.sum()):
            at[np.isnan(at)] = bins - 1
        return counts + np.bincount(at.astype(np.int32), minlength=bins)

    def rows(counts):
        at = counts.nonzero()[0]
        yield at, counts[at]

    p = fold_pairs(vectors, key, vec, lambda: 0, add, rows, "bin int, n long")
    return p.groupBy("bin").agg(F.sum("n").alias("n"))


def metric_regression(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """slope, intercept, r2 of the distances of all pairs by their cosine similarities, from moments folded in the cells."""
    def add(state, cos, away):
        away, n = away(), len(cos)
        if not n:
            return state
        x, y = cos.mean(), away.mean()
        c, d = cos - x, away - y
        state.append((n, n * x, n * y, c @ c + n * x * x, d @ d + n * y * y, c @ d + n * x * y))
        return state

    def rows(state):
        import math

        if state:
            yield [[math.fsum(c)] for c in zip(*state)]

    names = ["n", "x", "y", "xx", "yy", "xy"]
    t = fold_pairs(vectors, key, vec, list, add, rows, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names])
    t = t.select("n", "x", "y", *[(F.col(a + b) - F.col(a) * F.col(b) / F.col("n")).alias(a + b) for a, b in ("xx", "yy", "xy")])
    t = t.select("*", F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).alias("slope"))
    r2 = F.when(F.col("xx") > 0, F.when(F.col("yy") > 0, F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy"))).otherwise(1.0))
    return t.select("slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("intercept"), r2.alias("r2"))


def _whole(values, scale: int):
    """Values as whole numbers of steps of ``1 / scale``, halves away from zero; what is no number comes last."""
    import numpy as np

    w = values * scale
    w += np.copysign(0.5, w)  # what is behind the point goes in the end
    if not np.isfinite(w.sum()):
        w = np.clip(np.nan_to_num(w, nan=2.0**62), -(2.0**61), 2.0**62)
    return w.astype(np.int64)


def metric_spearman(vectors: DataFrame, key: str, vec: str, digits: int = 6) -> DataFrame:
    """n, rho: the rank correlation of cosine similarities and distances of all pairs, both rounded to ``digits``; ties have average ranks. Null without spread.

    No pair is kept: cells count the values, the values are ranked, and cells work out their pairs again to add up products of ranks. Counts leave a cell as strings of bytes,
    ``CHUNK`` values each, so what is sent is no row for each value. Up to ``RANKED`` different values of each metric are sent to all executors; with more, as distances may have,
    pairs are kept and ranked by ``stats.spearman``.
    """
    import numpy as np

    spark, scale, most = vectors.sparkSession, 10**digits, RANKED

    def merged(found):
        values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([n for _, n in found]), len(values)).astype(np.int64)

    def emptied(dense, held):
        n = np.bincount(held[1][: held[0]])
        dense[: len(n)] += n
        held[0] = 0

    def count(state, cos, away):
        for dense, wide, held, values in zip(*state, (cos, away())):
            values = _whole(values, scale)
            if not len(values):
                continue
            low, end = values.min() + scale, values.max() + scale + 1
            if low >= 0 and end <= HELD:
                if held[0] + len(values) > HELD:
                    emptied(dense, held)
                np.add(values, scale, out=held[1][held[0]: held[0] + len(values)])
                held[0] += len(values)
            elif low >= 0 and end <= DENSE:
                np.add.at(dense, values + scale, 1)
            elif not wide or len(wide[0][0]) <= most:  # with more there is nothing to rank here
                wide.append(np.unique(values, return_counts=True))
                if sum(len(v) for v, _ in wide[1:]) > most:
                    wide[:] = [merged(wide)]
        return state

    def chunks(metric, values, n):
        """Sorted values and their counts as rows: metric, chunk, places in it, counts."""
        chunk, at = np.unique(values >> CHUNK_BITS, return_index=True)
        ends = [*at[1:], len(values)]
        places = (values & (CHUNK - 1)).astype("<u2")
        return np.full(len(chunk), metric), chunk, [places[i:j].tobytes() for i, j in zip(at, ends)], [n[i:j].astype("<i8").tobytes() for i, j in zip(at, ends)]

    def counted(state):
        for metric, (dense, wide, held) in enumerate(zip(*state)):
            emptied(dense, held)
            at = dense.nonzero()[0]
            found = [(at - scale, dense[at]), *wide]
            if any(len(v) for v, _ in found):
                yield chunks(metric, *(merged(found) if wide else found[0]))

    def folded(table: pa.Table) -> pa.Table:
        n = np.zeros(CHUNK, np.int64)
        for places, counts in zip(table["places"].to_pylist(), table["counts"].to_pylist()):
            n[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<i8")
        at = n.nonzero()[0]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        row = [table["metric"][0].as_py(), table["chunk"][0].as_py(), len(at), int(n.sum()), at.astype("<u2").tobytes(), n[at].astype("<i8").tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(row, types)], ["metric", "chunk", "size", "n", "places", "counts"])

    # pages of zeros that nothing is added to take no memory
    start = lambda: ([np.zeros(DENSE, np.int64), np.zeros(DENSE, np.int64)], ([], []), [[0, np.empty(HELD, np.int64)] for _ in range(2)])
    c = fold_pairs(vectors, key, vec, start, count, counted, "metric int, chunk long, places binary, counts binary")
    c = c.groupBy("metric", "chunk").applyInArrow(folded, "metric int, chunk long, size long, n long, places binary, counts binary").persist()
    try:
        sizes = {r["metric"]: (r["size"], r["n"]) for r in c.groupBy("metric").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()}
        few = all(size <= RANKED for size, _ in sizes.values())
        rows = c.sort("metric", "chunk").collect() if few else []
    finally:
        c.unpersist()
    found = []
    for m in sorted(sizes) if few else []:
        of = [(r["chunk"] << CHUNK_BITS, np.frombuffer(r["places"], "<u2"), np.frombuffer(r["counts"], "<i8")) for r in rows if r["metric"] == m]
        found.append((np.concatenate([first + at.astype(np.int64) for first, at, _ in of]), np.concatenate([n for _, _, n in of])))
    if not few:
        m = pairwise_metrics(vectors, key, vec).select(F.round("cosine_similarity", digits).alias("x"), F.round("euclidean_distance", digits).alias("y"))
        return stats.spearman(m, "x", "y")
    total, tables, spread = sizes[0][1] if sizes else 0, [], 1.0
    for values, n in found:
        ranks = (np.cumsum(n) - (n - 1) / 2.0 - (total + 1) / 2.0) / total  # from their mean, as shares
        spread *= float((ranks * ranks) @ n)
        tables.append((values, ranks))
    rho = None
    if tables and spread > 0:
        sent = spark.sparkContext.broadcast(tables)

        def ready():
            state = [0.0]
            for values, ranks in sent.value:
                if values[-1] - values[0] < DENSE:
                    dense = np.zeros(values[-1] - values[0] + 1)
                    dense[values - values[0]] = ranks
                    state.append((lambda v, d=dense, first=values[0]: np.take(d, np.subtract(v, first, out=v), mode="clip")))
                else:
                    state.append((lambda v, values=values, ranks=ranks: ranks[np.searchsorted(values, v)]))
            return state

        def product(state, cos, away):
            state[0] += float(state[1](_whole(cos, scale)) @ state[2](_whole(away(), scale)))
            return state

        p = fold_pairs(vectors, key, vec, ready, product, lambda state: [[[state[0]]]], "s double")
        rho = p.agg(F.sum("s")).first()[0] / spread**0.5
        sent.unpersist()
    return spark.createDataFrame([(total, rho)], "n long, rho double")


def _least(d, k):
    """(row, column) of the ``k`` least of each row, rounded to nine places, ties to the lesser column; none that is not finite."""
    import numpy as np

    r = np.round(d, 9)
    edge = np.partition(r, min(k, r.shape[1]) - 1, axis=1)[:, min(k, r.shape[1]) - 1]
    i, j = np.nonzero((r <= edge[:, None]) & np.isfinite(r))
    order = np.lexsort((j, r[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(d)))[i]
    return i[rank < k], j[rank < k]


class _Best:
    """The ``k`` least distances of each row so far. Columns come in order, so one that comes later never wins a tie."""

    def __init__(self, rows: int, k: int):
        import numpy as np

        self.k, self.d, self.j = k, np.full((rows, k), np.inf), np.zeros((rows, k), int)
        self.edge = np.full(rows, np.inf)

    def add(self, at: int, d, first: int) -> None:
        import numpy as np

        edge = self.edge[at: at + len(d)]
        if np.isinf(edge).any():
            i, j = _least(d, self.k)
        else:
            i, j = np.nonzero(d < (edge - 4e-10)[:, None])
            less = np.round(d[i, j], 9) < edge[i]
            i, j = i[less], j[less]
            if len(i) > 8 * self.k * len(d):
                at_most = np.full(d.shape, np.inf)
                at_most[i, j] = d[i, j]
                i, j = _least(at_most, self.k)
        if not len(i):
            return
        rows = np.unique(i)
        row = np.concatenate([np.repeat(rows, self.k), i])
        away = np.concatenate([self.d[at + rows].ravel(), d[i, j]])
        col = np.concatenate([self.j[at + rows].ravel(), first + j])
        # what is empty so far stands behind all columns
        order = np.lexsort((col, np.round(away, 9), row))
        row, away, col = row[order], away[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, rows)[np.searchsorted(rows, row)]
        keep = rank < self.k
        self.d[at + rows], self.j[at + rows] = away[keep].reshape(-1, self.k), col[keep].reshape(-1, self.k)
        self.edge[at + rows] = np.round(self.d[at + rows, -1], 9)

    def rows(self):
        import numpy as np

        i, r = np.nonzero(np.isfinite(self.d))
        return i, self.j[i, r], self.d[i, r]


def nearest(vectors: DataFrame, key: str, vec: str, k: int, metric: str = "euclidean", blocks: int | None = None) -> DataFrame:
    """key, rank, neighbor, distance: the ``k`` nearest others; ties to the lesser key. Cosine distance is one less the similarity.

    A cell gives each row the ``k`` nearest of the other block, both ways from one product, so what is ranked at the end grows with the rows, not with the pairs.
    """
    def best(k1, x, k2, y, same):
        import numpy as np

        here, there = _Best(len(k1), k), _Best(0 if same else len(k2), k)
        for i in range(0, len(k1), TILE_ROWS):
            for j in range(0, len(k2), TILE_ROWS):
                a, b = x[i: i + TILE_ROWS], y[j: j + TILE_ROWS]
                d = 1.0 - _cosines(a, b) if metric == "cosine" else _distances(a, b)
                if same:
                    d[k1[i: i + TILE_ROWS, None] == k2[None, j: j + TILE_ROWS]] = np.inf
                here.add(i, d, j)
                if not same:
                    there.add(j, d.T, i)
        i, j, d = here.rows()
        yield k1[i], k2[j], d
        if not same:
            j, i, d = there.rows()
            yield k2[j], k1[i], d

    d = _over_cells(vectors, key, vec, blocks, best, "k_1 {key}, k_2 {key}, distance double")
    w = Window.partitionBy("k_1").orderBy(F.round("distance", 9), "k_2")
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return d.select(F.col("k_1").alias(key), "rank", F.col("k_2").alias("neighbor"), "distance")


def mean_similarity(vectors: DataFrame, key: str, vec: str, blocks: int | None = None) -> DataFrame:
    """n, average_similarity over all unordered pairs; null for fewer than two rows."""
    p = pairwise_metrics(vectors, key, vec, blocks)
    return p.agg(F.count("*").alias("n_pairs"), F.avg("cosine_similarity").alias("average_similarity"))


def group_similarity(vectors: DataFrame, key: str, vec: str, by: str) -> DataFrame:
    """a, b, n, s: unordered pairs of rows of groups a and b that have different keys, and the sum of their cosine similarities; each two groups once, the lesser first, null least.

    Without pairs: the sum over two groups is the product of the sums of their unit vectors, less what rows of one key add. Zero vectors count as such. Rows without a key or a
    vector take no part. What is sent grows with the rows, the result with the square of the groups.
    """
    u = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(by).alias("by"), V.unit(V.doubles(F.col(vec))).alias("u"))

    def sums(rows, *keys):
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(V.dot(F.col("u"), F.col("u"))).alias("q"))
        parts = rows.select(*keys, F.posexplode("u").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
        parts = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("u"))
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
        return sizes.alias("x").join(parts.alias("y"), same).select(*[F.col(f"x.{k}").alias(k) for k in keys], "n", "q", "u")

    def met(groups, *shared):
        first = F.col("x.by").isNull() | (F.col("x.by") <= F.col("y.by"))
        both = groups.alias("x").join(groups.alias("y"), [*[F.col(f"x.{k}") == F.col(f"y.{k}") for k in shared], first])
        own = F.col("x.by").eqNullSafe(F.col("y.by"))
        n, s = F.col("x.n") * F.col("y.n"), V.dot(F.col("x.u"), F.col("y.u"))
        both = both.select(F.col("x.by").alias("a"), F.col("y.by").alias("b"), F.when(own, (n - F.col("x.n")) / 2).otherwise(n).cast("long").alias("n"), F.when(own, (s - F.col("x.q")) / 2).otherwise(s).alias("s"))
        return both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    again = u.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    less = met(sums(u.join(again, "key", "left_semi"), "key", "by"), "key")
    all_pairs = met(sums(u, "by")).unionByName(less.select("a", "b", (-F.col("n")).alias("n"), (-F.col("s")).alias("s")))
    return all_pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")


def mean_similarity_closed(vectors: DataFrame, vec: str) -> DataFrame:
    """The same without pairs, in one pass: (|sum of unit vectors|^2 - n) / (n (n - 1)), zero vectors counted as such."""
    u = vectors.select(F.posexplode(V.unit(V.doubles(F.col(vec)))).alias("i", "x"))
    s = u.groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = vectors.agg(F.count("*").alias("n"), F.count_if(V.norm(V.doubles(F.col(vec))) > 0).alias("m"))
    return s.join(n).select("n", F.when(F.col("n") > 1, (F.col("q") - F.col("m")) / (F.col("n") * (F.col("n") - 1))).alias("average_similarity"))


def baseline(terms: DataFrame, model: DataFrame, key: str, vec: str, mode: str = "terms", n: int = 300, seed: int = 42) -> DataFrame:
    """n, average_similarity of a sample of ``n`` rows: what a similarity is measured against.

    ``mode`` says of what: the vectors of the terms at hand, or all words that the model knows (``model_vocab``). Keys of either are unique; null vectors count as zero.
    """
    if mode not in ("terms", "model_vocab"):
        raise ValueError(f"mode must be terms or model_vocab, not {mode}")
    population = terms if mode == "terms" else model
    sample = population.join(F.broadcast(bottom_k(population, key, n, seed)), key, "left_semi")
    return mean_similarity_closed(sample, vec)
