"""Whitening of embeddings: one streaming pass for their moments, an eigen-solve, a projection.

Each partition keeps a mean and a scatter matrix and brings them up to date with every vector by Welford's rank-one update,
``scatter += (k - 1) / k * d d'`` with ``d`` the vector less the mean of those before it; the updates of a block of vectors are applied
as one matrix product. Partitions are merged by the parallel update formula, a bounded number at a time. The covariance is brought to
tridiagonal form by reflections and to diagonal form by implicitly shifted QR steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare_workers, written

#: Vectors whose updates are applied at once, and partial results that are merged by one task.
BLOCK, FAN_IN = 256, 32
#: Whole numbers are kept within this: components beyond it are taken as it.
FAR = 2**62
RESULTS = ("n", "deviation", "whitened", "explained", "identity_error")
MOMENTS = "list int, size int, n long, high array<long>, low array<long>, mean array<double>, scatter binary, grp long"


class Moments:
    """Count, exact sums, mean and scatter matrix of vectors of one length."""

    def __init__(self, size: int):
        self.n, self.sums, self.mean, self.scatter = 0, [0] * size, np.zeros(size), np.zeros((size, size))

    def add(self, x: np.ndarray) -> None:
        """Vectors as rows, one rank-one update each."""
        for at in range(0, len(x), BLOCK):
            part = x[at: at + BLOCK]
            k = self.n + np.arange(1, len(part) + 1)[:, None]
            # the first vector stands for a mean that is not there yet
            about = self.mean if self.n else part[0].astype(float)
            away = part - about
            before = np.cumsum(away, axis=0) - away
            d = away - before / np.maximum(k - 1, 1)
            self.scatter += (d * ((k - 1) / k)).T @ d
            self.mean = about + away.sum(axis=0) / k[-1]
            self.n += len(part)
        if x.dtype == np.int64:
            # halves of 32 bits, so that no sum of a block overflows
            self.sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(self.sums, (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]

    def merge(self, other: "Moments") -> None:
        if not other.n:
            return
        n, d = self.n + other.n, other.mean - self.mean
        self.scatter += other.scatter + np.outer(d, d) * (self.n * (other.n / n))
        self.mean = self.mean + d * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n = n

    def row(self, key: int, grp: int) -> dict:
        return {"list": key, "size": len(self.mean), "n": self.n, "high": [s >> 62 for s in self.sums], "low": [s & (2**62 - 1) for s in self.sums],
                "mean": self.mean.tolist(), "scatter": self.scatter.tobytes(), "grp": grp}

    @classmethod
    def of(cls, r: dict) -> "Moments":
        m = cls(r["size"])
        m.n, m.mean = r["n"], np.array(r["mean"], float)
        m.sums = [(h << 62) + w for h, w in zip(r["high"], r["low"])]
        m.scatter = np.frombuffer(r["scatter"]).reshape(r["size"], r["size"]).copy()
        return m


def _schema():
    import pyarrow as pa

    return pa.schema([("list", pa.int32()), ("size", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())),
                      ("mean", pa.list_(pa.float64())), ("scatter", pa.binary()), ("grp", pa.int64())])


def matrices(key, column):
    """(key, rows, matrix) for each key of two Arrow columns; the lists of a key have one length."""
    key = key.to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    for k in np.unique(key):
        rows = np.nonzero(key == k)[0]
        yield int(k), rows, flat[ends[rows][:, None] + np.arange(ends[rows[0] + 1] - ends[rows[0]])]


def _partials(batches, whole):
    """One row of moments for each list of vectors in a partition."""
    import pyarrow as pa
    from pyspark import TaskContext

    held: dict[int, Moments] = {}
    for b in batches:
        for k, _, x in matrices(b.column(0), b.column(1)):
            held.setdefault(k, Moments(x.shape[1])).add(whole(x))
    grp = TaskContext.get().partitionId() // FAN_IN
    yield pa.RecordBatch.from_pylist([m.row(k, grp) for k, m in held.items()], _schema())


def _total(rows: list[dict]) -> Moments:
    """Moments of several partial results, in an order of their own."""
    first, *rest = [Moments.of(r) for r in sorted(rows, key=lambda r: (r["n"], r["mean"]))]
    for m in rest:
        first.merge(m)
    return first


def _merged(table):
    import pyarrow as pa

    rows = table.to_pylist()
    return pa.Table.from_pylist([_total(rows).row(rows[0]["list"], rows[0]["grp"] // FAN_IN)], _schema())


def moments(vectors: DataFrame, whole=np.asarray) -> dict[int, Moments]:
    """Moments of each list of ``vectors`` (list: int, x: array<double>), after ``whole`` was applied to them.

    Neither a task nor the driver merges more than ``FAN_IN`` partial results of a list.
    """
    prepare_workers(vectors.sparkSession)
    parts = written(vectors.select("list", "x").mapInArrow(lambda b: _partials(b, whole), MOMENTS), "moments")
    while parts.agg(F.max("grp")).first()[0]:
        parts = written(parts.groupBy("list", "grp").applyInArrow(_merged, MOMENTS), "moments")
    of: dict[int, list[dict]] = {}
    for r in parts.collect():
        of.setdefault(r["list"], []).append(r.asDict())
    return {k: _total(rows) for k, rows in of.items()}


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, q) with ``q' a q`` tridiagonal, by Householder reflections."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        scale = np.abs(v).max()
        if scale == 0:
            continue
        v /= scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1:, k:] -= 2 * np.outer(v, v @ a[k + 1:, k:])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns of a symmetric matrix, the largest entry of each positive.

    Symmetric QR steps with Wilkinson's shift on the tridiagonal form; each step chases the bulge down by plane rotations.
    """
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    unit = np.abs(a).max() or 1.0
    d, e, q = tridiagonal(a / unit)
    qt, eps = np.ascontiguousarray(q.T), np.finfo(float).eps
    end, turns = len(d) - 1, 0
    while end > 0:
        small = np.abs(e[:end]) <= eps * (np.abs(d[:end]) + np.abs(d[1: end + 1]))
        e[:end][small] = 0.0
        if e[end - 1] == 0:
            end, turns = end - 1, 0
            continue
        start = end - 1
        while start > 0 and e[start - 1] != 0:
            start -= 1
        turns += 1
        if turns > 200:
            raise ArithmeticError("the QR steps do not settle")
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            qt[k], qt[k + 1] = c * qt[k] + s * qt[k + 1], c * qt[k + 1] - s * qt[k]
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
    order = np.argsort(-d, kind="stable")
    vecs = qt[order]
    flip = vecs[np.arange(len(vecs)), np.abs(vecs).argmax(axis=1)] < 0
    vecs[flip] *= -1
    return d[order] * unit, vecs.T


class Whitener:
    """Projection on the leading components of one fit list, each scaled to variance 1."""

    def __init__(self, m: Moments, components: int):
        self.n, self.sums = m.n, m.sums
        v = m.scatter / m.n
        values, vecs = eigen(v)
        trace = float(np.trace(v))
        # what rounding alone leaves has no direction
        self.rank = int((values > max(trace, 0.0) * len(values) * np.finfo(float).eps).sum())
        self.k = min(components, len(values))
        self.explained = [float(x) / trace if trace > 0 else None for x in values[: self.k]]
        live = min(self.k, self.rank)
        self.axes = vecs[:, :live] / np.sqrt(values[:live])
        self.error: float | None = None

    def away(self, x: np.ndarray) -> np.ndarray:
        """n x - S of each row, in whole numbers: 64 bits where they and their squares hold them, else as long as needed."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(x).max(initial=0))
        if most * most * max(1, x.shape[1]) < 2**63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def apply(self, x: np.ndarray):
        """Deviation and whitened vector of each row; components without variance have none."""
        d = self.away(x)
        white = (d / self.n).astype(float) @ self.axes
        return (d * d).sum(axis=1), white


def whole_numbers(scale: int, shift: int):
    """``floor(scale * c) + shift`` of every entry, as 64-bit numbers."""
    def turn(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            y = np.floor(x.astype(float) * scale)
        inside = np.abs(y) < FAR
        out = np.where(inside, y, 0).astype(np.int64) + shift
        return out if inside.all() else np.where(inside, out, np.where(y < 0, -FAR, FAR))
    return turn


def whiten(vectors: DataFrame, components: int = 8, embedding: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """The rows of ``vectors`` that can be whitened, with n, deviation, whitened, explained and identity_error.

    Entries become the whole numbers ``floor(scale * c) + shift``. The fit list is all remaining rows; vectors of another length are a list of
    their own. deviation (decimal) is the exact sum of ``(n x - S)^2``, whitened the centred vector on the first ``components`` unit eigenvectors of the covariance (divisor n), by falling eigenvalue, each over the
    root of its eigenvalue; explained the eigenvalues' shares of the trace; identity_error, one value for a list, the largest entry of the whitened
    vectors' covariance less the identity, from a pass of its own over them.

    Rows whose vector is null or holds a null or non-finite entry go. Null and repeated ids and rows count like any other. An empty vector has no
    components; components without variance (also those of a list of one row or of equal rows) are null in whitened. Entries beyond 62 bits are taken as 2^62. The embedding and columns of the
    input with the names of the results are replaced, all others pass. An empty table gives an empty one.
    """
    prepare_workers(vectors.sparkSession)
    x = F.col(f"`{embedding}`")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fit = [F.size(x).alias("list"), F.transform(x, lambda c: c.cast("double")).alias("x")]
    rows, whole = vectors.where(good), whole_numbers(scale, shift)
    lists = {size: Whitener(m, components) for size, m in moments(rows.select(*fit), whole).items()}

    def project(batches):
        import pyarrow as pa

        for b in batches:
            white: list = [None] * b.num_rows
            for size, at, v in matrices(b.column(0), b.column(1)):
                for i, y in zip(at, lists[size].apply(whole(v))[1]):
                    white[i] = y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(white, pa.list_(pa.float64()))], ["list", "x"])

    for size, m in moments(rows.select(*fit).mapInArrow(project, "list int, x array<double>")).items():
        if len(m.mean):
            lists[size].error = float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max())

    def apply(batches):
        import pyarrow as pa

        for b in batches:
            n, dev, white, share, error = ([None] * b.num_rows for _ in RESULTS)
            for size, at, v in matrices(b.column(0), b.column(1)):
                w = lists[size]
                d, y = w.apply(whole(v))
                lost = [None] * (w.k - y.shape[1])
                for i, di, yi in zip(at, d.tolist(), y.tolist()):
                    n[i], dev[i], white[i], share[i], error[i] = w.n, str(di), yi + lost, w.explained, w.error
            doubles = pa.list_(pa.float64())
            out = [pa.array(n, pa.int64()), pa.array(dev, pa.string()), pa.array(white, doubles), pa.array(share, doubles), pa.array(error, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *out], [*b.schema.names[2:], *[f"r{i}" for i in range(len(out))]])

    kept = [f for f in vectors.schema.fields if f.name not in (*RESULTS, embedding)]
    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)])
    for i, kind in enumerate(("long", "string", "array<double>", "array<double>", "double")):
        kinds = kinds.add(f"r{i}", kind if "<" not in kind else T.ArrayType(T.DoubleType()))
    out = rows.select(*fit, *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)]).mapInArrow(apply, kinds)
    # a deviation of more than 38 digits has no decimal
    back = [F.col(f"r{i}").try_cast("decimal(38,0)").alias(c) if c == "deviation" else F.col(f"r{i}").alias(c) for i, c in enumerate(RESULTS)]
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], *back)
