"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the deviation (norm of what is left
about the mean) are kept. For a segment of length m, ``m * mean_a * mean_b + dev_a * dev_b``
bounds the inner product from above (and so the distance from below). A query's floor is the k-th score it reaches among a
small sample of the candidates, so no candidate below it can be in the result. Bounds are taken coarse to
fine; pairs whose bound is under the floor are dropped, and only survivors get exact scores, which raise the floor for the
candidates behind them. Nothing is dropped that could be in the result.

Candidates are dealt into chunks by a hash of their id, queries are sent to every chunk in blocks, each
chunk gives its k best for each query and these are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare_workers

#: Most candidates that a task holds, and most queries that are sent to it.
CHUNK_ROWS, QUERY_ROWS = 131_072, 262_144
#: Candidates and queries that are compared at once.
BLOCK, QBLOCK = 8192, 128
#: Candidates that floors are taken from: one in so many, and at most this many.
SAMPLE_EVERY, SAMPLE_ROWS = 64, 4096
#: Above this share of survivors a whole block is computed, below it single pairs.
DENSE = 0.05


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the upper bounds: scaled means, then deviations."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    means = [p.mean(axis=1) for p in parts]
    devs = [np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means)]
    return np.stack([m * np.sqrt(p.shape[1]) for p, m in zip(parts, means)] + devs, axis=1)


class Chunk:
    """Candidates of one task, sorted by id, and the searches over them.

    ``pairs`` counts pairs of a query and a candidate that each stage was left with: all, behind each level, and those scored that reach the floor.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple[int, ...]):
        first = np.r_[True, ids[1:] != ids[:-1]]
        self.ids, self.x, self.k, self.levels = ids[first], vectors[first], k, levels
        self.most = float(np.abs(self.x).max(initial=0))
        # scaled to 1 so that bounds of any size stay finite
        self.unit = max(self.most, 1.0)
        self.features = [segment_features(self.x / self.unit, s) for s in levels]
        self.pairs = np.zeros(len(levels) + 2, np.int64)

    def search(self, qids: np.ndarray, q: np.ndarray, sample: tuple | None = None):
        """(query row, candidate row, score) of the k best of each query, ties to the smaller id; ``sample``: ids and vectors of some candidates of all chunks."""
        most = float(np.abs(q).max(initial=0))
        if sample is not None:
            most = max(most, float(np.abs(sample[1]).max(initial=0)))
        if most * max(self.most, most) * q.shape[1] >= 2.0**53:
            yield from self._slow(qids, q)
            return
        unit = max(most, 1.0)
        qf = [segment_features(q / unit, s) for s in self.levels]
        scale, slack = unit * self.unit, 1e-9 * unit * self.unit * max(1, q.shape[1])
        floor = floors(qids, q, sample, self.k)
        who, rows, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(self.ids), BLOCK):
            ids = self.ids[at: at + BLOCK]
            alive = self._bounded(qf, at, floor, scale, slack)
            spot = np.searchsorted(ids, qids)
            own = (spot < len(ids)) & (ids[np.minimum(spot, len(ids) - 1)] == qids)
            alive[np.nonzero(own)[0], spot[own]] = False
            i, j, score = self._exact(q, self.x[at: at + BLOCK], alive, floor)
            who, rows, best = np.concatenate([who, i]), np.concatenate([rows, at + j]), np.concatenate([best, score])
            order = np.lexsort((rows, -best, who))
            who, rows, best = who[order], rows[order], best[order]
            start = np.searchsorted(who, np.arange(len(q)))
            rank = np.arange(len(who)) - start[who]
            full = rank == self.k - 1
            floor[who[full]] = np.maximum(floor[who[full]], best[full])
            who, rows, best = (v[rank < self.k] for v in (who, rows, best))
        yield who, rows, best.astype(np.int64)

    def _bounded(self, qf, at, floor, scale, slack) -> np.ndarray:
        alive = None
        for level, (f, c) in enumerate(zip(qf, self.features), 1):
            c = c[at: at + BLOCK]
            if alive is None or alive.mean() > DENSE:
                ok = (f @ c.T) * scale + slack >= floor[:, None]
                self.pairs[0] += 0 if alive is not None else ok.size
                alive = ok if alive is None else alive & ok
            else:
                i, j = np.nonzero(alive)
                bound = np.einsum("ij,ij->i", f[i], c[j]) * scale + slack
                off = bound < floor[i]
                alive[i[off], j[off]] = False
            self.pairs[level] += np.count_nonzero(alive)
        return alive

    def _exact(self, q, x, alive, floor):
        """(query row, candidate row, score) of the survivors that reach the floor."""
        if alive.mean() > DENSE:
            scores = q @ x.T
            i, j = np.nonzero(alive & (scores >= floor[:, None]))
            score = scores[i, j]
        else:
            i, j = np.nonzero(alive)
            score = np.einsum("ij,ij->i", q[i], x[j])
            up = score >= floor[i]
            i, j, score = i[up], j[up], score[up]
        self.pairs[-1] += len(i)
        return i, j, score

    def _slow(self, qids, q):
        """Whole numbers too large for doubles: Python integers, one query at a time."""
        x = [[int(v) for v in row] for row in self.x]
        for i, (qid, row) in enumerate(zip(qids, q)):
            row = [int(v) for v in row]
            s = [(-sum(a * b for a, b in zip(row, c)), j) for j, c in enumerate(x) if self.ids[j] != qid]
            top = sorted(s)[: self.k]
            far = 2**63 - 1
            yield np.full(len(top), i), np.array([j for _, j in top], np.int64), np.array([max(-far, min(far, -v)) for v, _ in top], np.int64)


def floors(qids: np.ndarray, q: np.ndarray, sample: tuple | None, k: int) -> np.ndarray:
    """For each query the k-th score among the sample's other rows: no candidate below it is among the k best of all."""
    if sample is None or len(sample[0]) <= k:
        return np.full(len(q), -np.inf)
    scores = q @ sample[1].T
    scores[qids[:, None] == sample[0][None, :]] = -np.inf
    return np.partition(scores, -k, axis=1)[:, -k].copy()


def top_k(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024,
          levels: tuple[int, ...] = (2, 8, 16)) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products, ties to the smaller vec_id.

    Components are ``floor(scale * x)``. ``is_query`` is a condition on the rows of ``vectors``; candidates are all rows but those
    with the query's id. Null ids and vectors that are null, empty or hold a null or non-finite component take no
    part. Vectors are compared with those of their own length only. Rows that repeat an id count once, with the least
    of their vectors. Fewer candidates than k: all of them. Scores beyond 64 bits are
    ordered exactly and returned as the nearest long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    x = F.col(embedding)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    v = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & good).select(
        F.col(vec_id).cast("bigint").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("x"), is_query.alias("q"))
    n, nq = v.agg(F.count("*"), F.count_if("q")).first()
    chunks = -(-n // min(CHUNK_ROWS, max(2048, -(-n // (3 * spark.sparkContext.defaultParallelism))))) or 1
    groups = -(-nq // QUERY_ROWS) or 1
    # the sample holds candidates only: of an id the least vector, as below
    some = v.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, n // SAMPLE_EVERY))
    seen = v.join(F.broadcast(some), "id", "left_semi").groupBy("id", F.size("x").alias("n")).agg(F.min("x").alias("x")).collect()
    samples: dict[int, tuple] = {}
    for width in {len(r["x"]) for r in seen}:
        of = {r["id"]: r["x"] for r in seen if len(r["x"]) == width}
        samples[width] = np.array(list(of), np.int64), np.floor(np.array(list(of.values()), float) * float(scale))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cand = v.select("id", "x", F.lit(0).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), every(groups).alias("grp"))
    ask = v.where("q").groupBy("id", F.size("x").alias("n")).agg(F.min("x").alias("x")).select(
        "id", "x", F.lit(1).alias("kind"), every(chunks).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"))
    dealt = cand.unionByName(ask).withColumn("n", F.size("x")).repartition(max(chunks * groups, 1), "n", "chunk", "grp").sortWithinPartitions("n", "chunk", "grp", "kind", "id", "x")

    def search(batches):
        import pyarrow as pa

        key, ids, xs, chunk = None, [], [], None
        for b in batches:
            t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "chunk", "grp", "kind", "id")}
            flat, ends = b.column("x").flatten().to_numpy(zero_copy_only=False), np.cumsum(t["n"])
            mark = np.stack([t["n"], t["chunk"], t["grp"], t["kind"]], axis=1)
            cuts = np.r_[0, 1 + np.nonzero((mark[1:] != mark[:-1]).any(axis=1))[0], len(mark)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                width = int(mark[lo, 0])
                part = np.floor(flat[ends[lo] - width: ends[hi - 1]].reshape(-1, width) * float(scale))
                if tuple(mark[lo, :3]) != key:
                    key, ids, xs, chunk = tuple(mark[lo, :3]), [], [], None
                if mark[lo, 3] == 0:
                    ids.append(t["id"][lo:hi])
                    xs.append(part)
                    continue
                if not ids:
                    continue
                if chunk is None:
                    chunk = Chunk(np.concatenate(ids), np.concatenate(xs), k, levels)
                    xs = [None]
                for s in range(0, hi - lo, QBLOCK):
                    qids = t["id"][lo + s: min(hi, lo + s + QBLOCK)]
                    for i, j, score in chunk.search(qids, part[s: s + QBLOCK], samples.get(width)):
                        yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(chunk.ids[j]), pa.array(score)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
