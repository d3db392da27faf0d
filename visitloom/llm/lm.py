"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting: each task folds its bigrams to (context, word, count) runs and deals them by the context's hash into
buckets; contexts so frequent that their bucket would stand out are dealt by the whole
bigram. A bucket's task adds up the runs, writes the bucket's sorted array of bigram
hashes with their counts to the shared folder, and passes on what it has of each word: as a context
(total, how many bigrams occur once, twice, more) and as a word (distinct contexts). These are
added up by word in the same way and written as sorted arrays. Scoring: workers map the arrays into
memory and look up whole batches of sorted distinct hashes at a time.

Nothing of the model passes through the driver but a row of sums for each array. The shared
folder must be mounted on all machines, since files are mapped; files are written
under another name and renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import functools
import os
import pickle
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers, scratch_dir
from .minhash import _FOLD, _mix, _words

#: Ids of the start of a text (only a context) and of its end (a token).
BOS, EOS = np.uint64(1), np.uint64(2)
#: Tokens that a task folds at once, and bigrams aimed at in a bucket.
FOLD_TOKENS, BUCKET_TOKENS = 4_000_000, 4_000_000
#: One text in so many is read to plan the buckets; results do not depend on it.
PLAN_EVERY = 50


def token_ids(text: str | None) -> np.ndarray:
    """56-bit hashes of the words, then the end."""
    ws = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    ids = np.empty(len(ws) + 1, np.uint64)
    ids[:-1] = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws)) >> np.uint64(8)
    ids[-1] = EOS
    return ids


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(h * np.uint64(0x9E3779B97F4A7C15)) + w)


def bucket_of(h: np.ndarray, key: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    """The bucket of a bigram: by its context, or by itself if the context is hot."""
    spot = np.searchsorted(hot, h)
    is_hot = hot[np.minimum(spot, len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
    return np.where(is_hot, key % np.uint64(n), _mix(h) % np.uint64(n)).astype(np.int64)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def _fold(h, w, c=None):
    """Distinct (h, w), sorted, with their counts."""
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    at = _starts(h, w)
    counts = np.diff(np.append(at, len(h))) if c is None else np.add.reduceat(c[order], at) if len(at) else np.empty(0, np.int64)
    return h[at], w[at], counts.astype(np.int64)


def _pack(h, w, c) -> bytes:
    """Runs of one context: its id once, the words' 56 bits, counts in one byte where they fit."""
    at = _starts(h)
    big = np.nonzero(c > 254)[0]
    return pickle.dumps((
        h[at], np.diff(np.append(at, len(h))).astype(np.uint32), w.astype(np.uint32), (w >> np.uint64(32)).astype(np.uint16), (w >> np.uint64(48)).astype(np.uint8),
        np.minimum(c, 255).astype(np.uint8), big.astype(np.uint32), c[big]), protocol=5)


def _unpack(blob: bytes):
    h, runs, lo, mid, hi, c, big, more = pickle.loads(blob)
    c = c.astype(np.int64)
    c[big] = more
    w = lo.astype(np.uint64) | mid.astype(np.uint64) << np.uint64(32) | hi.astype(np.uint64) << np.uint64(48)
    return np.repeat(h, runs), w, c


def _save(path: str, array: np.ndarray) -> None:
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "wb") as f:
        np.save(f, array)
    os.replace(tmp, path)


def _counter(buckets: int, hot: np.ndarray):
    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            ids = np.concatenate(held)
            first = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
            h = np.concatenate([[BOS], ids[:-1]])
            h[first] = BOS
            h, w, c = _fold(h, ids)
            b = bucket_of(h, pair_hash(h, w), buckets, hot)
            order = np.argsort(b, kind="stable")
            h, w, c, b = h[order], w[order], c[order], b[order]
            cuts = np.append(_starts(b), len(b))
            rows = [(int(b[i]), _pack(h[i:j], w[i:j], c[i:j])) for i, j in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "runs"])

        for b in batches:
            for t in b.column(0):
                held.append(token_ids(t.as_py()))
                n += len(held[-1])
                if n >= FOLD_TOKENS:
                    yield flush()
                    held.clear()
                    n = 0
        if held:
            yield flush()

    return run


_PARTS = ("total", "once", "twice", "more", "c3", "c4", "before")


def _writer(folder: str, vocab_buckets: int):
    """Adds up a bucket, writes its array, gives what it has of each word."""
    def run(key, table):
        import pyarrow as pa

        h, w, c = _fold(*(np.concatenate(x) for x in zip(*(_unpack(r.as_py()) for r in table.column("runs")))))
        hashes = pair_hash(h, w)
        order = np.argsort(hashes)
        big = np.nonzero(c[order] > 254)[0]
        name = f"{folder}/pairs-{key[0].as_py()}"
        _save(f"{name}.keys.npy", hashes[order])
        _save(f"{name}.counts.npy", np.minimum(c[order], 255).astype(np.uint8))
        _save(f"{name}.big.npy", np.stack([big, c[order][big]]).astype(np.int64))
        at = _starts(h)
        add = lambda x: np.add.reduceat(x.astype(np.int64), at)
        ctx = np.stack([add(c), add(c == 1), add(c == 2), add(c > 2), add(c == 3), add(c == 4), np.zeros(len(at), np.int64)], axis=1)
        words, before = np.unique(w, return_counts=True)
        ids = np.concatenate([h[at], words])
        values = np.concatenate([ctx, np.zeros((len(words), 7), np.int64)])
        values[len(at):, 6] = before
        ids, values = _sum_by(ids, values)
        b = (_mix(ids) % np.uint64(vocab_buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        cuts = np.append(_starts(b[order]), len(b))
        rows = [(int(b[order[i]]), pickle.dumps((ids[order[i:j]], [_narrow(x) for x in values[order[i:j]].T]), protocol=5)) for i, j in zip(cuts[:-1], cuts[1:])]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "words": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _sum_by(ids, values):
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    at = _starts(ids)
    return ids[at], np.add.reduceat(values, at, axis=0)


def _vocabulary(folder: str):
    """Adds up the words of a bucket, writes their arrays, gives the sums that discounts and totals need."""
    def run(key, table):
        import pyarrow as pa

        parts = [pickle.loads(r.as_py()) for r in table.column("words")]
        ids, v = _sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([np.stack([x.astype(np.int64) for x in p[1]], axis=1) for p in parts]))
        name = f"{folder}/words-{key[0].as_py()}"
        _save(f"{name}.keys.npy", ids)
        _save(f"{name}.values.npy", np.stack([v[:, 0], v[:, 1], v[:, 2], v[:, 3], v[:, 6]], axis=1).astype(np.uint32 if v.max(initial=0) < 2**32 else np.int64))
        before = v[:, 6]
        texts = int(v[ids == BOS, 0].sum())
        words = (ids != BOS) & (ids != EOS)
        row = [int(v[words, 0].sum()) + texts, int(words.sum()) + (texts > 0), texts, *(int(v[:, k].sum()) for k in (1, 2, 4, 5)),
               int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum())]
        return pa.table({n: pa.array([x], pa.int64()) for n, x in zip(_SUMS, row)})

    return run


_SUMS = ("tokens", "distinct", "texts", "n1", "n2", "n3", "n4", "pairs", "m1", "m2", "m3", "m4", "more")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; fixed ones where the counts of counts are too few to tell."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


class Model:
    """The arrays of one folder, mapped into memory."""

    def __init__(self, folder: str, buckets: int, vocab_buckets: int, hot: tuple, sums: tuple):
        self.folder, self.buckets, self.vocab_buckets = folder, buckets, vocab_buckets
        self.hot, self.s = np.array(hot, np.uint64), dict(zip(_SUMS, sums))
        s = self.s
        self.d2, self.d1 = discounts(s["n1"], s["n2"], s["n3"], s["n4"]), discounts(s["m1"], s["m2"], s["m3"], s["m4"])
        self.total = max(s["pairs"], 1)
        self.left = float(self.d1[1] * s["m1"] + self.d1[2] * s["m2"] + self.d1[3] * s["more"]) / self.total if s["pairs"] else 1.0
        self._files: dict[str, np.ndarray | None] = {}

    def _file(self, name: str):
        if name not in self._files:
            path = f"{self.folder}/{name}.npy"
            self._files[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self._files[name]

    def _find(self, kind: str, b: np.ndarray, key: np.ndarray):
        """(queries found, bucket, place) for each bucket that the queries name."""
        order = np.lexsort((key, b))
        cuts = np.append(_starts(b[order]), len(b))
        for i, j in zip(cuts[:-1], cuts[1:]):
            ask, bucket = order[i:j], int(b[order[i]])
            keys = self._file(f"{kind}-{bucket}.keys")
            if keys is not None and len(keys):
                at = np.searchsorted(keys, key[ask])
                ok = at < len(keys)
                ok[ok] = keys[at[ok]] == key[ask][ok]
                yield ask[ok], bucket, at[ok]

    def words(self, ids: np.ndarray) -> np.ndarray:
        """total, once, twice, more, before of distinct ids; zeros if unseen."""
        out = np.zeros((len(ids), 5), np.int64)
        for ask, bucket, at in self._find("words", (_mix(ids) % np.uint64(self.vocab_buckets)).astype(np.int64), ids):
            out[ask] = self._file(f"words-{bucket}.values")[at]
        return out

    def pairs(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of bigrams; 0 if unseen."""
        key, back = np.unique(pair_hash(h, w), return_inverse=True)
        first = np.empty(len(key), np.int64)
        first[back] = np.arange(len(h))
        out = np.zeros(len(key), np.int64)
        for ask, bucket, at in self._find("pairs", bucket_of(h[first], key, self.buckets, self.hot), key):
            c = self._file(f"pairs-{bucket}.counts")[at].astype(np.int64)
            if (c == 255).any():
                where, more = self._file(f"pairs-{bucket}.big")
                full = np.nonzero(c == 255)[0]
                c[full] = more[np.searchsorted(where, at[full])]
            out[ask] = c
        return out[back]

    def score(self, texts: list):
        """(n_tokens, n_known, base score, score) of each text."""
        ids = [token_ids(t) for t in texts]
        n = np.array([len(x) for x in ids])
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        w = np.concatenate(ids)
        h = np.concatenate([[BOS], w[:-1]])
        h[first] = BOS
        known, back = np.unique(np.concatenate([w, [BOS]]), return_inverse=True)
        v = self.words(known)
        at_w = back[:-1]
        at_h = np.concatenate([back[-1:], at_w[:-1]])
        at_h[first] = back[-1]
        c = v[:, 0].copy()
        c[known == EOS] = self.s["texts"]
        c = c[at_w]
        base = np.log10((c + 0.1) / (self.s["tokens"] + 0.1 * (self.s["distinct"] + 1)))
        before = v[:, 4]
        p1 = np.maximum(before - self.d1[np.minimum(before, 3)], 0.0) / self.total + self.left / (self.s["distinct"] + 1)
        total = v[:, 0].astype(float)
        spare = np.where(total > 0, (v[:, 1] * self.d2[1] + v[:, 2] * self.d2[2] + v[:, 3] * self.d2[3]) / np.maximum(total, 1), 1.0)
        pair = self.pairs(h, w)
        p = np.maximum(pair - self.d2[np.minimum(pair, 3)], 0.0) / np.maximum(total[at_h], 1) + spare[at_h] * p1[at_w]
        add = lambda x: np.add.reduceat(x, first)
        return n, add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


@functools.lru_cache(maxsize=2)
def _model(*key) -> Model:
    return Model(*key)


def _mounted(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be a mounted folder, not {path}")
    return url.path


def _plan(texts: DataFrame) -> tuple[int, int, np.ndarray]:
    """Buckets of bigrams and of words, and the contexts to deal out, from one text in PLAN_EVERY."""
    def run(batches):
        import pyarrow as pa

        ids = [token_ids(t.as_py()) for b in batches for t in b.column(0)]
        if ids:
            u, c = np.unique(np.concatenate([*ids, np.full(len(ids), BOS)]), return_counts=True)
            often = c * 5000 >= c.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(u[often], 0).view(np.int64)), pa.array(np.append(c[often], c.sum()))], ["id", "n"])

    rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(PLAN_EVERY)) == 0).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = (rows.where("id = 0").agg(F.sum("n")).first()[0] or 0) * PLAN_EVERY
    buckets = max(12, -(-total // BUCKET_TOKENS))
    hot = rows.where((F.col("id") != 0) & (F.col("n") * PLAN_EVERY * 4 * buckets > F.lit(total))).orderBy(F.desc("n")).limit(5000).collect()
    return buckets, max(4, buckets // 4), np.sort(np.array([r["id"] for r in hot], np.int64).view(np.uint64))


def score_texts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train (boolean), n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    The model learns from the rows where ``train`` is true (null: not). Tokens are the words between ASCII white space,
    A-Z lower-cased, and one end; a null or empty text is one end. base_score is the unigram log10 probability with 0.1
    added to each count, score the model's; n_known counts tokens that training has. Without training rows all
    counts are 0 and every token has the probability of an unseen one. Repeated rows count as often as they occur. Other columns
    are dropped; an empty table gives an empty result. Very long texts are scored whole. Words are told apart by hashes of 56 bits and bigrams by 64: among a billion
    distinct words about seven pairs count as one word. Where a training set has no count of one, two, three or four, fixed
    discounts (0.5, 0.75, 0.9) take the place of estimated ones.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    learn = d.where("train").select("text")
    buckets, vocab_buckets, hot = _plan(learn)
    folder = _mounted(scratch_dir(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    runs = learn.mapInArrow(_counter(buckets, hot), "bucket long, runs binary").repartition(buckets, "bucket")  # a task's buckets stay as large as the input grows
    counted = runs.groupBy("bucket").applyInArrow(_writer(folder, vocab_buckets), "bucket long, words binary")
    sums = counted.groupBy("bucket").applyInArrow(_vocabulary(folder), ", ".join(f"{n} long" for n in _SUMS)).agg(*[F.sum(n) for n in _SUMS]).first()
    sums = tuple(x or 0 for x in sums)
    key = (folder, buckets, vocab_buckets, tuple(int(x) for x in hot), sums)

    def run(batches):
        import pyarrow as pa

        m = _model(*key)
        for b in batches:
            if b.num_rows:
                n, known, base, score = m.score([t.as_py() for t in b.column(2)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), sums[0]), pa.int64()), pa.array(base), pa.array(score)],
                    ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return d.mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
