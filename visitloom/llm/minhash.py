"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, exact checks.

Every document is hashed to its set of word shingles. One hash function deals the
set into bins; the least value of each bin is its signature. An empty bin borrows from a non-empty one
that a fixed random order of its own picks (optimal densification), so any two
documents borrow alike. Bands of the signature make buckets.

Documents with equal sets are one class from the start. Within a bucket, classes are
not paired with each other but with one pivot, so candidates grow with the members
of a bucket and not with their square. Candidates are confirmed on the full sets, links are
folded into components, and only buckets that still span several components get
further pivots. The few pairs that then share a bucket, lie in different components and are
untested are tested one by one: no pair that shares a bucket is left undecided.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, prepare_workers, written
from .components import connected_components

BINS, ROWS = 256, 7
BANDS = BINS // ROWS
#: Ids up to this many are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Members that one task checks against a copy of their pivot's set.
STRAND = 256
#: Words that a worker remembers the hash of.
REMEMBERED = 300_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; with fewer words, of all words as one."""
    ws = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))
    n = min(width, len(ws))
    with np.errstate(over="ignore"):
        z = np.full(len(ws) - n + 1, n, np.uint64)
        for k in range(n):
            z = _mix(z + h[k: len(h) - n + 1 + k])
    return np.unique(z)


@functools.lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For each bin, the place of every other bin in its own random order."""
    rng = np.random.default_rng(20_011)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


@functools.lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band (int64) of a sorted set of hashes."""
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    full, low = bins[first], hashes[first]
    at = np.full(BINS, -1)
    at[full] = np.arange(len(full))
    empty = np.nonzero(at < 0)[0]
    if len(empty):
        at[empty] = _orders()[empty][:, full].argmin(axis=1)
    with np.errstate(over="ignore"):
        sig = _mix(low[at[: BANDS * ROWS]]).reshape(BANDS, ROWS)
        keys = _mix((sig * _weights()).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64)


def _signatures(width: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            n, fp, keys, ends = [], [], [], [0]
            for t in b.column(1):
                s = shingle_set(t.as_py(), width)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    keys.append(bands(s))
                ends.append(ends[-1] + (BANDS if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "n_shingles", "fp", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            fp, sets = [], []
            for t in b.column(0):
                s = shingle_set(t.as_py(), width).tobytes()
                fp.append(xxhash.xxh3_128_digest(s))
                sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.binary())], ["fp", "hashes"])

    return run


def _check(batches):
    """Rows of one pivot: its set (kind 0), then the members' sets; gives the sizes of the intersections."""
    import pyarrow as pa

    pivot, held = None, None
    for b in batches:
        a, c, inter = [], [], []
        for p, kind, m, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
            s = np.frombuffer(s.as_buffer(), np.uint64)
            if kind == 0:
                pivot, held = p, s
            elif p == pivot:
                at = np.searchsorted(held, s)
                inter.append(int((held[np.minimum(at, len(held) - 1)] == s).sum()))
                a.append(p)
                c.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary()), pa.array(inter, pa.int64())], ["a", "b", "common"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the number of common shingles; a pivot with many members is dealt out with copies of its set."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STRAND).cast("int").alias("strands"))
    members = (
        pairs.join(counts, "a")
        .select("a", F.pmod(F.xxhash64("b"), F.col("strands").cast("bigint")).cast("int").alias("strand"), F.lit(1).alias("kind"), "b")
        .join(sets.select(F.col("fp").alias("b"), "hashes"), "b").select("a", "strand", "kind", "b", "hashes")
    )
    pivots = (
        counts.select("a", F.explode(F.sequence(F.lit(0), F.col("strands") - 1)).alias("strand"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("b"))
        .join(sets.select(F.col("fp").alias("a"), "hashes"), "a").select("a", "strand", "kind", "b", "hashes")
    )
    dealt = pivots.unionByName(members).repartition("a", "strand").sortWithinPartitions("a", "strand", "kind")
    return dealt.mapInArrow(_check, "a binary, b binary, common long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", pivots: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked if their shingle sets share at least ``percent`` in a hundred of their union. component_id is the
    least doc_id that can be reached over links, kept is whether it is the row's own. A null, empty or blank text has no
    shingles and links with nothing. Rows that repeat an id and a text are kept together. A null doc_id is never a component_id
    unless the whole component has none. Words are those between ASCII white space, A-Z lower-cased. An
    empty table gives an empty result; other columns are dropped.
    """
    prepare_workers(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sig = written(d.mapInArrow(_signatures(width), f"doc_id {kind}, n_shingles long, fp binary, bands array<long>"), "signatures")
    classes = written(
        sig.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("fp", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keyed.join(shared, "key"), "buckets")
    met = members.groupBy("fp").agg(F.sum("size").alias("met"))
    members = written(members.drop("size").join(met, "fp"), "members")
    # null ids too: all texts without an id are read again if one of them is in a bucket
    wanted = members.select("fp").distinct().join(classes.select("fp", "least"), "fp").select(F.col("least").alias("wanted")).distinct()
    wanted = _bounded(wanted)
    sets = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = written(sets.mapInArrow(_sets(width), "fp binary, hashes binary").dropDuplicates(["fp"]), "sets")
    comps = written(members.select("fp", F.col("fp").alias("component")).distinct(), "components")
    tested = None
    for turn in range(pivots + 1):
        live = _spanning(members, comps)
        if live.isEmpty():
            break
        if turn == pivots:
            comps = written(_merged(comps, written(_rest(live, sets, percent), "checked")), "components")
            break
        pairs = _candidates(live, turn == 0, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            sized = _confirm(pairs.select("a", "b"), sets).join(pairs, ["a", "b"])
            checked = written(sized.select("a", "b", (100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).alias("linked")), "checked")
            tested = checked.select("a", "b") if tested is None else tested.unionByName(checked.select("a", "b"))
            comps = written(_merged(comps, checked.where("linked")), "components")
        if turn:  # the pivots have met all others of their buckets
            pivot = live.groupBy("key").agg(F.max(F.struct("met", "fp")).alias("p")).select("key", F.col("p.fp").alias("fp"))
            members = live.drop("component").join(pivot, ["key", "fp"], "left_anti")
            members = written(members, "members")
    # only classes of several rows and components of several classes have another id than their row's own
    linked = comps.where("fp <> component").select("component").distinct()
    linked = written(comps.join(_bounded(written(linked, "linked")), "component", "left_semi").join(classes.select("fp", "least"), "fp"), "linked")
    ids = written(linked.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    linked = linked.join(_bounded(ids), "component").select("fp", "component_id")
    alone = classes.where("times > 1").select("fp", F.col("least").alias("component_id")).join(linked.select("fp"), "fp", "left_anti")
    of = _bounded(written(linked.unionByName(alone), "named"))
    drop_shuffles(sig)
    return sig.select("doc_id", "n_shingles", "fp").join(of, "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _bounded(t: DataFrame) -> DataFrame:
    return F.broadcast(t) if t.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else t


def _spanning(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their component, of buckets that span several."""
    live = members.join(comps, "fp")
    spans = live.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return written(live.join(spans, "key", "left_semi"), "live")


def _candidates(live: DataFrame, first: bool, percent: int) -> DataFrame:
    """Untested pairs (a, b, na, nb) across components whose sizes allow a link: stars about one pivot of each bucket."""
    m = live.select("key", F.col("fp").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"))
    star = live.groupBy("key").agg(F.max(F.struct("met", "fp", "n", "component")).alias("p"))
    pairs = m.join(star, "key").where(F.col("p.component") != F.col("cy")).where(100 * F.least("p.n", "ny") >= percent * F.greatest("p.n", "ny"))
    if first:  # each member meets one pivot only: most need no other
        pairs = pairs.groupBy("y", "ny").agg(F.max(F.struct("p.met", "p.fp", "p.n")).alias("p"))
    x, n, swap = F.col("p.fp"), F.col("p.n"), F.col("p.fp") > F.col("y")
    pick = lambda p, q, name: F.when(swap, q).otherwise(p).alias(name)
    return pairs.select(pick(x, F.col("y"), "a"), pick(F.col("y"), x, "b"), pick(n, F.col("ny"), "na"), pick(F.col("ny"), n, "nb")).distinct()


def _rest(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket in different components; at most one for a member and a component in a block.

    Members outside their bucket's largest component are tested against that component, which is sent once however many
    buckets they share, and among themselves.
    """
    sizes = live.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    stray = written(live.select("key", "fp", "component").join(main, "key").where("component <> main"), "strays")
    outer = stray.select(F.col("main").alias("key"), "fp", "component").distinct()
    inner = live.select(F.col("component").alias("key"), "fp", "component").join(stray.select(F.col("main").alias("key")).distinct(), "key", "left_semi").distinct()
    among = stray.select("key", "fp", "component")
    return _in_blocks(outer, inner, sets, percent).unionByName(_in_blocks(among, among, sets, percent))


def _in_blocks(few: DataFrame, many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between ``few`` and ``many`` (key, fp, component) of a key: few are dealt into blocks of about ``STRAND``, each meets all of many."""
    blocks = few.groupBy("key").agg(F.ceil(F.count("*") / STRAND).cast("int").alias("blocks"))
    left = few.join(blocks, "key").select("key", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint")).cast("int").alias("block"), F.lit(0).alias("kind"), "fp", "component")
    right = many.join(blocks, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "fp", "component")
    dealt = left.unionByName(right).join(sets, "fp").select("key", "block", "kind", "fp", "component", "hashes")

    def test(batches):
        import pyarrow as pa

        at, held, block = None, [], None
        for b in batches:
            out = []
            for key, no, kind, fp, comp, s in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5)):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if (key, no) != at:
                    at, held, block = (key, no), [], None
                if kind == 0:
                    held.append((fp, comp, s))
                    continue
                if block is None:
                    block = _Block(held)
                out += block.links(fp, comp, s, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "kind").mapInArrow(test, "a binary, b binary")


class _Block:
    """Sets of a block as postings: hash -> members that have it."""

    def __init__(self, held: list):
        self.fps, self.comps = [h[0] for h in held], [h[1] for h in held]
        self.sizes = np.array([len(h[2]) for h in held])
        flat = np.concatenate([h[2] for h in held])
        who = np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.who = who[order]
        self.hashes, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.seen: set = set()

    def links(self, fp, comp, s: np.ndarray, percent: int) -> list:
        at = np.searchsorted(self.hashes, s)
        hit = at[self.hashes[np.minimum(at, len(self.hashes) - 1)] == s]
        lo, n = self.first[hit], self.first[hit + 1] - self.first[hit]
        spots = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        common = np.bincount(self.who[spots], minlength=len(self.fps))
        out = []
        for i in np.nonzero(100 * common >= percent * (self.sizes + len(s) - common))[0]:
            if self.comps[i] != comp and (i, comp) not in self.seen:
                self.seen.add((i, comp))
                out.append((self.fps[i], fp))
        return out


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after the links between them."""
    at = comps.select(F.col("fp").alias("a"), F.col("component").alias("u"))
    to = comps.select(F.col("fp").alias("b"), F.col("component").alias("v"))
    roots = connected_components(links.join(at, "a").join(to, "b").select("u", "v"))
    roots = _bounded(roots.select(F.col("node").alias("component"), F.col("component").alias("root")))
    return comps.join(roots, "component", "left").select("fp", F.coalesce("root", "component").alias("component"))
