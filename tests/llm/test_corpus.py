"""Divergence, whitening and fingerprints: brute force and edge cases."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from visitloom.llm import divergence, fingerprints, queries, whitening

from .helpers import DOCS, FOLD, prose

PLAIN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, min_docs, top, unit):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(PLAIN.findall(t.translate(FOLD)), s) for t, g, s in rows if g == lang]
        df = collections.Counter(w for ws, _ in own for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        count = {s: collections.Counter() for _, s in own}
        for ws, s in own:
            count[s].update(w for w in ws if df[w] >= min_docs)
        whole = sum(count.values(), collections.Counter())
        p = lambda c: {w: 1 + unit * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pair = [(-sum(abs(ps[s][w] - ps[o][w]) for w in kept), o.encode()) for o in count if o != s]
            term = [(-(ps[s][w] - q[w]), w.encode()) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_divergence_is_that_of_all_terms(spark, monkeypatch, share):
    rng = np.random.default_rng(3)
    rows = [(prose(rng, int(rng.integers(0, 40)), 30 + 20 * (i % 9)), "en", f"s{i % 9}") for i in range(120)]
    rows += [(prose(rng, 12, 60).upper() + " É1é ~x", None, f"q{i % 3}") for i in range(15)] + [(None, "de", "a"), ("", "de", None), ("!?", "fr", "one")] + [rows[0]] * 4
    for name, v in (("SOURCES", 2), ("TILE", 16), ("EXPAND", 50), ("PART_ROWS", 100), ("HELD", 60)):
        monkeypatch.setattr(divergence, name, v)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, term string").repartition(5)
    got = divergence.audit(docs, min_docs=4, top=7, unit=10**9, heavy_share=share)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 4, 7, 10**9)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert divergence.audit(empty).count() == 0
    lone = spark.createDataFrame([(1, "a b", "en", "s", 0), (2, None, "en", None, 0)], DOCS)
    assert sorted(map(tuple, divergence.audit(lone).collect())) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def test_counts_beyond_a_billion_stay_exact(spark):
    n = 9 * 10**12
    df = spark.createDataFrame([(n, 10**13, 7)], "n long, total long, terms long")
    assert df.select(divergence.share("n", "total", "terms", 10**9)).first()[0] == 1 + 10**9 * (n + 5) // (10**13 + 35)


def test_a_long_text_is_counted_whole(spark):
    docs = spark.createDataFrame([(1, "tail " * 200_000 + "Zé", "en", "s", 0)] * 2, DOCS)
    got = {(r["term"], r["n"], r["docs"]) for r in divergence.term_counts(docs).collect()}
    assert got == {(None, 0, 0), (b"tail", 400_000, 2), ("zé".encode(), 2, 2)}


def test_eigen_solve_is_that_of_lapack():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, vecs = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * np.abs(a).max())
        assert np.allclose(vecs @ np.diag(values) @ vecs.T, a, atol=1e-12 * np.abs(a).max()) and np.allclose(vecs.T @ vecs, np.eye(n), atol=1e-13)
    assert whitening.eigen(np.zeros((4, 4)))[0].tolist() == [0.0] * 4
    assert np.allclose(whitening.eigen(np.ones((5, 5)))[0], [5, 0, 0, 0, 0], atol=1e-14)


def test_partial_moments_merge_to_those_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**6), 10**6, (700, 6)) + 10**9
    parts = [whitening.Moments(6) for _ in range(5)]
    for m, p in zip(parts, (x[:0], x[:1], x[1:300], x[300:301], x[301:])):
        m.add(p)
    total = whitening.Moments(6)
    for m in parts:
        total.merge(whitening.Moments.of(m.row(6, 0)))
    c = x - x.mean(axis=0)
    assert total.n == 700 and total.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(total.scatter, c.T @ c, rtol=1e-12, atol=1e-13 * total.scatter.max())


def test_whitening_matches_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 11)) @ np.diag(np.linspace(3, 0.2, 11)) + 5
    rows = [(i if i % 50 else None, v.astype("f4").tolist(), 1, i) for i, v in enumerate(base)] + [(3, base[3].astype("f4").tolist(), 0, -1)]
    bad = [(900, None, 1, 0), (901, [1.0, None], 1, 0), (902, [float("nan")] * 11, 1, 0), (903, [float("inf")] * 11, 1, 0)]
    other = [(950, [2.0, 4.0], 1, 950), (951, [1.0, 0.5], 1, 951), (960, [], 1, 960), (970, [7.0] * 5, 1, 970)]
    df = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<float>, n int, at int").repartition(7)
    out = {r["at"]: r for r in whitening.whiten(df).collect()}
    assert sorted(out) == sorted(r[3] for r in rows + other)
    x = np.floor(1024 * np.array([r[1] for r in rows], "f4").astype(float)).astype(int) + 100_000
    n, s, c = len(x), x.sum(axis=0), x - x.mean(axis=0)
    values, vecs = np.linalg.eigh(c.T @ c / n)
    white = c @ vecs[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    got = np.array([out[r[3]]["whitened"] for r in rows])
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-9)
    assert [int(out[r[3]]["deviation"]) for r in rows] == [int(((n * v - s) ** 2).sum()) for v in x]
    assert out[7]["n"] == n and out[7]["identity_error"] < 1e-9 and out[7]["vec_id"] == 7
    assert np.allclose(out[7]["explained"], values[::-1][:8] / values.sum(), rtol=1e-9)
    assert out[950]["n"] == 2 and out[950]["whitened"][1] is None and abs(abs(out[950]["whitened"][0]) - 1) < 1e-9
    assert out[960]["whitened"] == [] and out[970]["whitened"] == [None] * 5 and out[970]["deviation"] == 0 and out[970]["identity_error"] is None
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_of_huge_entries_is_exact_and_bounded(spark):
    df = spark.createDataFrame([(i, [float(i * 10**12), 1e300, -1e308]) for i in range(3)], "vec_id long, embedding array<double>")
    out = whitening.whiten(df).orderBy("vec_id").collect()
    assert [int(r["deviation"]) for r in out] == [(3 * 1024 * 10**12) ** 2, 0, (3 * 1024 * 10**12) ** 2]


def brute_fingerprints(texts, band=(0.2, 0.8)):
    """doc_id -> what edit_test gives, with the same hashes worked out one by one."""
    signed = lambda h: h - 2**64 if h >= 2**63 else h

    def term(w, seed=7):
        return signed(xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash.xxh64_intdigest(w.encode(), 42)))

    def chain(hs):
        h = 42
        for x in hs:
            h = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), h)
        return h

    cut = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: sorted({term(w) for w in cut.split(t.lower()) if w})
    ids = sorted(texts)
    n = len(ids)
    df = collections.Counter(h for t in texts.values() for h in terms(t))
    lex = {h for h, k in df.items() if n > 1 and max(n ** (1 - band[1]), 1) <= k <= n ** (1 - band[0])}

    def sign(t):
        every = terms(t)
        used = [h for h in every if h in lex]
        used = used if len(used) >= fingerprints.LEAST_TERMS else every
        out = [f"{chain(used) if every else xxhash.xxh64_intdigest(t.encode(), 42):016x}"]
        for lane in range(fingerprints.LANES):
            hs = used
            for level in range(fingerprints.LEVELS):
                hs = [h for h in hs if not ((h % 2**64) >> (fingerprints.LEVELS * lane + level)) & 1]
                out.append(f"{chain(hs):016x}"[8:] if hs else "-")
        return ".".join(out)

    def like(a, b):
        if a == b:
            return 1.0
        z = list(zip(a.split(".")[1:], b.split(".")[1:]))
        return sum(x == y != "-" for x, y in z) / max(1, sum(x != "-" or y != "-" for x, y in z))

    out = {}
    for k, i in enumerate(ids):
        t, o = texts[i], texts[ids[(k + 1) % n]]
        m = len(t) // 4
        e = t[: len(t) - m] + o[:m]
        a, b = sign(t), sign(e)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, like(a, b), like(a, sign(o)))
    return out


@pytest.mark.parametrize("sent", [10**6, 10])
def test_fingerprints_match_one_by_one(spark, sent):
    rng = np.random.default_rng(5)
    texts = {int(i): prose(rng, int(n), 300) for i, n in zip(rng.permutation(5000)[:150] - 100, rng.integers(0, 120, 150))}
    texts |= {9000: "", 9001: "?!", 9002: "Été ÉTÉ x1", 9003: "word " * 30_000 + "end", 9004: "𝒳 a𝒳b c"}
    for i in list(texts)[:10]:
        texts[10_000 + i] = texts[i]
    df = spark.createDataFrame([(i, t, "t", 0) for i, t in texts.items()], "doc_id long, text string, fingerprint string, part int").repartition(6)
    got = {r["doc_id"]: tuple(r)[1:] for r in fingerprints.edit_test(df, rows=16, size=4096, sent_terms=sent).collect()}
    want = brute_fingerprints(texts)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4] and got[i][4:] == pytest.approx(want[i][4:]), i


def test_order_of_repeated_and_null_ids(spark):
    rows = [(None, f"none {i}") for i in range(40)] + [(5, f"five {i}") for i in range(60)] + [(5, "same")] * 3 + [(9, None), (1, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = fingerprints.with_next(df, rows=4, size=200)
    assert out.select("part").distinct().count() > 15
    own = out.where("NOT last").withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h", "text").collect()
    assert len(own) == len(rows)
    assert [r["next_text"] for r in own] == [r["text"] for r in own[1:]] + [own[0]["text"]]


def test_edits_at_the_ends(spark):
    assert fingerprints.edit_test(spark.createDataFrame([], DOCS)).count() == 0
    lone = fingerprints.edit_test(spark.createDataFrame([(7, "abcdefghi", None, None, 0)], DOCS)).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abcdefgab").hexdigest() and lone["near_next"] == 1.0
    blank = fingerprints.edit_test(spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0)], DOCS)).collect()
    assert len(blank) == 2 and all(r["near_edited"] == r["near_next"] == 1.0 and r["n_chars"] == 0 for r in blank)


def test_fingerprint_of_other_texts_under_a_lexicon(spark):
    rng = np.random.default_rng(8)
    long = prose(rng, 200, 900).split()
    df = spark.createDataFrame([(i, prose(rng, 80, 900)) for i in range(60)] + [(100, " ".join(long)), (101, " ".join(long[:-6])), (102, "  ".join(reversed(long)))], "doc_id long, text string")
    out = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df, fingerprints.lexicon(df)).collect()}
    assert out[100] == out[102]
    near = spark.createDataFrame([(out[100], out[101], out[3])], "a string, b string, c string").select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("c"))).first()
    assert near[0] > 0.4 and near[1] < 0.1


def test_contract_columns(spark):
    kinds = {k: dict(queries.queries()[k](spark, "/root/testdata/sf0.001").dtypes) for k in ("op11_source_divergence", "op12_whitening", "op13_fingerprints")}
    assert kinds["op11_source_divergence"] == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert kinds["op12_whitening"] == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert kinds["op13_fingerprints"] == {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
