"""URL filters, quality rules, line dedup, mixing: brute force and edge cases."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.llm import components, lines, mixing, quality, urls

from .helpers import DOCS, dup_lines, prose, repeats, words


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(500, k) for k in range(501, 560)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in up if any(n in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "/en/7/x", "block"), ("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("org", None, "block")]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + (p or "")), len(h), v, h + (p or "")) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    made = ["http://com/en/1", "https://www.example.com/en/7?q=/x", "ftp://A.B.Example.COM/en/7/x#f", "http://notcom/en/", "x.net/", "http://x.net", "http://x.net/", None, "", "://", "http://example.com/en", "http://üx.org", "http://a..com/en/",
            "http://example.com/EN/7", "a://b://example.com/en/7", "http://x.com/en/\n2"]
    rng = np.random.default_rng(0)
    made += [f"http://{'.'.join(rng.choice(['a', 'b', 'example', 'com', 'net', 'org'], rng.integers(1, 5)))}/{rng.choice(['en', 'de', 'en/7', 'en/7/x'])}{rng.choice(['', '/', '/9', '?a#b'])}" for _ in range(300)]
    made += ["http://www.example.com/en/70"] * 50
    pages = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(made)], "page_id long, url string, extra string, host string")
    out = urls.filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == out.count() == len(made) and "extra" in out.columns
    for i, u in enumerate(made):
        assert got[i] == judge(u), u


def test_url_filter_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.filter_urls(pages, none).collect()] == [(1, "http://a.com/", "a.com", "/", None, "allow")]
    assert urls.filter_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_url_sweep_in_several_strands(spark, monkeypatch):
    monkeypatch.setattr(urls, "SWEEP_ROWS", 3)
    monkeypatch.setattr(urls, "BROADCAST_HOSTS", 1)
    made = [f"http://h{i}.example.com/en/{i}" for i in range(60)]
    out = urls.filter_urls(spark.createDataFrame(list(enumerate(made)), "page_id long, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == {i: judge(u) for i, u in enumerate(made)}


TEXTS = [None, "", "  \n ", "a", "a b c a b c", "x y z\nx y z\nx y z", "one\n\ntwo\none\n", "é# $5 |a|\tb\x0bc", "a b c d a b c e b c d", "w " * 200, "\u00a0 nb\u00a0sp", "UP low", "a b a b a b a"]


def test_base_statistics(spark):
    rng = np.random.default_rng(5)
    texts = TEXTS + [" ".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 60, 40)]
    for r in quality.base_statistics(docs_of(spark, texts)).collect():
        t = texts[r["doc_id"]]
        assert r["n_words"] == len(words(t)) and r["word_chars"] == sum(map(len, words(t))), t
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and r["n_dup_lines"] == dup_lines(t), t
        assert r["n_repeat_words"] == repeats(t), t


def test_quality_keeps_clean_and_rejects_outliers(spark):
    rng = np.random.default_rng(1)
    clean = [prose(rng, int(n), 3000) for n in rng.integers(60, 400, 160)]
    odd = [" ".join(w + "###" for w in prose(rng, 80, 3000).split()) for _ in range(8)] + [prose(rng, 90, 3000).upper() + "!!" for _ in range(4)]
    d = docs_of(spark, clean + odd + ["few words", None]).withColumn("kept", F.lit("clash")).withColumn("extra", F.lit(1))
    out = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert len(out) == 174 and all(out[i]["kept"] for i in range(160)) and not any(out[i]["kept"] for i in range(160, 174))
    assert out[173]["base_failed"] and out[0]["extra"] == 1
    assert quality.judge(d.limit(0)).count() == 0
    nulls = d.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert quality.judge(nulls).where("kept").count() == 160


def test_line_dedup(spark):
    rng = np.random.default_rng(2)
    long = prose(rng, 60, 3000)
    near = long.replace(" ", ", ").title() + " 2024."
    long2 = prose(rng, 90, 3000)
    texts = [f"{long}\nshort one\nalpha beta gamma delta epsilon", f"own words here are kept always\n{long.upper()}!\nshort one", f"{near}\nanother line that only this text has", None, "",
             "alpha, beta; gamma: delta epsilon 12\nalpha beta gamma delta epsilon", long2, long2, "twice the same line of words\nx\ntwice the same line of words"]
    d = docs_of(spark, texts).withColumn("n_removed", F.lit("clash"))
    out = {r["doc_id"]: r for r in lines.dedup_lines(d).collect()}
    assert out[0]["text"] == texts[0] and out[0]["n_removed"] == 0
    assert out[1]["text"] == "own words here are kept always\nshort one"
    assert out[2]["text"] == "another line that only this text has"
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == ""
    assert out[6]["text"] == long2 and out[7]["text"] == ""
    assert out[8]["text"] == "twice the same line of words\nx"
    assert [out[i]["n_lines"] for i in (0, 3, 4, 8)] == [3, 0, 1, 3]
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_finds_edited_lines_and_no_others(spark):
    rng = np.random.default_rng(8)
    base = [prose(rng, 80, 8000) for _ in range(150)]
    edited = [" ".join("edit" if i == k % 80 else w for i, w in enumerate(t.split())) for k, t in enumerate(base)]
    far = [" ".join("edit" + w if i % 4 == 0 else w for i, w in enumerate(t.split())) for t in base]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, base + edited + far)).collect()}
    assert all(out[i] for i in range(150)) and all(out[i] for i in range(300, 450))
    assert not any(out[i] for i in range(150, 300))


def test_line_dedup_links_variants_of_a_hot_line(spark):
    rng = np.random.default_rng(4)
    base = prose(rng, 100, 3000)
    ws = base.split()
    variants = [" ".join(w if i != k else "edit" for i, w in enumerate(ws)) for k in range(0, 40)]
    texts = [base] * 20 + variants
    out = lines.dedup_lines(docs_of(spark, texts)).collect()
    left = [r["doc_id"] for r in out if r["text"]]
    assert left == [0]


def test_line_dedup_tells_figures_apart(spark):
    texts = ["1 000 000 units sold in 2021 for 35 euros each", "2 500 000 units sold in 2023 for 99 euros each", "1.000.000 units sold in 2021, for 35 euros each!",
             "12 34", "12/34", "1 234", "***", "***"]
    out = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs_of(spark, texts), exact_words=1).collect()}
    assert [out[i] for i in range(8)] == [0, 0, 1, 0, 1, 0, 0, 0]


def test_line_dedup_of_lines_with_few_words_in_common(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 12))
    base = [[word() for _ in range(20)] for _ in range(40)]
    edited = [" ".join(w if k % 5 == 0 else w[:5] + chr(97 + (ord(w[5]) - 96) % 26) + w[6:] for k, w in enumerate(ws)) for ws in base]
    d = docs_of(spark, [" ".join(ws) for ws in base] + edited)
    found = lambda **kw: sum(r["n_removed"] for r in lines.dedup_lines(d, runs=100, kinds=((1, 1 << 31),), **kw).collect())
    assert found(words_shared=0.0) == 40 and found() == 0


def test_line_dedup_of_repeated_ids(spark):
    d = docs_of(spark, ["a line of words that repeats", "a line of words that repeats"]).withColumn("doc_id", F.lit(7).cast("long"))
    assert [r["text"] for r in lines.dedup_lines(d).collect()] == ["a line of words that repeats"] * 2


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, int(n)), ["en", "de"][i % 3 == 0], ["a", "b", "c"][min(2, i % 5)], 0) for i, n in enumerate(rng.integers(1, 300, 600))]
    d = spark.createDataFrame(rows, DOCS)
    cells = mixing.cells_of(d.select("source", "lang", mixing.topic_of(F.col("text"), mixing.token_weight(F.col("text"))).alias("topic"), mixing.token_weight(F.col("text")).alias("n_tokens")))
    t = {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}
    w = mixing.rake(cells, t, rounds=40).toPandas()
    assert w.weight.sum() == pytest.approx(1)
    for m, x in t.items():
        x = x.toPandas().set_index(m).target
        assert np.abs(w.groupby(m).weight.sum() - x).max() < 1e-6
    out = mixing.mix(d).toPandas()
    assert len(out) == 600 and out.probability.max() == pytest.approx(1) and 0 < out.kept.sum() < 600
    again = mixing.mix(d.repartition(3)).toPandas().set_index("doc_id").kept
    assert (out.set_index("doc_id").kept == again.loc[out.doc_id]).mean() == 1


def test_mixing_by_a_topic_column_and_margins_that_contradict(spark):
    rows = [(i, "a b c d", "en", "s", 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS).withColumn("about", F.when(F.col("doc_id") % 3 == 0, "law").when(F.col("doc_id") % 3 == 1, "art"))
    aim = spark.createDataFrame([("law", 0.5), ("art", 0.25), ("", 0.25)], "topic string, target double")
    out = mixing.mix(d, targets={"topic": aim}, topic=F.col("about")).toPandas()
    assert out.groupby("topic").probability.first().round(6).to_dict() == {"": 0.5, "art": 0.5, "law": 1.0}
    cells = spark.createDataFrame([("a", "x", "t", 5)], "source string, lang string, topic string, tokens long")
    odd = mixing.rake(cells, {"source": spark.createDataFrame([("b", 1.0)], "source string, target double")}, rounds=2, most=4).collect()
    assert len(odd) == 1 and odd[0]["weight"] == 0.0


def test_mixing_edges(spark):
    d = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3)], DOCS).withColumn("topic", F.lit(0))
    assert mixing.mix(d).count() == 3 and mixing.mix(d.limit(0)).count() == 0


def test_line_dedup_finds_lines_with_one_changed_letter(spark):
    rng = np.random.default_rng(9)
    base = [prose(rng, n, 8000) for n in (6, 8, 12, 20, 40) for _ in range(40)]  # an edit of a space leaves five words
    edited = []
    for k, t in enumerate(base):
        at = int(rng.integers(0, len(t)))
        edited.append([t[:at] + "q" + t[at + 1:], t[:at] + "q" + t[at:], t[:at] + t[at + 1:]][k % 3])
    texts = base + edited
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert all(out[i] for i in range(200))
    missed = [i for i in range(200, 400) if out[i]]
    assert not missed


def test_line_dedup_compares_long_lines_by_characters(spark):
    rng = np.random.default_rng(10)
    base = [prose(rng, 35, 8000) for _ in range(20)]
    typos = []
    for t in base:
        ws = t.split()
        for k in (3, 9, 20, 30, 33):
            ws[k] = "q" + ws[k][1:]
        typos.append(" ".join(ws))
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, base + typos)).collect()}
    assert all(out[i] for i in range(20)) and not any(out[i] for i in range(20, 40))


def test_line_dedup_finds_near_copies_of_very_long_lines(spark):
    t = prose(np.random.default_rng(14), 1000, 8000)
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, [t, t[:4000] + "q" + t[4001:]])).collect()}
    assert out == {0: t, 1: ""}


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def damaged(rng, text, edits):
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(text))), int(rng.integers(0, 3))
        text = text[:at] + "xqz"[kind] * (kind < 2) + text[at + (kind != 1):]
    return text


@pytest.mark.parametrize("n", [12, 20, 40, 80])
def test_line_dedup_recall_of_damaged_lines(spark, n):
    """Held against the edit distance of every pair that was made: linked are only similar lines, and most of them."""
    rng = np.random.default_rng(n)
    base = [prose(rng, n, 8000) for _ in range(120)]
    shares = [0.0, 0.02, 0.05, 0.09]
    edited = [damaged(rng, t, max(1, int(len(t) * shares[k % 4]))) for k, t in enumerate(base)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, base + edited)).collect()}
    norm = lambda t: " ".join(t.split())
    alike = [10 * edit_distance(norm(a), norm(b)) <= max(len(norm(a)), len(norm(b))) for a, b in zip(base, edited)]
    assert all(out[i] for i in range(120))
    assert not any(out[120 + i] == "" for i in range(120) if not alike[i])
    for k, least in enumerate([1.0, 0.95, 0.6, 0.15]):
        of = [i for i in range(k, 120, 4) if alike[i]]
        assert sum(out[120 + i] == "" for i in of) >= least * len(of)
    # with every word in the sketch
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, base + edited), runs=100, kinds=((1, 1 << 31),)).collect()}
    of = [i for i in range(120) if alike[i]]
    assert sum(out[120 + i] == "" for i in of) >= 0.97 * len(of)


def test_line_dedup_compares_all_members_of_a_bucket(spark, monkeypatch):
    """All lines are in one bucket, in which most alike ones are neither neighbours nor like the pivot."""
    monkeypatch.setattr(lines, "COMMON_RUNS", 0, raising=False)
    some = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("w"))
    word = some.orderBy(F.xxhash64("w")).first()["w"]
    rng = np.random.default_rng(16)
    base = [f"{word} {prose(rng, 14, 8000)}" for _ in range(60)]
    edited = [t + "qxz"[: k % 4] for k, t in enumerate(base)]
    edited = [t if k % 4 else t[:30] + "q" + t[31:] for k, t in enumerate(edited)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, base + edited), runs=1, kinds=((1, 1 << 31),)).collect()}
    assert [out[i] for i in range(60)] == base and not any(out[i] for i in range(60, 120))


def test_line_dedup_bounds_lose_no_pair(spark):
    """Bounds on the distance against the distance itself, about the limit: edits all over, all at one end, all of one kind."""
    rng = np.random.default_rng(17)
    found = []
    for k in range(105):
        t = prose(rng, [6, 12, 40, 90, 150][k % 5], 3000)
        n = max(1, int(len(t) * rng.uniform(0.02, 0.13)))
        at = int(rng.integers(0, len(t) - n))
        found.append((t, [damaged(rng, t, n), t[n:], t[: len(t) - n], t[:at] + t[at + n:], t[:at] + "q" * n + t[at:], "z" * (n // 2) + t[: len(t) - n // 2], t[:at] + "é" * n + t[at + n:]][k % 7]))
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(105)], "a long, b long")
    texts = spark.createDataFrame([(2 * k + i, t) for k, two in enumerate(found) for i, t in enumerate(two)], "key long, norm string")
    out = {r["a"] // 2 for r in lines._confirm(pairs, texts, 90, 0.0).collect()}
    assert 25 < len(out) < 90
    assert out == {k for k, (a, b) in enumerate(found) if 10 * edit_distance(a, b) <= max(len(a), len(b))}


def test_line_dedup_compares_in_rounds_that_send_no_more_than_the_lines(spark, monkeypatch):
    """All pairs of a bucket send each line many times: no round sends much more than the lines have, and rounds find what one finds."""
    monkeypatch.setattr(lines, "ROUND_LEAST", 1)
    rng = np.random.default_rng(19)
    base = [prose(rng, 12, 3000) for _ in range(8)]
    texts = base + [damaged(rng, t, 3) for t in base]
    t = lines._signed(spark.createDataFrame(list(enumerate(texts)), "key long, norm string"))
    pairs = spark.createDataFrame([(i, j) for i in range(16) for j in range(i + 1, 16)], "a long, b long")
    want = {(r["a"], r["b"]) for r in lines._confirm(pairs, t, 90, 0.3, False).collect()}
    rounds, confirm = [], lines._confirm
    monkeypatch.setattr(lines, "_confirm", lambda some, *a: rounds.append([(r["a"], r["b"]) for r in some.collect()]) or confirm(some, *a))
    assert {(r["u"], r["v"]) for r in lines._linked(pairs, t, 90, 0.3, False, "more").collect()} == want and len(want) >= 8
    assert sorted(p for some in rounds for p in some) == [(i, j) for i in range(16) for j in range(i + 1, 16)]
    assert max(sum(len(texts[a]) for a, _ in some) for some in rounds) < 2 * sum(len(x) for x in texts)


def test_line_dedup_keeps_no_texts_of_all_lines_while_lines_are_compared(spark, monkeypatch):
    files, left, write = {}, {}, lines.written

    def spy(df, what="table", codec="zstd"):
        out = write(df, what, codec)
        files[what] = [urlparse(f).path for f in out.inputFiles()]
        left[what] = {w for w in ("lines", "folded") if any(os.path.exists(f) for f in files.get(w, []))}
        return out

    monkeypatch.setattr(lines, "written", spy)
    rng = np.random.default_rng(20)
    t = prose(rng, 12, 300)
    out = lines.dedup_lines(docs_of(spark, [t, damaged(rng, t, 2), t + "\n" + prose(rng, 9, 300)])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 1, 1]
    assert left["texts"] == {"lines"} and left["linked"] == set() and left["rest"] == set()


def test_line_dedup_signs_lose_no_pair_and_keep_unlike_ones_apart(spark):
    """Lines of one bucket, each in a group of its own: only those that may be alike leave the join, and no alike ones stay there."""
    rng = np.random.default_rng(18)
    base = [prose(rng, [8, 20, 60][k % 3], 3000) for k in range(90)]
    texts = base + [damaged(rng, t, max(1, int(len(t) * rng.uniform(0.01, 0.09)))) for t in base]
    t = lines._signed(spark.createDataFrame(list(enumerate(texts)), "key long, norm string"))
    members = t.select(F.lit(1).cast("long").alias("bucket"), "key", F.length("norm").alias("n_chars"))
    for shared in (0.0, 0.3):
        out = {(r["a"], r["b"]) for r in lines._rest(members, None, t, 90, shared).collect()}
        words = lambda i: set(texts[i].split(" "))  # noqa: B023, E731
        alike = {(i, i + 90) for i in range(90) if 10 * edit_distance(texts[i], texts[i + 90]) <= max(len(texts[i]), len(texts[i + 90]))
                 and len(words(i) & words(i + 90)) >= shared * min(len(words(i)), len(words(i + 90)))}
        assert len(alike) > 40 and alike <= out
    assert len(out) < 1_000  # of 16,110 pairs


def test_line_dedup_signs_keep_unlike_lines_of_many_words_apart(spark):
    """A bucket of long lines of one language: hardly a pair of unlike ones leaves the join, all alike ones do."""
    rng = np.random.default_rng(19)
    base = [prose(rng, 100, 3000) for _ in range(90)]
    texts = base + [damaged(rng, t, 12) for t in base[:30]]
    t = lines._signed(spark.createDataFrame(list(enumerate(texts)), "key long, norm string"))
    members = t.select(F.lit(1).cast("long").alias("bucket"), "key", F.length("norm").alias("n_chars"))
    out = {(r["a"], r["b"]) for r in lines._rest(members, None, t, 90, 0.3).collect()}
    assert {(i, i + 90) for i in range(30)} <= out
    assert len(out) < 300  # of 7,140 pairs


@pytest.mark.parametrize("likely", [True, False])
def test_line_dedup_bounds_of_long_lines_lose_no_pair(spark, monkeypatch, likely):
    """Lines over ``DIRECT`` characters, here of most lengths, about the limit: linked are those within it and no others."""
    monkeypatch.setattr(lines, "DIRECT", 40, raising=False)
    rng = np.random.default_rng(20)
    found = []
    for k in range(60):
        t = prose(rng, [6, 20, 60, 120][k % 4], 3000)
        n = max(1, int(len(t) * rng.uniform(0.02, 0.13)))
        found.append((t, [damaged(rng, t, n), t[n:], t[: len(t) // 2] + t[len(t) // 2 + n:]][k % 3]))
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(60)], "a long, b long")
    texts = spark.createDataFrame([(2 * k + i, t) for k, two in enumerate(found) for i, t in enumerate(two)], "key long, norm string")
    out = {r["a"] // 2 for r in lines._confirm(pairs, texts, 90, 0.0, likely).collect()}
    assert out == {k for k, (a, b) in enumerate(found) if 10 * edit_distance(a, b) <= max(len(a), len(b))}


def test_line_dedup_tells_lines_of_one_hash_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "line_hash", lambda norm: F.xxhash64(norm) % 2)
    rng = np.random.default_rng(15)
    texts = [prose(rng, 12, 8000) for _ in range(40)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts + texts[:10])).collect()}
    assert [out[i] for i in range(40)] == texts and not any(out[i] for i in range(40, 50))


def brute_mcd(x, half=0.75):
    """The same estimate of one group in numpy: three starts, two steps each, then the best until its determinant stands."""
    floor = np.array([quality.FLOOR[n] * 1000 for n in quality.DIMS]) ** 2
    scale, n, k = quality.consistency(half, x.shape[1]), len(x), x.shape[1]
    low = lambda v: np.floor(np.sort(v / quality.GRAIN, axis=0)[int(np.ceil(n / 2)) - 1]) * quality.GRAIN
    c = low(x)
    s = np.sqrt((1.4826 * low(np.abs(x - c))) ** 2 + floor)
    z = (x - c) / s
    scores = [None, np.tanh(z), z * np.sqrt(k / np.maximum((z * z).sum(1, keepdims=True), 1e-6))]
    covs = [np.diag(s * s) if t is None else (t.T @ t / n) * np.outer(s, s) for t in scores]
    dist = lambda m, cov: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)

    def step(m, cov):
        grade = np.floor(np.log2(dist(m, cov) + 1) * quality.GRADES)
        near = x[grade <= np.sort(grade)[int(np.ceil(half * n)) - 1]]
        return near.mean(0), scale * np.cov(near.T, bias=True) + np.diag(floor)

    size = lambda e: np.linalg.slogdet(e[1])[1] / 2
    best = min((step(*step(c, cov + np.diag(floor))) for cov in covs), key=size)
    while size(nxt := step(*best)) < size(best) - quality.SETTLED:
        best = nxt
    return dist(*best)


def test_quality_distances_match_numpy(spark):
    rng = np.random.default_rng(31)
    texts = []
    for k, n in enumerate(rng.integers(60, 300, 240)):
        t = prose(rng, int(n), 3000).split()
        t = [w.upper() if rng.random() < 0.02 * (k % 5) else w[: int(rng.integers(3, 8))] for w in t]
        texts.append(" ".join(w + "#" * (rng.random() < 0.01 * (k % 7)) for w in t) if k % 12 else " ".join(w.upper() + "$$" for w in t))
    rows = [(i, t, ["en", "de"][i % 2], None, 0) for i, t in enumerate(texts)]
    out = quality.judge(spark.createDataFrame(rows, DOCS)).toPandas().sort_values("doc_id")
    assert not out.base_failed.any()
    raw = [out[c].to_numpy(float) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper")]
    n, chars, symbols, repeat, upper = raw
    x = np.stack([np.log(n), chars / n, np.log(1 + 100 * symbols / n), np.sqrt(np.minimum(repeat / n, 1)), np.sqrt(upper / chars)], axis=1)
    x = np.floor(np.abs(x) * 1000 + 0.5) * np.sign(x)
    want = np.empty(len(out))
    for lang in ("en", "de"):
        at = (out.lang == lang).to_numpy()
        want[at] = brute_mcd(x[at])
    assert np.allclose(out.distance, want, rtol=1e-6)
    assert (out.kept.to_numpy() == (want <= quality.chi_square_quantile(1 - 1e-7, 5))).all() and 0 < out.kept.sum() < 240


def test_chi_square():
    assert quality.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)
    assert quality.chi_square_quantile(0.999, 1) == pytest.approx(10.8276, abs=1e-4)
    assert quality.consistency(0.75, 5) == pytest.approx(1.41, abs=0.01)
