"""Operators on small tables: order, windows, pairs, matching, models, resuming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.config import RunConfig, parse_args
from visitloom.operators import encoders, matching, models, neighbors, pairs, records, sampling, stats
from visitloom.operators import visits as V
from visitloom.sources import readers, sinks
from visitloom.stages import MissingInput, Stage, run_stages
from visitloom.streaming import ingest


def test_visit_order_puts_missing_dates_last_and_keeps_ties_in_source_order(spark):
    rows = [("p", "2020-01-02", 0), ("p", "bad", 1), ("p", "2020-01-01", 2), ("p", None, 3), ("p", "2020-01-02", 4)]
    df = spark.createDataFrame(rows, "patient_id string, d string, pos int")
    out = V.index_visits(df, F.try_to_timestamp("d"), F.col("pos"))
    assert {r["pos"]: r["visit_idx"] for r in out.collect()} == {2: 0, 0: 1, 4: 2, 1: 3, 3: 4}


def test_windows_have_exactly_n_visits(spark):
    df = spark.createDataFrame([(f"p{m}", i) for m in (0, 1, 5, 6, 7) for i in range(m)], "patient_id string, visit_idx int")
    out = V.windows(df, F.col("visit_idx"), 6).collect()
    assert sorted((r["patient_id"], r["end_idx"]) for r in out) == [("p6", 5), ("p7", 5), ("p7", 6)]
    assert all(r["window"] == list(range(r["end_idx"] - 5, r["end_idx"] + 1)) for r in out)


def test_nesting_does_not_multiply_children(spark):
    person = spark.createDataFrame([("1", "x"), ("2", None)], "person_id string, sex string")
    enc = spark.createDataFrame([("1", " e1 ", "2020"), ("1", "", "2021"), ("1", "e1", "2022")], "PatientEpicId_SH string, EncounterId_SH string, StartVisit string")
    dx = spark.createDataFrame([("e1", "a"), ("e1", "b")], "EncounterId_SH string, Diagnosis_Name string")
    med = spark.createDataFrame([("e1", "m")], "EncounterId_SH string, MedSimpleGenericName string")
    out = {r["patient_id"]: r["encounters"] for r in records.nest(person, enc, {"diagnoses": dx, "medications": med}).collect()}
    assert out["2"] == [] and len(out["1"]) == 3
    assert sorted(len(e["diagnoses"]) for e in out["1"]) == [0, 2, 2]
    kept = {r["patient_id"]: r["encounters"] for r in records.nest(person, enc, {"diagnoses": dx}, drop_unidentified=True).collect()}
    assert len(kept["1"]) == 2


def test_lists_of_several_kinds_are_those_of_each_alone(spark):
    rows = [("e1", "dx", "b", 2), ("e1", "dx", "a", 2), ("e1", "rx", "m", 1), ("e2", "rx", None, 0), (None, "dx", "z", 0), ("e3", "other", "o", 0)]
    df = spark.createDataFrame(rows, "enc string, kind string, name string, line int")
    both = records.children_by(df, "enc", "kind", {"dxs": ("dx", {"line": "line", "dx_name": "name"}), "rxs": ("rx", {"rx_name": "name"})}, ["line"])
    got = {r["enc"]: ([tuple(x) for x in r["dxs"]], [tuple(x) for x in r["rxs"]]) for r in both.collect()}
    assert got == {"e1": ([(2, "a"), (2, "b")], [(1, "m")]), "e2": ([], [(0, None)]), "e3": ([], [])}
    alone = records.children(df.where("kind = 'dx'").select("enc", F.col("name").alias("dx_name"), "line"), "enc", "dxs", ["line"])
    assert {r["enc"]: sorted((x["line"], x["dx_name"]) for x in r["dxs"]) for r in alone.collect()} == {"e1": [(2, "a"), (2, "b")]}
    person = spark.createDataFrame([("1",)], "person_id string")
    enc = spark.createDataFrame([("1", "e1"), ("1", "none")], "PatientEpicId_SH string, EncounterId_SH string")
    out = records.nest(person, enc, both.withColumnRenamed("enc", "EncounterId_SH")).first()["encounters"]
    assert [(e["encounter_id"], len(e["dxs"]), len(e["rxs"])) for e in out] == [("e1", 2, 1), ("none", 0, 0)]


def test_pairs_by_code_ignore_null_codes_and_repeats(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("a", "2"), ("c", None), ("d", None), ("e", "3")], "term string, code string")
    p = pairs.pairs_by_code(t)
    assert [tuple(r) for r in p.collect()] == [("a", "b")]
    assert sorted(r[0] for r in pairs.lonely(t, p).collect()) == ["c", "d", "e"]
    known = spark.createDataFrame([("b", "a")], "term string, counterpart string")
    assert pairs.not_present(p, known, "term", "counterpart").count() == 0


def test_all_pairs_and_neighbors_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(37, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    assert neighbors.pairwise_metrics(df, "k", "v", blocks=3).count() == 37 * 36 // 2
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    got = {(r["k"], r["rank"]): r["neighbor"] for r in neighbors.nearest(df, "k", "v", 3).collect()}
    assert got == {(i, r + 1): int(j) for i in range(37) for r, j in enumerate(np.argsort(d[i])[:3])}
    closed = neighbors.mean_similarity_closed(df, "v").first()["average_similarity"]
    assert abs(closed - neighbors.mean_similarity(df, "k", "v").first()["average_similarity"]) < 1e-9


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("blocks", [1, 4])
def test_pairs_and_neighbors_with_ties_and_copies(spark, metric, blocks):
    rng = np.random.default_rng(6)
    x = rng.integers(-1, 2, (60, 4)).astype(float)
    x[10] = x[11] + 1e-9
    x[20:30] = 1e6 + np.arange(10)[:, None] * 1e-3
    keys = [f"k{i:02d}" for i in rng.permutation(60)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "k string, v array<double>")
    away = np.linalg.norm(x[:, None] - x[None], axis=2)
    n = np.linalg.norm(x, axis=1)
    with np.errstate(all="ignore"):
        cos = np.where(np.outer(n, n) == 0, 0.0, x @ x.T / np.outer(n, n))
    got = {(r["k_1"], r["k_2"]): r for r in neighbors.pairwise_metrics(df, "k", "v", blocks).collect()}
    want = {tuple(sorted((keys[i], keys[j]))): (cos[i, j], away[i, j]) for i in range(60) for j in range(i)}
    assert got.keys() == want.keys()
    assert all(abs(r["cosine_similarity"] - want[k][0]) < 1e-12 and abs(r["euclidean_distance"] - want[k][1]) < 1e-9 * max(1, want[k][1]) for k, r in got.items())
    d = np.round(1 - cos if metric == "cosine" else away, 9)
    near = {}
    for r in neighbors.nearest(df, "k", "v", 7, metric, blocks).collect():
        near.setdefault(r["k"], {})[r["rank"]] = r["neighbor"]
    for i, k in enumerate(keys):
        order = sorted((d[i, j], keys[j]) for j in range(60) if j != i)[:7]
        assert [near[k][r + 1] for r in range(7)] == [o for _, o in order]


def greedy_loop(w):
    used, total = set(), 0.0
    for row in w:
        best = max((v, -j) for j, v in enumerate(row) if j not in used) if len(used) < len(row) else (0, 0)
        if best[0] > 0:
            used.add(-best[1])
            total += best[0]
    return total


def test_greedy_matching_is_sequential(spark):
    rng = np.random.default_rng(1)
    cases = [np.array([[0.9, 0.8], [0.7, 0.1]])] + [np.maximum(0, rng.normal(size=(4, 3)).round(1)) for _ in range(30)]
    rows = [(str(k), "diagnoses", i + 1, j, float(w[i, j]), f"a{i}", f"p{j}", float(w[i, j]), 1.0, 1.0) for k, w in enumerate(cases) for i in range(w.shape[0]) for j in range(w.shape[1])]
    c = spark.createDataFrame(rows, "patient_id string, category string, ai int, pi int, weight double, actual_term string, predicted_term string, similarity double, actual_idf double, predicted_idf double")
    got = {r["patient_id"]: r["s"] for r in matching.greedy(c).groupBy("patient_id").agg(F.sum("weighted_score").alias("s")).collect()}
    assert abs(got["0"] - 1.0) < 1e-9
    for k, w in enumerate(cases):
        assert abs(got.get(str(k), 0.0) - greedy_loop(w)) < 1e-9


def test_negative_idf_never_matches(spark):
    one = lambda t: spark.createDataFrame([("p", "diagnoses", 0, t)], "patient_id string, category string, pos int, term string")
    lib = spark.createDataFrame([("diagnoses", "x", [1.0, 0.0]), ("diagnoses", "y", [1.0, 0.0])], "category string, term string, vec array<double>")
    idf = spark.createDataFrame([("x", -0.5)], "term string, idf double")
    c = matching.candidates(one("x"), one("y"), lib, idf)
    assert c.first()["weight"] == 0.0 and matching.greedy(c).count() == 0
    s = matching.scores(matching.greedy(c), spark.createDataFrame([("p",), ("q",)], "patient_id string"))
    assert [r["overall"] for r in s.collect()] == [0.0, 0.0]


def test_idf_counts_patients_without_terms(spark):
    t = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), ("2", "")], "patient_id string, term string")
    p = spark.createDataFrame([("1",), ("2",), ("3",)], "patient_id string")
    r = matching.idf_registry(t, p).collect()
    assert [(x["term"], x["df"]) for x in r] == [("a", 2)] and abs(r[0]["idf"]) < 1e-12


def test_average_rank_and_spearman(spark):
    df = spark.createDataFrame([(float(x), float(-x * x)) for x in (1, 2, 2, 3, 5, 8)], "x double, y double")
    assert sorted(r["r"] for r in stats.average_rank(df, "x", "r").collect()) == [1.0, 2.5, 2.5, 4.0, 5.0, 6.0]
    assert abs(stats.spearman(df, "x", "y").first()["rho"] + 1) < 1e-9


def test_samples_repeat(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    first = [r["k"] for r in sampling.sample_n(df, "k", 10).collect()]
    assert first == [r["k"] for r in sampling.sample_n(df.repartition(7), "k", 10).collect()] and len(set(first)) == 10
    b = spark.createDataFrame([("c1", "p"), ("c2", "p"), ("c2", "q")], "chapter string, patient_id string")
    assert [tuple(r) for r in sampling.dissimilar_pairs(b).collect()] == [("p", "q")]


def test_symmetric_matrix(spark):
    p = spark.createDataFrame([("a", "b", 0.5)], "x string, y string, similarity double")
    m = pairs.symmetric(p, "x", "y", "similarity", pairs.diagonal_of("cosine_similarity"))
    assert sorted(map(tuple, m.collect())) == [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)]


def test_models_ask_each_prompt_once_and_keep_errors(spark):
    df = spark.createDataFrame([("p",), ("p",), ("q",), (None,)], "prompt string")
    out = models.complete(df, "prompt").collect()
    assert len(out) == 4 and len({r["raw"] for r in out}) == 3

    class Down:
        def complete(self, *a, **k):
            return "ERROR: API connection failed - 7"

    pair = spark.createDataFrame([("a", "b")], "x string, y string")
    assert models.relevance(pair, "x", "y", Down).first()["llm_relevance_score"] == 0.0
    bad = models.predict(spark.createDataFrame([("h", [])], "h string, n array<string>"), "h", "n", Down).first()
    assert bad["predicted_visit"] is None and "ERROR" in bad["parse_error"]


def test_embedding_and_encoder(spark):
    e = models.embed(spark.createDataFrame([("a b",), ("a b",), ("c",)], "t string"), "t").collect()
    assert len(e) == 3 and all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in e)
    w = spark.createDataFrame([("p", 1, [["a", "b"], []])], "patient_id string, end_idx int, window array<array<string>>")
    assert len(encoders.encode_histories(w, hidden=8, attention=True).first()["vec"]) == 8
    g = encoders.GRU(2, 3)
    assert g.states(np.ones((4, 2))).shape == (4, 3) and np.abs(g.states(np.ones((4, 2)))).max() < 1


def test_probe_and_lookup(spark):
    def load(m):
        if m == "bad":
            raise ValueError("no")

    assert [(r["model_id"], r["ok"]) for r in models.probe(spark, ["ok", "bad"], load).collect()] == [("ok", True), ("bad", False)]


def test_resume_twice_is_resume_once(spark, tmp_path):
    src = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    assert ingest.resume(spark, src, "id", lambda df: df, log, out) == (2, 0, 2, 2)
    assert ingest.resume(spark, src, "id", lambda df: df, log, out) == (2, 2, 0, 2)
    assert spark.read.parquet(out).count() == 2 and sinks.processed_ids(spark, log).count() == 2


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("1", "a")], "id string, v string").write.parquet(str(src))
    for _ in range(2):
        s = spark.readStream.schema("id string, v string").parquet(str(src))
        ingest.ingest_stream(s, "id", lambda df: df, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stages_skip_and_fail_fast(spark, tmp_path):
    out = str(tmp_path / "a")
    s = Stage("a", out, lambda sp, c: sp.range(3))
    assert run_stages(spark, RunConfig(), [s]) == {"a": "ran"} and run_stages(spark, RunConfig(), [s]) == {"a": "skipped"}
    assert run_stages(spark, RunConfig(num_visits=3), [s]) == {"a": "ran"}
    try:
        Stage("b", str(tmp_path / "b"), lambda sp, c, x: x, (str(tmp_path / "none"),)).run(spark, RunConfig())
        raise AssertionError
    except MissingInput:
        pass


def test_config():
    c = parse_args(["--num_visits", "4", "--distance_metric", "cosine"])
    assert c.num_visits == 4 and c.path().endswith("visits_4/patients_5000/metric_cosine/neighbors_10")
    assert len(list(c.grid(num_visits=[3, 6], num_neighbors=[5, 10]))) == 4


def test_sources(spark, tmp_path):
    (tmp_path / "Diagnosis_Table.csv").write_text("EncounterId_SH,Diagnosis_1_Code,extra\n001,A01,7\n002,,8\n")
    t = readers.flat_tables(spark, str(tmp_path))
    assert [tuple(r) for r in t["Diagnosis_Table"].collect()] == [("001", "A01", "7"), ("002", None, "8")] and t["Medication_Table"].count() == 0
    (tmp_path / "f.csv").write_text("name of it,the code\nFlu,J10\n")
    assert [tuple(r) for r in readers.positional_csv(spark, str(tmp_path / "f.csv")).collect()] == [("Flu", "J10")]
    (tmp_path / "v.txt").write_text("2 3\ncat 1 2 3\ndog 0.5 0 -1\n")
    assert sorted((r["word"], r["vec"]) for r in readers.word_vectors_text(spark, str(tmp_path / "v.txt")).collect()) == [("cat", [1, 2, 3]), ("dog", [0.5, 0, -1])]
    (tmp_path / "v.bin").write_bytes(b"2 2\n" + b"cat " + np.array([1, 2], "<f4").tobytes() + b"\ndog " + np.array([3, 4], "<f4").tobytes())
    assert sorted((r["word"], r["vec"]) for r in readers.word_vectors_binary(spark, str(tmp_path / "v.bin")).collect()) == [("cat", [1, 2]), ("dog", [3, 4])]
    (tmp_path / "ids.txt").write_text("a/b\n\n# no\nc\n")
    assert [r["id"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a/b", "c"]


def test_first_qualifying(spark):
    df = spark.createDataFrame([([["a"], [], [None, "x"], [""]],), ([[]],)], "h array<array<string>>")
    assert [r[0] for r in df.select(V.first_qualifying(F.col("h"))).collect()] == ["a", None]


@pytest.mark.parametrize("ranges", [1, 2, 7, 500])
def test_numbered_is_the_place_in_order(spark, ranges):
    values = [None, "", *(f"{'same ' * (i % 3)}{i * 37 % 101}" for i in range(101))]
    out = stats.numbered(spark.createDataFrame([(v,) for v in values], "v string"), "v", "i", ranges)
    assert out.columns == ["v", "i"]
    assert [r["v"] for r in sorted(out.collect(), key=lambda r: r["i"])] == [None, *sorted(values[1:])]
    assert sorted(r["i"] for r in out.collect()) == list(range(len(values)))
    assert stats.numbered(spark.createDataFrame([], "v string"), "v", "i", ranges).count() == 0


@pytest.mark.parametrize("blocks", [1, 3])
def test_metrics_folded_in_cells_are_those_of_the_pairs(spark, monkeypatch, blocks):
    """Copies, zero vectors, repeated keys and null labels too; with few values to send, pairs are ranked as a table."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 5)), 2).astype(np.float32)
    x[7] = x[8] = x[9]
    x[11] = 0
    rows = [(i - i % 2 if i < 6 else i, v.tolist(), None if i % 9 == 0 else i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, v array<float>, label int")
    monkeypatch.setattr(neighbors, "vector_blocks", lambda v: blocks)
    pairs_of = neighbors.pairwise_metrics(df, "k", "v").toPandas()
    keys = np.array([r[0] for r in rows])
    assert len(pairs_of) == int((keys[:, None] < keys[None, :]).sum())
    hist = {r["bin"]: r["n"] for r in neighbors.metric_histogram(df, "k", "v", -1.0, 1.0, 40).collect()}
    at = np.clip(np.floor((np.round(pairs_of.cosine_similarity, 9) + 1) / 0.05), 0, 39).astype(int)
    assert hist == at.value_counts().to_dict()
    r = neighbors.metric_regression(df, "k", "v").first()
    c = np.cov(pairs_of.cosine_similarity, pairs_of.euclidean_distance)
    slope = c[0, 1] / c[0, 0]
    assert abs(r["slope"] - slope) < 1e-9 and abs(r["intercept"] - (pairs_of.euclidean_distance.mean() - slope * pairs_of.cosine_similarity.mean())) < 1e-9
    assert abs(r["r2"] - c[0, 1] ** 2 / c[0, 0] / c[1, 1]) < 1e-9
    ranks = pairs_of[["cosine_similarity", "euclidean_distance"]].round(4).rank()
    for bound in (neighbors.RANKED, 10):
        monkeypatch.setattr(neighbors, "RANKED", bound)
        s = neighbors.metric_spearman(df, "k", "v", 4).first()
        assert s["n"] == len(pairs_of) and abs(s["rho"] - ranks.corr().iloc[0, 1]) < 1e-6
    assert tuple(neighbors.metric_spearman(df.limit(1), "k", "v").first()) == (0, None)
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(1)[:, None]).astype(float)
    want = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[0] < b[0]:
                g = tuple(sorted((a[2], b[2]), key=lambda z: (z is not None, z)))
                n, s = want.get(g, (0, 0.0))
                want[g] = n + 1, s + unit[i] @ unit[j]
    got = {(r["a"], r["b"]): (r["n"], r["s"]) for r in neighbors.group_similarity(df, "k", "v", "label").collect()}
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and abs(got[g][1] - want[g][1]) < 1e-4 for g in want)


def test_rows_of_vectors_sent_grow_no_faster_than_the_rows(spark):
    sent = {rows: pairs.vector_blocks(spark.range(rows)) * rows for rows in (120_000, 720_000)}
    assert sent[720_000] <= 6 * sent[120_000]


def test_values_of_all_pairs_are_counted_in_chunks(spark, monkeypatch):
    """Few rows leave the cells, not one for each value; ranks are those of the pairs, of values over a wide range too."""
    sent, fold = [], neighbors.fold_pairs
    monkeypatch.setattr(neighbors, "fold_pairs", lambda *a, **k: sent.append(fold(*a, **k)) or sent[-1])
    monkeypatch.setattr(neighbors, "HELD", 70_000, raising=False)
    monkeypatch.setattr(neighbors, "vector_blocks", lambda v: 1)
    x = np.random.default_rng(4).normal(size=(400, 5)).round(3)
    for by in (1, 1000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x * by)], "k long, v array<double>")
        ranks = neighbors.pairwise_metrics(df, "k", "v").toPandas()[["cosine_similarity", "euclidean_distance"]].round(4).rank()
        del sent[:]
        s = neighbors.metric_spearman(df, "k", "v", 4).first()
        assert s["n"] == len(ranks) == 79_800 and abs(s["rho"] - ranks.corr().iloc[0, 1]) < 1e-6
        assert by > 1 or sent[0].count() < 100  # of about 40,000 different values


def test_only_metrics_asked_for_are_worked_out(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "k long, v array<double>")
    both = {(r["k_1"], r["k_2"]): r for r in neighbors.pairwise_metrics(df, "k", "v").collect()}
    for m in ("cosine_similarity", "euclidean_distance"):
        p = neighbors.pairwise_metrics(df, "k", "v", metrics=(m,))
        assert p.columns == ["k_1", "k_2", m]
        assert {(r["k_1"], r["k_2"]): r[m] for r in p.collect()} == {k: r[m] for k, r in both.items()}
