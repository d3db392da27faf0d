"""Readmission training, densities and pathways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.operators import encoders, models, pathways, stats


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def examples(spark, n, shift, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"p{i // 4}", i % 4, int(y), [float(v) for v in rng.normal(size=6) * [1, 1, 1, 100, 1, 1] + y * shift]) for i, y in enumerate(rng.integers(0, 2, n))]
    return spark.createDataFrame(rows + [("q", 0, None, [0.0] * 6), ("r", 0, 1, None)], "patient_id string, visit_idx int, readmitted int, vec array<double>")


def test_no_patient_is_on_both_sides(spark):
    e = encoders.split_by_patient(examples(spark, 2000, 0))
    sides = e.groupBy("patient_id").agg(F.countDistinct("split").alias("n"), F.first("split").alias("split")).collect()
    assert {r["n"] for r in sides} == {1}
    assert 0.18 < sum(r["split"] == "test" for r in sides) / len(sides) < 0.32
    again = encoders.split_by_patient(examples(spark, 2000, 0).repartition(3))
    assert sorted(map(tuple, again.select("patient_id", "split").distinct().collect())) == sorted(map(tuple, e.select("patient_id", "split").distinct().collect()))


@pytest.mark.parametrize("shift, least, most", [(np.array([0, 0, 8, 0, 0, 0]), 0.999, 1.0), (np.zeros(6), 0.35, 0.65)])
def test_readmission_of_patients_not_seen(spark, shift, least, most):
    e = encoders.split_by_patient(examples(spark, 1200, shift))
    model = encoders.readmission_model(e.where("split = 'train'"))
    scored = encoders.readmission_scores(model, e.where("split = 'test'"))
    got = encoders.auc(scored).first()
    rows = [(r["readmitted"], r["probability"]) for r in scored.collect()]
    known = [r for r in rows if r[0] is not None]
    assert got["n"] == len(known) and got["positives"] == sum(y for y, _ in known) and all(0 <= s <= 1 for _, s in rows)
    assert least <= got["auc"] <= most and abs(got["auc"] - brute_auc(*zip(*known))) < 1e-12


def test_auc_counts_ties_half_and_needs_both_labels(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows + [(None, 1.0)], "readmitted int, probability double")
    assert abs(encoders.auc(df).first()["auc"] - brute_auc(*zip(*rows))) < 1e-12
    one = encoders.auc(df.where("readmitted = 1")).first()
    assert one["auc"] is None and one["n"] == one["positives"]
    assert tuple(encoders.auc(df.limit(0)).first()) == (0, 0, None)


def brute_density(x, points, cut=3.0):
    h = len(x) ** -0.2 * x.std(ddof=1)
    g = np.linspace(x.min() - cut * h, x.max() + cut * h, points)
    return g, np.array([np.exp(-0.5 * ((v - x) / h) ** 2).sum() for v in g]) / (len(x) * h * np.sqrt(2 * np.pi))


def test_density_is_that_of_all_rows(spark):
    rng = np.random.default_rng(7)
    groups = {"normal": rng.normal(size=3000), "two": np.r_[rng.normal(-40, 0.1, 50), rng.normal(90, 5, 900)], "outlier": np.r_[rng.normal(size=200), 1e6], "pair": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("flat", 3.0)] * 5 + [("one", 1.0), ("two", None), ("normal", None)]
    out = stats.density(spark.createDataFrame(rows, "model string, v double").repartition(5), "v", "model", points=80).collect()
    assert {r["model"] for r in out} == set(groups) and len(out) == 80 * len(groups)
    for k, x in groups.items():
        own = sorted((r["i"], r["x"], r["density"]) for r in out if r["model"] == k)
        g, want = brute_density(x, 80)
        assert np.allclose([r[1] for r in own], g, rtol=1e-12, atol=1e-9)
        assert np.abs(np.array([r[2] for r in own]) - want).max() <= 1e-11 * max(1.0, want.max())


def test_rows_do_not_meet_the_grid(spark):
    df = spark.range(0, 400_000, 1, 4).select(F.lit("m").alias("model"), (F.rand(5) * F.rand(6)).alias("v"))
    plan = stats.density(df, "v", "model")._jdf.queryExecution().optimizedPlan().toString()
    # whatever is spread over the grid has been folded before
    for part in plan.split("Generate explode")[1:]:
        assert "Aggregate" in part
    assert stats.density(df, "v", "model").count() == 200


class Agent:
    asked = None

    def __call__(self, question):
        Agent.asked.add(1)
        if "sepsis" in question:
            raise RuntimeError("no")
        return {"Find KEGG pathway for asthma": " Asthma pathway ", "Find KEGG pathway for flu": "Influenza A"}.get(question, "")


def narratives(spark):
    rows = [(str(i), f"text {i}", d) for i, d in enumerate(["asthma"] * 30 + ["flu", "sepsis", "unknown", "", None])]
    return spark.createDataFrame(rows, "patient_id string, narrative string, diagnosis string")


def test_without_an_agent_narratives_stay(spark):
    assert pathways.agent() is None and pathways.agent("none") is None
    out = pathways.with_pathways(narratives(spark), "narrative", "diagnosis", pathways.agent()).collect()
    assert [r["narrative"] for r in out] == [f"text {i}" for i in range(35)] and all(r["pathway"] is None for r in out)


def test_an_agent_is_asked_once_a_diagnosis(spark):
    Agent.asked = spark.sparkContext.accumulator(0)
    asked = Agent.asked

    def make():
        Agent.asked = asked
        return Agent()

    out = {int(r["patient_id"]): r for r in pathways.with_pathways(narratives(spark), "narrative", "diagnosis", make).collect()}
    assert asked.value == 4
    assert out[3]["narrative"] == "text 3 The primary diagnosis, asthma, is associated with the Asthma pathway." and out[3]["pathway"] == "Asthma pathway"
    assert out[30]["narrative"].endswith("associated with the Influenza A.")
    assert [out[i]["narrative"] for i in (31, 32, 33, 34)] == [f"text {i}" for i in (31, 32, 33, 34)] and len(out) == 35


def test_an_installed_agent_is_found(spark, monkeypatch):
    class Entry:
        def __init__(self, name):
            self.name = name

        def load(self):
            return lambda: (lambda question: f"{self.name} of {question.rsplit(' ', 1)[1]}")

    monkeypatch.setattr(pathways, "entry_points", lambda group: [Entry("b"), Entry("a")] if group == pathways.GROUP else [])
    assert pathways.agent()()("x y") == "a of y" and pathways.agent("b")()("x y") == "b of y" and pathways.agent("c") is None
    h = spark.createDataFrame([("1", ["s1", "s2"], [["old"], ["flu", "x"]]), ("2", ["s"], [[]])], "patient_id string, sentences array<string>, diagnoses array<array<string>>")
    out = {r["patient_id"]: r for r in pathways.pathway_narratives(h, make_agent=lambda: lambda q: "P1").collect()}
    assert out["1"]["diagnosis"] == "flu" and out["1"]["narrative"].endswith("The primary diagnosis, flu, is associated with the P1.")
    assert out["2"]["diagnosis"] is None and out["2"]["pathway"] is None


@pytest.mark.parametrize("attention", [False, True])
def test_histories_in_batches_are_those_one_by_one(spark, attention):
    """Windows of several lengths with empty and equal visits."""
    visits = [["a", "b"], [], ["c"], ["a", "b"], ["b", "a"], ["c", "c", "d e"], []]
    rows = [(f"p{i}", i, visits[i % 5: i % 5 + 1 + i % 3]) for i in range(20)]
    df = spark.createDataFrame(rows, "patient_id string, end_idx int, window array<array<string>>").coalesce(1)
    got = {r["patient_id"]: r["vec"] for r in encoders.encode_histories(df, 16, 8, attention=attention).collect()}
    emb, terms, net = models.HashingEmbedder(16), encoders.GRU(16, 8), encoders.GRU(8, 8, 43)
    for p, _, window in rows:
        s = net.states(np.array([terms.states(np.array(emb.encode(v)))[-1] if v else np.zeros(8) for v in window]))
        a = np.exp(s @ s[-1])
        want = (a / a.sum()) @ s if attention else s[-1]
        assert np.abs(np.array(got[p]) - want).max() < 1e-12


def test_states_of_lists_step_by_step():
    g, x = encoders.GRU(3, 4), np.random.default_rng(1).normal(size=(6, 3))
    at, sizes = np.array([0, 5, 5, 2, 1, 0]), np.array([2, 0, 3, 1])
    last = g.of_lists(x, at, sizes)[-1]
    assert np.allclose(last[0], g.states(x[[0, 5]])[-1]) and not last[1].any() and np.allclose(last[2], g.states(x[[5, 2, 1]])[-1]) and np.allclose(last[3], g.states(x[[0]])[-1])


def test_examples_count_names_and_send_none(spark):
    from visitloom.plans import judging
    from visitloom.sources import adapters

    d = "/root/testdata/sf0.001"
    assert "p_name" not in judging._examples(spark, d)._jdf.queryExecution().executedPlan().toString()
    kinds = ["diagnoses", "medications", "treatments"]
    want = {r["encounter_id"]: tuple(len(r[c]) for c in kinds) for r in adapters.visit_names(spark, d).collect()}
    assert {r["encounter_id"]: tuple(r[c] for c in kinds) for r in adapters.visit_counts(spark, d).collect()} == want
