"""The graph of stages and the four worlds over the driver's smallest tables."""

import glob
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from visitloom import worlds
from visitloom.config import RunConfig
from visitloom.operators import models, stats
from visitloom.stages import Stage, cancel, order_of, run_graph

TABLES = "/root/testdata/sf0.001"


def made(name, *inputs, root, fn=None):
    return Stage(name, f"{root}/{name}", fn or (lambda s, c, *x: s.range(3)), tuple(f"{root}/{i}" for i in inputs))


def test_a_failed_branch_stops_alone(spark, tmp_path):
    def broken(s, c, *x):
        raise ValueError("no such thing\nat all")

    g = [made("join", "left", "right", root=tmp_path), made("left", "a", root=tmp_path), made("right", "b", root=tmp_path), made("b", root=tmp_path, fn=broken), made("a", root=tmp_path), made("end", "left", root=tmp_path)]
    told = []
    out = run_graph(spark, RunConfig(), g, report=lambda n, s: told.append(n))
    assert out == {"a": "ran", "left": "ran", "end": "ran", "b": "failed: ValueError: no such thing", "right": "blocked by b", "join": "blocked by right"}
    assert told.index("a") < told.index("left") < told.index("end") and len(told) == 6
    g[3] = made("b", root=tmp_path)
    out = run_graph(spark, RunConfig(), g)
    assert {k for k, v in out.items() if v == "skipped"} == {"a", "left", "end"} and {k for k, v in out.items() if v == "ran"} == {"b", "right", "join"}


def test_independent_stages_run_at_once_and_no_more_than_asked(spark, tmp_path):
    now, most, lock = [0], [0], threading.Lock()

    def slow(s, c, *x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.4)
        with lock:
            now[0] -= 1
        return s.range(1)

    out = run_graph(spark, RunConfig(), [made(f"s{i}", root=tmp_path, fn=slow) for i in range(6)], at_once=3)
    assert set(out.values()) == {"ran"} and most[0] == 3


def test_graphs_that_make_no_sense(spark, tmp_path):
    with pytest.raises(ValueError):
        order_of([made("a", root=tmp_path), made("a", root=tmp_path)])
    with pytest.raises(ValueError):
        run_graph(spark, RunConfig(), [made("a", "b", root=tmp_path), made("b", "a", root=tmp_path)])
    assert run_graph(spark, RunConfig(), []) == {}
    out = run_graph(spark, RunConfig(), [made("a", "nowhere", root=tmp_path)])
    assert out["a"].startswith("failed: MissingInput")


def test_a_graph_is_cancelled_by_its_tag(spark, tmp_path):
    def endless(batches):
        for b in batches:
            time.sleep(60)
            yield b

    stage = made("slow", root=tmp_path, fn=lambda s, c: s.range(8).mapInPandas(endless, "id long"))
    stop = threading.Timer(3, lambda: cancel(spark, "stop-me"))
    stop.start()
    began = time.time()
    out = run_graph(spark, RunConfig(), [stage, made("after", "slow", root=tmp_path)], tag="stop-me")
    assert out["slow"].startswith("failed") and out["after"] == "blocked by slow" and time.time() - began < 45


def test_a_service_that_is_down_stops_its_stages(spark, tmp_path):
    s = Stage("asks", str(tmp_path / "asks"), lambda s, c: s.range(1), services=("http://127.0.0.1:9/health",), patience=0.1)
    assert run_graph(spark, RunConfig(), [s])["asks"] == "failed: ServiceDown: asks needs http://127.0.0.1:9/health"


def test_world_2_from_the_command_line(spark, tmp_path, capsys):
    args = ["world_2", "--tables", TABLES, "--root", str(tmp_path), "--num_patients", "25", "--num_visits", "4"]
    assert worlds.main(args, spark) == 0
    said = capsys.readouterr().out
    assert said.count(": ran") == 8
    folder = RunConfig(num_patients=25, num_visits=4).path(str(tmp_path)) + "/world_2"
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    n = read("vectors").count()
    m = read("metrics")
    assert n > 20 and m.count() == n * (n - 1) // 2 and m.where("llm_relevance_score IS NULL OR cosine_similarity IS NULL").count() == 0
    assert read("vectors").select("patient_id").distinct().count() <= 25
    c = {(r["x"], r["y"]): r for r in read("correlations").collect()}
    assert len(c) == 3 and c["cosine_similarity", "euclidean_distance"]["rho"] < -0.999 and all(0 <= r["p"] <= 1 for r in c.values())
    again = stats.spearman(m, "cosine_similarity", "llm_relevance_score").first()
    assert abs(c["cosine_similarity", "llm_relevance_score"]["rho"] - again["rho"]) < 1e-12
    keys = min(50, n)
    assert read("matrix").groupBy("metric").count().select("count").distinct().collect() == [(keys * keys,)]
    assert {r["pair_type"] for r in read("calibration").collect()} == {"similar", "dissimilar"}
    assert worlds.main(args, spark) == 0 and capsys.readouterr().out.count(": skipped") == 8


def test_worlds_1_and_3(spark, tmp_path, capsys):
    class Oracle:
        """Says what it was told last: the terms of the last visit of the history."""

        def complete(self, prompt, max_tokens=512, temperature=0.7):
            if "[Output Format Example]" not in prompt:
                return json.dumps({"summary": prompt[-400:].replace("\n", " ")})
            return "```json\n" + json.dumps({"predicted_visit": {"diagnoses": ["asthma"], "medications": ["zinc"], "treatments": []}}) + "\n```"

    c = RunConfig(num_patients=40, num_visits=3, num_neighbors=2)
    out = worlds.run_world(spark, "world_3", c, str(tmp_path), worlds.Means(TABLES, llm=Oracle))
    assert set(out) == {"visits", "vectors", "neighbors", "narratives", "predictions", "terms", "idf", "library", "matches", "scores"} and set(out.values()) == {"ran"}, out
    read = lambda name: spark.read.parquet(f"{c.path(str(tmp_path))}/world_1/{name}")
    p = read("predictions")
    many = read("visits").groupBy("patient_id").count().where("count > 3").count()
    assert p.count() == many > 5 and p.where("parse_error IS NOT NULL").count() == 0
    assert p.select(F.min(F.size("cases")), F.max(F.size("cases"))).first() == (2, 2)
    assert read("neighbors").groupBy("patient_id").count().select("count").distinct().collect() == [(2,)]
    s = read("scores")
    assert s.count() == many and s.where("overall < 0 OR treatments <> 0").count() == 0
    assert worlds.run_world(spark, "world_1", c, str(tmp_path), worlds.Means(TABLES, llm=Oracle))["predictions"] == "skipped"


def test_world_4_and_a_grid(spark, tmp_path, capsys):
    assert worlds.main(["world_4", "--tables", TABLES, "--root", str(tmp_path), "--grid", "vectorizer_method=m1,m2", "num_visits=3", "--embedder", "hashing:32"], spark) == 0
    assert capsys.readouterr().out.count(": ran") == 8
    one = RunConfig(vectorizer_method="m1", num_visits=3).path(str(tmp_path)) + "/world_4"
    scores = spark.read.parquet(f"{one}/scores")
    back = spark.read.json(f"{one}/scores-json")
    assert scores.count() == back.count() > 20 and {r["model"] for r in back.select("model").distinct().collect()} == {"m1"}
    assert glob.glob(f"{one}/scores-json/model=m1/category=*/part-*")
    assert spark.read.parquet(f"{one}/library").where("embed_error IS NOT NULL").count() == 0
    assert spark.read.parquet(f"{one}/density").groupBy("category").count().select("count").distinct().collect() == [(200,)]
    with pytest.raises(SystemExit):
        worlds.main(["world_4", "--tables", TABLES, "--root", str(tmp_path), "--grid", "nothing=1"], spark)


def test_a_pathway_agent_and_a_bad_text_in_a_world(spark, tmp_path):
    class Picky(models.HashingEmbedder):
        def encode(self, texts):
            if any("goldenrod" in t for t in texts):
                raise ValueError("no")
            return super().encode(texts)

    c = RunConfig(num_patients=10, num_visits=2, num_neighbors=1)
    out = worlds.run_world(spark, "world_1", c, str(tmp_path), worlds.Means(TABLES, embedder=Picky, agent=lambda: lambda q: "P of " + q[-3:]))
    assert set(out.values()) == {"ran"}, out
    told = spark.read.parquet(f"{c.path(str(tmp_path))}/world_1/narratives").where("diagnosis IS NOT NULL").collect()
    assert told and all(r["pathway"] == "P of " + r["diagnosis"][-3:] and r["narrative"].endswith(f"is associated with the {r['pathway']}.") for r in told)
