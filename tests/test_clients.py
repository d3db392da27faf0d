"""Services and models: retries, requests in flight, bad texts, model files."""

import http.server
import json
import threading
import time
from collections import Counter
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.operators import clients, loaders, models

QUICK = clients.Retry(tries=4, first=0.01, longest=0.05)


class Stub(http.server.ThreadingHTTPServer):
    """Refuses each question twice, then answers; counts calls and those in flight."""

    daemon_threads = True

    def __init__(self, status=503, refusals=2):
        self.calls, self.most, self.now, self.lock, self.status, self.refusals = Counter(), 0, 0, threading.Lock(), status, refusals
        super().__init__(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server_port}/"
        threading.Thread(target=self.serve_forever, daemon=True).start()


class Handler(http.server.BaseHTTPRequestHandler):
    def answer(self, question, said):
        s = self.server
        with s.lock:
            s.calls[question] += 1
            s.now += 1
            s.most = max(s.most, s.now)
            refuse = s.calls[question] <= s.refusals
        time.sleep(0.02)
        with s.lock:
            s.now -= 1
        self.send_response(s.status if refuse else 200)
        self.end_headers()
        self.wfile.write(b"" if refuse else said)

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
        self.answer(asked, json.dumps({"choices": [{"message": {"content": f"re {asked}"}}]}).encode())

    def do_GET(self):
        word = unquote(self.path.rsplit("/", 1)[1])
        self.answer(word, json.dumps([{"meanings": [{"definitions": [{"synonyms": [f"other {word}"]}]}]}]).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def stub():
    made = []

    def make(**kw):
        made.append(Stub(**kw))
        return made[-1]

    yield make
    for s in made:
        s.shutdown()


def test_a_service_that_fails_twice_answers_in_order(spark, stub):
    s = stub()
    url = s.url
    df = spark.createDataFrame([(i, f"q{i % 30}") for i in range(60)], "i int, prompt string")
    out = models.complete(df, "prompt", lambda: models.HttpLLM(url, retry=QUICK), partitions=2, in_flight=3).collect()
    assert len(out) == 60 and all(r["raw"] == f"re {r['prompt']}" for r in out)
    assert set(s.calls.values()) == {3} and len(s.calls) == 30
    assert 1 < s.most <= 2 * 3


def test_synonyms_are_looked_up_through_the_same_client(spark, stub):
    s = stub(status=429)
    url = s.url
    words = spark.createDataFrame([(w,) for w in ("flu shot", "café", "flu shot")], "term string")
    out = models.lookup(words, "term", lambda: models.Dictionary(url, retry=QUICK), in_flight=2)
    from visitloom.functions import text

    got = out.select("term", text.synonym_of(F.col("raw"), F.col("term")).alias("s")).collect()
    assert sorted(map(tuple, got)) == [("café", "other café"), ("flu shot", "other flu shot"), ("flu shot", "other flu shot")]
    assert s.calls == {"flu shot": 3, "café": 3}


def test_what_does_not_help_is_not_tried_again(spark, stub):
    refusing, away = stub(status=404, refusals=9), stub(refusals=99)
    assert models.HttpLLM(refusing.url, retry=QUICK).complete("x") == "ERROR: no usable reply from the model service (status 404)" and refusing.calls["x"] == 1
    assert models.HttpLLM(away.url, retry=QUICK).complete("x").startswith("ERROR: the model service cannot be reached") and away.calls["x"] == 4
    url = away.url
    out = models.lookup(spark.createDataFrame([("x",)], "term string"), "term", lambda: models.Dictionary(url, retry=QUICK)).first()
    assert out["raw"] == ""


def test_pauses_double_and_heed_the_service():
    assert [round(p, 9) for p in clients.Retry(tries=6, first=1, longest=5).pauses("a")] == [round(p, 9) for p in clients.Retry(tries=6, first=1, longest=5).pauses("a")]
    for k, p in enumerate(clients.Retry(tries=6, first=1, longest=5).pauses("a")):
        assert min(5, 2**k) / 2 <= p <= min(5, 2**k)
    slept, left = [], [clients.Busy("later", 0.25), clients.Busy("much later", 99)]

    def ask():
        if left:
            raise left.pop(0)
        return "ok"

    assert clients.Retry(longest=2).call(ask, sleep=slept.append) == "ok" and slept == [0.25, 2]
    with pytest.raises(KeyError):
        clients.Retry().call(lambda: {}["no"], sleep=slept.append)
    assert len(slept) == 2


def test_order_and_bound_of_what_is_in_flight():
    now, most, lock = [0], [0], threading.Lock()

    def ask(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (i % 7))
        with lock:
            now[0] -= 1
        return i

    assert list(clients.in_order(ask, iter(range(80)), 4)) == list(range(80)) and 1 < most[0] <= 4
    assert list(clients.in_order(ask, [], 4)) == [] and list(clients.in_order(ask, range(3), 1)) == [0, 1, 2]


def test_a_service_is_waited_for(stub):
    s = stub()
    assert clients.healthy(s.url + "health", wait=5, every=0.01)
    assert not clients.healthy("http://127.0.0.1:9/", wait=0.05, every=0.02, timeout=0.2)


class Poisoned:
    """Fails for a whole batch if one text in it is bad."""

    def __init__(self, calls):
        self.calls = calls

    def encode(self, texts):
        self.calls.add(1)
        if any("poison" in t for t in texts):
            raise ValueError("cannot read this")
        return [[float(len(t)), 1.0] for t in texts]


def test_one_bad_text_costs_no_other_its_vector(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(f"text {i}" if i != 617 else "poison",) for i in range(1000)] + [(None,)], "t string").coalesce(1)
    out = models.embed(df, "t", lambda: Poisoned(calls), batch=128, errors="why").collect()
    assert len(out) == 1001
    bad = [r for r in out if r["why"] is not None]
    assert [(r["t"], r["vec"], r["why"]) for r in bad] == [("poison", None, "ValueError: cannot read this")]
    assert all(r["vec"] == [float(len(r["t"])), 1.0] for r in out if r["t"] not in (None, "poison"))
    assert calls.value <= 1000 // 128 + 4 + 1 + 2 * 7 + 4
    assert models.embed(df, "t", lambda: Poisoned(calls)).columns == ["t", "vec"]


def test_a_model_that_miscounts_gives_errors(spark):
    class Short:
        def encode(self, texts):
            return []

    out = models.embed(spark.createDataFrame([("a",), ("b",)], "t string"), "t", Short, errors="why").collect()
    assert all(r["vec"] is None and "0 vectors for 1 texts" in r["why"] for r in out)


def test_a_model_file_is_shipped_and_loaded_once_a_worker(spark, tmp_path):
    path = str(tmp_path / "small.npz")
    np.savez(path, words=np.array(["flu", "shot", "café"]), vectors=np.array([[1, 0], [0, 1], [2, 2]], "f4"), weights=np.array([3, 1, 1], "f4"))
    loads = spark.sparkContext.accumulator(0)

    @loaders.loader("counted")
    def load(p):
        loads.add(1)
        return loaders.load_static(p)

    df = spark.createDataFrame([("Flu shot",), ("café nothing",), ("nothing",)], "t string").repartition(3)
    out = {r["t"]: r["vec"] for r in models.embed(df, "t", loaders.model(spark, "static", path)).collect()}
    assert out == {"Flu shot": [0.75, 0.25], "café nothing": [2.0, 2.0], "nothing": [0.0, 0.0]}
    assert loaders.loader_of("counted") is load
    again = df.crossJoin(spark.range(40)).select(F.concat_ws(" ", "t", "id").alias("t")).repartition(12)
    assert models.embed(again, "t", loaders.model(spark, "counted", path)).where("vec IS NOT NULL").count() == 120
    assert 1 <= loads.value <= 4
    with pytest.raises(KeyError, match="no loader for models of kind none"):
        loaders.model(spark, "none", path)
    assert len(models.embed(df, "t", loaders.model(spark, "hashing", "16")).first()["vec"]) == 16


def test_a_loaded_model_is_kept(tmp_path, monkeypatch):
    seen = []
    load = lambda p: seen.append(p) or models.HashingEmbedder(4)
    monkeypatch.setattr(loaders.SparkFiles, "get", lambda name: str(tmp_path / name))
    (tmp_path / "m").write_text("x")
    assert loaders.in_worker("seen", "m", load) is loaders.in_worker("seen", "m", load) and seen == [str(tmp_path / "m")]
