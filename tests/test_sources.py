"""Sources, sinks and ingestion by round trips."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from visitloom import schema
from visitloom.operators import models, neighbors
from visitloom.sources import readers, sinks
from visitloom.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_point_query_and_peek(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b' OR 1=1"), (2, "c")], "k long, v string")
    assert rows(readers.rows_where(df, "v", "b' OR 1=1")) == [(2, "b' OR 1=1")] and readers.rows_where(df, "k", 9).count() == 0
    assert rows(readers.rows_in(df, spark.createDataFrame([(2,), (2,), (None,)], "k long"), "k")) == [(2, "b' OR 1=1"), (2, "c")]
    seen = readers.peek(df, 2)
    assert (seen["rows"], seen["columns"], seen["empty"], len(seen["head"])) == (3, ["k", "v"], False, 2)
    assert readers.peek(df.limit(0))["empty"]


def test_bucketed_table_joins_without_a_shuffle(spark):
    a = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    for name in ("bucketed_a", "bucketed_b"):
        sinks.bucketed(a, name, "id", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        j = spark.table("bucketed_a").join(spark.table("bucketed_b").withColumnRenamed("v", "w"), "id")
        assert j.count() == 1000
        assert "Exchange hashpartitioning(id" not in j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE {name}")


def test_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    sinks.export_json(df, str(tmp_path / "lines"))
    assert rows(readers.records_json(spark, str(tmp_path / "lines"), "id long, name string", lines=True).fillna("")) == [(1, "x"), (2, "")]
    (tmp_path / "array.json").write_text(json.dumps([{"id": 1, "name": "x"}, {"id": 2}]))
    assert rows(readers.records_json(spark, str(tmp_path / "array.json"), "id long, name string").fillna("")) == [(1, "x"), (2, "")]
    field = schema.PATIENT.fieldNames()[0] if hasattr(schema.PATIENT, "fieldNames") else schema.PATIENT.split()[0]
    (tmp_path / "nested.json").write_text(json.dumps([{field: "p1"}, {field: "p2"}]))
    assert sorted(r[field] for r in readers.patients_json(spark, str(tmp_path / "nested.json")).collect()) == ["p1", "p2"]


def test_scores_of_models_from_folders_and_from_files(spark, tmp_path):
    df = spark.createDataFrame([("dx", "m1", 0.5), ("dx", "m2", 0.25), ("rx", "m1", 1.0)], "category string, model string, score double")
    sinks.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert rows(back.select("category", "model", "score")) == rows(df)
    sinks.save_table(df, str(tmp_path / "parts"), ("model",))
    sinks.save_table(df, str(tmp_path / "parts"), ("model",))
    assert rows(readers.model_tables(spark, str(tmp_path / "parts")).select("category", "model", "score")) == rows(df)
    for m in ("glove", "news"):
        (tmp_path / f"{m}.csv").write_text("term,score\nflu,1\n")
    assert rows(readers.tagged_files(spark, str(tmp_path / "*.csv"))) == [("flu", "1", "glove"), ("flu", "1", "news")]


def test_a_batch_that_runs_again_repeats_no_row(spark, tmp_path):
    src, log, out = (str(tmp_path / n) for n in ("src", "log", "out"))
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, v long").coalesce(1).write.parquet(src)

    def run(checkpoint):
        q = ingest.ingest_stream(spark.readStream.schema("id string, v long").parquet(src), "id", lambda d: d, log, out, str(tmp_path / checkpoint))
        q.awaitTermination()

    run("c1")
    spark.createDataFrame([("b", 2), ("c", 3)], "id string, v long").coalesce(1).write.mode("append").parquet(src)
    run("c1")
    assert rows(spark.read.parquet(out).select("id", "v")) == [("a", 1), ("b", 2), ("c", 3)]


@pytest.fixture
def service():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = "not json" if "broken" in asked["messages"][1]["content"] else json.dumps({"choices": [{"message": {"content": f"said {asked['max_tokens']}"}}]})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    server.shutdown()


def test_model_over_http(service):
    llm = models.HttpLLM(service)
    assert llm.complete("hello", max_tokens=7) == "said 7"
    assert llm.complete("broken").startswith("ERROR:")
    assert models.HttpLLM("http://127.0.0.1:9/none", timeout=1).complete("x").startswith("ERROR:")


def test_blocks_follow_the_number_of_rows(spark, monkeypatch):
    from visitloom.operators import pairs

    df = spark.range(100).select(F.col("id").alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    assert pairs.blocks_for(df) == pairs.LEAST_BLOCKS
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 5)
    assert pairs.blocks_for(df) == 20
    with_nulls = df.unionByName(spark.createDataFrame([(None, [1.0, 2.0]), (200, None)], "k long, v array<double>"))
    assert neighbors.pairwise_metrics(with_nulls, "k", "v").count() == 4950
    near = neighbors.nearest(with_nulls, "k", "v", 2)
    assert near.count() == 200 and neighbors.nearest(df.limit(0), "k", "v", 2).count() == 0
    assert {r["neighbor"] for r in near.where("k = 50").collect()} == {49, 51}
