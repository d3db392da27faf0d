"""Counts, progress and samples that one job gathers while it runs."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from visitloom import progress
from visitloom.operators import neighbors, pairs, sampling
from visitloom.streaming import ingest



def test_counts_come_from_the_job_itself(spark):
    calls = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df, seen = progress.counted(spark.range(1000).mapInPandas(touch, "id long"), odd=F.sum(F.col("id") % 2))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get() == {"rows": 1000, "odd": 500} and calls.value == 1000


def test_resume_counts_rows_and_skips_without_a_second_pass(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    src = spark.createDataFrame([(str(i % 10) if i < 28 else None, i) for i in range(30)], "id string, v int")
    through = lambda df: df.mapInPandas(touch, df.schema)
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    first = ingest.resume(spark, src.where("id < '4' OR id IS NULL"), "id", through, log, out)
    assert first == ingest.Round(rows=14, skipped=0, new=4, written=12) and reads.value == 12
    assert ingest.resume(spark, src, "id", through, log, out) == ingest.Round(rows=30, skipped=12, new=6, written=28)
    assert reads.value == 12 + 28 and spark.read.parquet(out).count() == 28
    assert ingest.resume(spark, src, "id", through, log, out) == ingest.Round(rows=30, skipped=28, new=0, written=28)
    empty = ingest.resume(spark, src.limit(0), "id", through, log, out)
    assert empty == ingest.Round(0, 0, 0, 0)


def test_progress_is_reported_and_never_falls(spark):
    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    told = []
    with progress.Progress(spark, told.append, 0.1):
        spark.range(0, 400, 1, 12).mapInPandas(slow, "id long").write.format("noop").mode("overwrite").save()
    done = [t.done for t in told]
    assert len(told) > 2 and done == sorted(done) and told[-1].done == told[-1].total >= 12 and any(0 < t.done < t.total for t in told)


def test_stream_batches_are_counted(spark, tmp_path):
    src, told = str(tmp_path / "in"), {}
    for k in range(3):
        spark.range(k * 6, k * 6 + 10).selectExpr("CAST(id AS STRING) AS id").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(src)
    ingest.ingest_stream(s, "id", lambda df: df.where("id <> '1'"), str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda epoch, r: told.update({epoch: r})).awaitTermination()
    assert sorted(told) == [0, 1, 2] and sum(r.rows for r in told.values()) == 30
    assert sum(r.new for r in told.values()) == 22 and sum(r.skipped for r in told.values()) == 8 and sum(r.written for r in told.values()) == 21
    assert spark.read.parquet(str(tmp_path / "out")).count() == 21


@pytest.mark.parametrize("parts", [1, 70])
def test_bottom_k_is_the_sample_of_all(spark, monkeypatch, parts):
    monkeypatch.setattr(sampling, "FAN_IN", 3)
    words = [f"w{i % 900}" for i in range(4000)] + [None]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(parts)
    got = [r["w"] for r in sampling.bottom_k(df, "w", 40).collect()]
    want = sorted({w for w in words if w}, key=lambda w: (hashlib.md5(f"{w}|42".encode()).hexdigest(), w))[:40]
    assert sorted(got) == sorted(want)
    assert sampling.bottom_k(df, "w", 5000).count() == 900 and sampling.bottom_k(df.limit(0), "w", 5).count() == 0


def test_baseline_of_either_vocabulary(spark):
    model = spark.createDataFrame([(f"w{i}", [1.0, float(i)]) for i in range(50)], "word string, vec array<double>")
    terms = model.where("word IN ('w0', 'w1')")
    assert abs(neighbors.baseline(terms, model, "word", "vec").first()["average_similarity"] - 0.5**0.5) < 1e-12
    both = neighbors.baseline(terms, model, "word", "vec", "model_vocab", 1000).first()
    assert both["n"] == 50 and abs(both["average_similarity"] - neighbors.mean_similarity(model, "word", "vec").first()["average_similarity"]) < 1e-9
    with pytest.raises(ValueError):
        neighbors.baseline(terms, model, "word", "vec", "all")


def test_vectors_are_sent_as_often_from_any_size(spark):
    """A row goes to so many cells; their number may not grow with the table."""
    assert [pairs.vector_blocks(spark.range(n)) for n in (2_000, 12_000, 120_000, 720_000)] == [pairs.LEAST_BLOCKS] * 4
    assert pairs.vector_blocks(spark.range(pairs.MOST_ROWS * 20)) == 20
