"""The pipeline on a small table, each stage against what it must do."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from visitloom.llm import tokens

from .helpers import DOCS, prose, words
from .test_free import check_packing


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(11)
    clean = ["\n".join(prose(rng, int(n), 5000) for n in rng.integers(20, 60, 4)) for _ in range(120)]
    shared = prose(rng, 60, 5000)
    texts = clean[:100] + [t + "\n" + shared for t in clean[100:]] + [clean[3]] * 3 + ["too short", None, "### " * 90]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = docs.toPandas()
    assert set(seen["quality rules"].doc_id) == set(range(123))
    lines = seen["line dedup"].set_index("doc_id")
    assert set(lines.index) == set(range(120)) and sum(shared in t for t in lines.text) == 1 and (lines.n_chars == lines.text.str.len()).all()
    assert set(seen["near duplicates"].doc_id) == set(range(120))
    mixed = seen["mixing"]
    assert 60 < len(mixed) <= 120
    enc = tokens.encoder(*tokens.default_paths())
    check_packing(seen["packing"], {i: np.append(enc(t), 1) for i, t in zip(mixed.doc_id, mixed.text)}, 2048)
    assert all(words(t) for t in mixed.text)
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct()
    assert {r[0] for r in again.collect()} == set(mixed.doc_id)


def test_near_stage_keeps_one_of_a_group(spark):
    rng = np.random.default_rng(12)
    t = prose(rng, 200, 5000)
    near = t.replace(t.split()[5], "edit", 1)
    d = spark.createDataFrame([(5, t, "en", "s", 0), (2, near, "en", "s", 0), (9, prose(rng, 200, 5000), "en", "s", 0)], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, d, "").collect()} == {2, 9}
    assert corpus_pipeline.near_stage(spark, d.where(F.lit(False)), "").count() == 0


def test_line_stage_leaves_no_stubs_of_exact_copies(spark):
    rng = np.random.default_rng(13)
    t = prose(rng, 60, 5000) + "\nLes.\n" + prose(rng, 40, 5000)
    d = spark.createDataFrame([(1, t, "fr", "s", 0), (2, t, "fr", "s", 0), (3, "les\n" + prose(rng, 50, 5000), "fr", "s", 0)], DOCS)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, d, "").collect()}
    assert set(out) == {1, 3} and out[1] == t and "les" not in out[3].split("\n")


def test_stages_carry_columns_of_any_name(spark):
    rng = np.random.default_rng(20)
    rows = [(i, prose(rng, 120, 5000), "en", "s", 0) for i in range(60)]
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("topic", "n_tokens", "n_words", "distance", "kept", "n_lines", "n_removed", "probability", "fp", "a b")}
    d = spark.createDataFrame(rows, DOCS).withColumns(extra)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, "")
        assert out.columns == d.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in extra)


def test_near_stage_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(21)
    t, u, v = (prose(rng, 200, 5000) for _ in range(3))
    rows = [(2, t), (5, t), (5, u), (None, t), (None, v), (7, None), (8, ""), (9, u + " end"), (3, v), (3, v)]
    d = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], DOCS)
    got = sorted((r["doc_id"], {t: "t", u: "u", v: "v"}.get(r["text"], r["text"])) for r in corpus_pipeline.near_stage(spark, d, "").collect())
    assert got == [(2, "t"), (3, "v"), (5, "u"), (7, None), (8, "")]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
