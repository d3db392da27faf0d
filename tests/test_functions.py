"""Hand-worked cases of the text and vector functions."""

import math

import pytest
from pyspark.sql import functions as F

from visitloom.functions import prompts, text
from visitloom.functions import vectors as V
from visitloom.operators import records, stats


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_clean_term_variant_a(spark):
    raw = [None, " Nosebleed ", "Asthma, unspecified", "Diabetes(250.1) x", "pain (250) y", "Flu (HCC 12)", "burn (CMS/hcc)", "at 3 oclock position lump", "pain due to fall", '"Q\'s"', "a  b; c:"]
    assert values(spark, raw, text.clean_term) == ["", "ebleed", "asthma", "diabetes x", "pain (250) y", "flu", "burn", "lump", "pain", "qs", "a b c"]


def test_clean_term_variant_b(spark):
    raw = ["Flu (HCC 12), nos", "x 250.12 y", "a, b", "unspecified; injury:"]
    assert values(spark, raw, lambda c: text.clean_term(c, "B")) == ["flu,", "x y", "a, b", "injury"]


def test_chapters(spark):
    codes = ["A01", "b2", "D50", "U07", "9x", "", None, "z00"]
    infectious = text.CHAPTERS["A"]
    assert values(spark, codes, text.chapter) == [infectious, infectious, "Neoplasms", "Other", "Other", None, None, text.CHAPTERS["Z"]]


def test_scores(spark):
    replies = ["Score: 7.5/9", "10", "none", "ERROR: code 500", "8"]
    assert values(spark, replies, text.score_of) == [7.5, 1.0, None, None, 8.0]


def test_clean_reply(spark):
    raw = ['```json\n{"summary": "a  b"}\n```', '{"patient_summary": "p", "summary": "s"}', "<think>x\ny</think> text [aside] more", "plain  text", "```json\n{broken\n```"]
    assert values(spark, raw, text.clean_reply) == ["a b", "p", "text more", "plain text", "```json {broken ```"]


def test_prediction_is_parsed_from_the_raw_reply(spark):
    raw = ['```json\n{"predicted_visit": {"diagnoses": ["a", "b"], "medications": [], "treatments": ["t"]}}\n```', "no json"]
    out = values(spark, raw, text.prediction_of)
    assert out[0]["diagnoses"] == ["a", "b"] and out[0]["medications"] == [] and out[1] is None


def test_sentence(spark):
    df = spark.createDataFrame([(["a", None, ""], [], ["t"]), ([], None, [""])], "d array<string>, m array<string>, t array<string>")
    assert [r[0] for r in df.select(text.sentence(F.col("d"), F.col("m"), F.col("t"))).collect()] == ["Diagnoses: a; Treatments: t", text.NO_RECORD]


def test_synonym(spark):
    reply = '[{"meanings": [{"definitions": [{"synonyms": ["pain", "a b c d e"]}, {"synonyms": ["Ache"]}]}, {"definitions": null}]}]'
    out = spark.createDataFrame([(reply, "pain"), ("[]", "pain"), ("junk", "pain")], "r string, t string").select(text.synonym_of(F.col("r"), F.col("t")))
    assert [r[0] for r in out.collect()] == ["ache", "", ""]


def test_prompts(spark):
    df = spark.createDataFrame([(["s0", "s1", "s2"], [])], "s array<string>, n array<string>")
    n, p = df.select(prompts.narrative(F.col("s"), 2), prompts.prediction(F.lit("h"), F.col("n"))).first()
    assert n.endswith("\nVisit 0:\ns0\n\nVisit 1:\ns1\n") and "s2" not in n
    assert "[Patient History]\n    h" in p and prompts.NO_NEIGHBORS in p


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-3.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in got] == [0.0, 1.0, 0.0, -1.0]
    assert got[3][1] == 4.0
    assert df.select(V.mean_pool(F.array("a", "b"))).first()[0] == [0.5, 1.0]


def test_scrub(spark):
    df = spark.sql("SELECT 'N/A' s, double('nan') x, cast(1.5 as decimal(4,2)) d, 'ok' t")
    r = records.scrub(df).first()
    assert r["s"] is None and r["x"] is None and r["d"] == 1.5 and r["t"] == "ok"


def test_spearman_p():
    assert stats.spearman_p(0.0, 10) == pytest.approx(1.0)
    assert stats.spearman_p(0.632, 10) == pytest.approx(0.0498, abs=1e-3)
    assert math.isnan(stats.spearman_p(0.5, 2))
