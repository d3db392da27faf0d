"""Queries over histories: nesting, indexing, windows, sentences, resuming, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import records, visits as V
from ..sources import adapters as A
from ..sources import readers

N = 6  # visits in a window

VISITS = """visits AS (SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS encounter_id, o_orderdate AS start,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) - 1 AS INT) AS visit_idx FROM orders)"""
ITEMS = """items AS (SELECT CAST(l_orderkey AS VARCHAR) AS encounter_id,
  CASE l_returnflag WHEN 'A' THEN 'diagnoses' WHEN 'N' THEN 'medications' ELSE 'treatments' END AS category,
  p_name AS name, upper(substr(md5(p_name), 1, 3)) AS code, l_linenumber AS line, l_partkey AS part FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SENTENCES = f"""{VISITS}, {ITEMS}, parts AS (SELECT encounter_id, category, string_agg(name, ', ' ORDER BY line, part, name) AS names FROM items GROUP BY 1, 2),
sentences AS (SELECT patient_id, v.encounter_id, start, visit_idx, coalesce(nullif(concat_ws('; ',
  'Diagnoses: ' || (SELECT names FROM parts p WHERE p.encounter_id = v.encounter_id AND category = 'diagnoses'),
  'Medications: ' || (SELECT names FROM parts p WHERE p.encounter_id = v.encounter_id AND category = 'medications'),
  'Treatments: ' || (SELECT names FROM parts p WHERE p.encounter_id = v.encounter_id AND category = 'treatments')), ''),
  'No information recorded for this visit.') AS sentence FROM visits v)"""


def _nested(spark, d):
    return records.nest(A.persons(spark, d), A.encounters(spark, d), A.child_lists(spark, d))


def patient_nested_counts(spark, d):
    total = lambda c: F.aggregate(F.transform("encounters", lambda e: F.size(e[c])), F.lit(0), lambda s, x: s + x)
    return _nested(spark, d).select("patient_id", F.size("encounters").alias("n_encounters"), total("diagnoses").alias("n_diagnoses"),
                                    total("medications").alias("n_medications"), total("procedures").alias("n_procedures"))


def nested_visits(spark, d):
    v = V.flatten_visits(_nested(spark, d))
    return v.select("patient_id", "encounter_id", "visit_idx", F.size("diagnoses").alias("n_diagnoses"), F.size("treatments").alias("n_treatments"))


def visit_index(spark, d):
    return A.visits(spark, d).select("patient_id", "encounter_id", "visit_idx")


def visit_sentence(spark, d):
    return A.sentences(spark, d).select("patient_id", "visit_idx", "sentence")


def history_windows(spark, d):
    w = V.windows(A.sentences(spark, d), F.col("sentence"), N)
    return w.select("patient_id", "end_idx", F.array_join("window", " | ").alias("history"))


def window_terms(spark, d):
    v = A.visit_names(spark, d)
    t = v.withColumn("terms", text.visit_terms(F.col("diagnoses"), F.col("medications"), F.col("treatments")))
    w = V.windows(t, F.col("terms"), N)
    return w.select("patient_id", "end_idx", F.size(F.flatten("window")).alias("n_terms"), F.array_join(F.flatten("window"), ",").alias("terms"))


def history_prefix(spark, d):
    p = V.prefixes(A.visits(spark, d), F.col("encounter_id"))
    return p.select("patient_id", "visit_idx", F.array_join("history", ",").alias("history"))


def min_history_patients(spark, d):
    return V.with_min_history(A.visits(spark, d), N)


def null_scrub(spark, d):
    raw = F.when(F.col("o_orderpriority").startswith("5"), "N/A").when(F.col("o_orderpriority").startswith("4"), "nan").when(F.col("o_orderpriority").startswith("3"), "").otherwise(F.col("o_orderpriority"))
    odd = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    o = A.table(spark, d, "orders").select("o_orderkey", raw.alias("priority"), odd.alias("price"))
    return records.scrub(o).select("o_orderkey", "priority", "price")


def dx_codes(spark, d):
    i = A.items(spark, d).where("category = 'diagnoses'")
    return i.select("encounter_id", "line", "part", "code", text.chapter(F.col("code")).alias("chapter"))


def buckets(spark, d):
    i = A.items(spark, d).where("category = 'diagnoses'").join(A.visits(spark, d).select("encounter_id", "patient_id"), "encounter_id")
    return i.select(text.chapter(F.col("code")).alias("chapter"), "patient_id").where("chapter IS NOT NULL").distinct()


def dx_buckets(spark, d):
    return buckets(spark, d).groupBy("chapter").agg(F.count("*").alias("n_patients"), F.array_join(F.array_sort(F.collect_set("patient_id")), ",").alias("patients"))


def dx_bucket_members(spark, d):
    """One row for each patient of a chapter, numbered in order: the listing without a list that grows with the patients."""
    b = buckets(spark, d)
    return b.withColumn("place", F.row_number().over(Window.partitionBy("chapter").orderBy("patient_id")))


def _log(spark, d):
    return A.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("id"))


def resume_anti(spark, d):
    return records.unprocessed(A.persons(spark, d).select("person_id", "c_name"), _log(spark, d), "person_id")


def resume_semi(spark, d):
    return records.processed(A.persons(spark, d).select("person_id", "c_name"), _log(spark, d), "person_id")


def first_qualifying_dx(spark, d):
    h = V.prefixes(A.visit_names(spark, d), F.col("diagnoses"))
    return h.select("patient_id", "visit_idx", V.first_qualifying(F.col("history")).alias("diagnosis"))


def readmission_label(spark, d):
    return V.readmissions(A.visits(spark, d), F.col("start").cast("date")).select("patient_id", "visit_idx", "days_to_next", "readmitted")


def target_visit(spark, d):
    return V.nth_visit(A.sentences(spark, d), N).select("patient_id", "visit_idx", "sentence")


def distinct_keys_peek(spark, d):
    return readers.first_keys(A.encounters(spark, d), "PatientEpicId_SH", 10)


def encounter_children_semi(spark, d):
    late = A.encounters(spark, d).where("PatientType = 'F'")
    i = A.items(spark, d).withColumnRenamed("encounter_id", "EncounterId_SH")
    return readers.rows_in(i, late, "EncounterId_SH").groupBy("category").agg(F.count("*").alias("n"))


def join_or_miss(spark, d):
    v = A.visits(spark, d).groupBy("patient_id").agg(F.count("*").alias("n_visits"))
    rights = {"visits": v, "history": V.with_min_history(A.visits(spark, d), N).select("patient_id")}
    good, missed = records.lookup_or_miss(A.persons(spark, d).select(F.col("person_id").alias("patient_id")), rights, "patient_id")
    return good.select("patient_id", F.lit("").alias("missing")).unionByName(missed)


QUERIES = {f.__name__: f for f in (
    patient_nested_counts, nested_visits, visit_index, visit_sentence, history_windows, window_terms, history_prefix, min_history_patients, null_scrub, dx_codes, dx_buckets, dx_bucket_members,
    resume_anti, resume_semi, first_qualifying_dx, readmission_label, target_visit, distinct_keys_peek, encounter_children_semi, join_or_miss)}

CHAPTER = "CASE " + " ".join(f"WHEN substr(code, 1, 1) = '{k}' THEN '{v}'" for k, v in text.CHAPTERS.items()) + " ELSE 'Other' END"
SQL = {
    "patient_nested_counts": f"""WITH {ITEMS}, c AS (SELECT encounter_id, count(*) FILTER (category = 'diagnoses') AS a, count(*) FILTER (category = 'medications') AS b,
  count(*) FILTER (category = 'treatments') AS c FROM items GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS patient_id, count(o_orderkey)::INT AS n_encounters, coalesce(sum(a), 0)::INT AS n_diagnoses, coalesce(sum(b), 0)::INT AS n_medications,
  coalesce(sum(c), 0)::INT AS n_procedures FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN c ON encounter_id = CAST(o_orderkey AS VARCHAR) GROUP BY 1""",
    "visit_index": f"WITH {VISITS} SELECT patient_id, encounter_id, visit_idx FROM visits",
    "visit_sentence": f"WITH {SENTENCES} SELECT patient_id, visit_idx, sentence FROM sentences",
    "history_windows": f"""WITH {SENTENCES}, w AS (SELECT patient_id, visit_idx AS end_idx, string_agg(sentence, ' | ') OVER (PARTITION BY patient_id ORDER BY visit_idx ROWS {N - 1} PRECEDING) AS history FROM sentences)
SELECT * FROM w WHERE end_idx >= {N - 1}""",
    "window_terms": f"""WITH {VISITS}, {ITEMS}, t AS (SELECT patient_id, visit_idx, string_agg(lower(name), ',' ORDER BY category, line, part, name) AS s, count(name) AS n FROM visits v LEFT JOIN items i ON v.encounter_id = i.encounter_id GROUP BY 1, 2),
w AS (SELECT patient_id, visit_idx AS end_idx, (sum(n) OVER x)::INT AS n_terms, coalesce(string_agg(s, ',') OVER x, '') AS terms FROM t WINDOW x AS (PARTITION BY patient_id ORDER BY visit_idx ROWS {N - 1} PRECEDING))
SELECT * FROM w WHERE end_idx >= {N - 1}""",
    "history_prefix": f"WITH {VISITS} SELECT patient_id, visit_idx, string_agg(encounter_id, ',') OVER (PARTITION BY patient_id ORDER BY visit_idx ROWS UNBOUNDED PRECEDING) AS history FROM visits",
    "min_history_patients": f"SELECT CAST(o_custkey AS VARCHAR) AS patient_id, count(*) AS n_visits FROM orders GROUP BY 1 HAVING count(*) > {N}",
    "null_scrub": """SELECT o_orderkey, CASE WHEN o_orderpriority[1] IN ('3', '4', '5') THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders""",
    "dx_codes": f"WITH {ITEMS} SELECT encounter_id, line, part, code, {CHAPTER} AS chapter FROM items WHERE category = 'diagnoses'",
    "dx_buckets": f"""WITH {ITEMS}, b AS (SELECT DISTINCT {CHAPTER} AS chapter, CAST(o_custkey AS VARCHAR) AS patient_id FROM items JOIN orders ON encounter_id = CAST(o_orderkey AS VARCHAR) WHERE category = 'diagnoses')
SELECT chapter, count(*) AS n_patients, string_agg(patient_id, ',' ORDER BY patient_id) AS patients FROM b GROUP BY 1""",
    "dx_bucket_members": f"""WITH {ITEMS}, b AS (SELECT DISTINCT {CHAPTER} AS chapter, CAST(o_custkey AS VARCHAR) AS patient_id FROM items JOIN orders ON encounter_id = CAST(o_orderkey AS VARCHAR) WHERE category = 'diagnoses')
SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY patient_id)::INT AS place FROM b""",
    "resume_anti": "SELECT CAST(c_custkey AS VARCHAR) AS person_id, c_name FROM customer WHERE NOT c_acctbal < 0",
    "resume_semi": "SELECT CAST(c_custkey AS VARCHAR) AS person_id, c_name FROM customer WHERE c_acctbal < 0",
    "first_qualifying_dx": f"""WITH {VISITS}, {ITEMS}, f AS (SELECT encounter_id, arg_min(name, (line, part, name)) AS first FROM items WHERE category = 'diagnoses' GROUP BY 1),
v AS (SELECT patient_id, visit_idx, first FROM visits LEFT JOIN f USING (encounter_id))
SELECT patient_id, visit_idx, last_value(first IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY visit_idx ROWS UNBOUNDED PRECEDING) AS diagnosis FROM v""",
    "readmission_label": f"""WITH {VISITS}, g AS (SELECT patient_id, visit_idx, CAST(date_diff('day', CAST(start AS DATE), lead(CAST(start AS DATE)) OVER (PARTITION BY patient_id ORDER BY visit_idx)) AS INT) AS days_to_next FROM visits)
SELECT *, CAST(days_to_next <= 30 AS INT) AS readmitted FROM g""",
    "target_visit": f"WITH {SENTENCES} SELECT patient_id, visit_idx, sentence FROM sentences WHERE visit_idx = {N}",
    "distinct_keys_peek": 'SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS "PatientEpicId_SH" FROM orders ORDER BY 1 LIMIT 10',
    "encounter_children_semi": f"WITH {ITEMS} SELECT category, count(*) AS n FROM items WHERE encounter_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "join_or_miss": f"""SELECT CAST(c_custkey AS VARCHAR) AS patient_id, concat_ws(',', CASE WHEN n IS NULL THEN 'visits' END, CASE WHEN coalesce(n, 0) <= {N} THEN 'history' END) AS missing
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
}
SQL["nested_visits"] = f"""WITH {ITEMS}, c AS (SELECT encounter_id, count(*) FILTER (category = 'diagnoses') AS a, count(*) FILTER (category = 'treatments') AS t FROM items GROUP BY 1),
v AS (SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) - 1 AS INT) AS visit_idx FROM orders)
SELECT patient_id, v.encounter_id, visit_idx, coalesce(a, 0)::INT AS n_diagnoses, coalesce(t, 0)::INT AS n_treatments FROM v LEFT JOIN c ON v.encounter_id = c.encounter_id"""
