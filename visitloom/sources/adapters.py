"""The driver's star schema seen as health records: customers are patients, orders visits, order lines what was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentence
from ..operators.records import children_by
from ..operators.stats import numbered
from ..operators.visits import index_visits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persons(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").cast("string").alias("person_id"), "c_name", "c_mktsegment", "c_acctbal", "n_name", "r_name")


def encounters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("PatientEpicId_SH"), F.col("o_orderkey").cast("string").alias("EncounterId_SH"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("StartVisit"), F.col("o_orderstatus").alias("PatientType"), F.col("o_orderpriority").alias("PatientClass"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """encounter_id, category, name, code and an order of the rows of each visit."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(p, F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("l_returnflag")
    category = F.when(flag == "A", "diagnoses").when(flag == "N", "medications").otherwise("treatments")
    return j.select(F.col("l_orderkey").cast("string").alias("encounter_id"), category.alias("category"), F.col("p_name").alias("name"),
                    F.upper(F.substring(F.md5("p_name"), 1, 3)).alias("code"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))


def child_lists(spark: SparkSession, d: str) -> DataFrame:
    """EncounterId_SH and its diagnoses, medications and procedures, from one scan."""
    place = {"line": "line", "part": "part"}
    return children_by(items(spark, d).withColumnRenamed("encounter_id", "EncounterId_SH"), "EncounterId_SH", "category", {
        "diagnoses": ("diagnoses", {**place, "Diagnosis_1_Code": "code", "Diagnosis_Name": "name"}),
        "medications": ("medications", {**place, "MedSimpleGenericName": "name"}),
        "procedures": ("treatments", {**place, "CPT_Procedure_Description": "name"}),
    }, ["line", "part"])


def visits(spark: SparkSession, d: str) -> DataFrame:
    """patient_id, encounter_id, start, visit_idx."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("encounter_id"),
                                         F.col("o_orderdate").alias("start"), "o_orderkey")
    return index_visits(o, F.col("start"), F.col("o_orderkey")).drop("o_orderkey")


def visit_names(spark: SparkSession, d: str) -> DataFrame:
    """``visits`` with the lists of names of each category."""
    row = F.struct("line", "part", "name")
    per = [F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, row))), lambda r: r["name"]).alias(c) for c in ("diagnoses", "medications", "treatments")]
    lists = items(spark, d).groupBy("encounter_id").agg(*per)
    out = visits(spark, d).join(lists, "encounter_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("diagnoses", "medications", "treatments")})


def visit_counts(spark: SparkSession, d: str) -> DataFrame:
    """``visits`` with how many names of each category a visit has: counts are folded before they are sent, names are not."""
    counts = items(spark, d).groupBy("encounter_id").agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("diagnoses", "medications", "treatments")])
    return visits(spark, d).join(counts, "encounter_id", "left").na.fill(0, ["diagnoses", "medications", "treatments"])


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return visit_names(spark, d).withColumn("sentence", sentence(F.col("diagnoses"), F.col("medications"), F.col("treatments")))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """term, code, key: names of parts with their types as terms, brands with a size class as codes."""
    return table(spark, d, "part").select(
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("term"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("code"), F.col("p_partkey").alias("key"), "p_brand", "p_size", "p_name")


def term_vectors(spark: SparkSession, d: str) -> DataFrame:
    """term, vec: part names in order take the vectors in order."""
    n = numbered(table(spark, d, "part").select("p_name").distinct(), "p_name", "vec_id")
    return n.join(table(spark, d, "embeddings"), "vec_id").select(F.col("p_name").alias("term"), F.col("embedding").alias("vec"))
