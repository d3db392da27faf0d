"""Chronological visits, history windows and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten_visits(patients: DataFrame, start: str = "StartVisit") -> DataFrame:
    """Nested records to one row a visit, ``details`` hoisted, ``procedures`` called treatments, indexed in time."""
    v = patients.select("patient_id", F.posexplode("encounters").alias("__pos", "e"))
    names = [f.name for f in v.schema["e"].dataType.fields if f.name != "details"]
    details = [f.name for f in v.schema["e"].dataType["details"].dataType.fields if f.name not in names]
    cols = [F.col(f"e.{c}").alias("treatments" if c == "procedures" else c) for c in names] + [F.col(f"e.details.{c}").alias(c) for c in details]
    return index_visits(v.select("patient_id", "__pos", *cols), F.try_to_timestamp(F.col(start)), F.col("__pos")).drop("__pos")


def index_visits(visits: DataFrame, start: Column, position: Column, patient: str = "patient_id") -> DataFrame:
    """``visits`` with visit_idx, dense from 0: by time, missing times last, ties by position."""
    w = Window.partitionBy(patient).orderBy(start.asc_nulls_last(), position)
    return visits.withColumn("visit_idx", (F.row_number().over(w) - 1).cast("int"))


def windows(visits: DataFrame, value: Column, n: int, patient: str = "patient_id") -> DataFrame:
    """patient, end_idx, window: the values of exactly ``n`` visits that end at each visit; none for shorter histories."""
    w = Window.partitionBy(patient).orderBy("visit_idx").rowsBetween(-(n - 1), 0)
    return visits.select(patient, F.col("visit_idx").alias("end_idx"), F.collect_list(value).over(w).alias("window")).where(F.col("end_idx") >= n - 1)


def prefixes(visits: DataFrame, value: Column, patient: str = "patient_id") -> DataFrame:
    """patient, visit_idx, history: the values up to and with each visit."""
    w = Window.partitionBy(patient).orderBy("visit_idx").rowsBetween(Window.unboundedPreceding, 0)
    return visits.select(patient, "visit_idx", F.collect_list(value).over(w).alias("history"))


def with_min_history(visits: DataFrame, n: int, strict: bool = True, patient: str = "patient_id") -> DataFrame:
    """patient, n_visits of those with more than ``n`` visits (at least ``n`` if not strict)."""
    c = visits.groupBy(patient).agg(F.count("*").alias("n_visits"))
    return c.where(F.col("n_visits") > n if strict else F.col("n_visits") >= n)


def nth_visit(visits: DataFrame, n: int, target_offset: int = 0) -> DataFrame:
    """The visit that a prediction from ``n`` visits is about: index ``n``; ``target_offset=-1`` is the last context visit."""
    return visits.where(F.col("visit_idx") == n + target_offset)


def first_qualifying(history: Column) -> Column:
    """Of a list of name lists, the first name of the last list that begins with one."""
    firsts = F.transform(F.reverse(history), lambda names: F.get(names, F.lit(0)))
    return F.get(F.filter(firsts, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def readmissions(visits: DataFrame, start: Column, days: int = 30, patient: str = "patient_id") -> DataFrame:
    """``visits`` with days_to_next and readmitted: whether the next visit starts within ``days``; null for the last."""
    w = Window.partitionBy(patient).orderBy("visit_idx")
    gap = F.datediff(F.lead(start).over(w), start)
    return visits.withColumn("days_to_next", gap).withColumn("readmitted", (gap <= days).cast("int"))


def neighbor_histories(neighbors: DataFrame, visits: DataFrame, value: Column) -> DataFrame:
    """``neighbors`` with the neighbour's history up to and with its matched visit; neighbours without that visit go.

    Visits are gathered once for each (neighbour, matched visit) that is asked for, not for every prefix of every patient.
    """
    asked = neighbors.select("neighbor_id", "neighbor_vidx").distinct()
    seen = visits.select(F.col("patient_id").alias("neighbor_id"), "visit_idx", value.alias("__value"))
    rows = asked.join(seen, "neighbor_id").where(F.col("visit_idx") <= F.col("neighbor_vidx"))
    listed = F.array_sort(F.collect_list(F.struct("visit_idx", "__value")))
    h = rows.groupBy("neighbor_id", "neighbor_vidx").agg(F.max("visit_idx").alias("__last"), F.transform(listed, lambda v: v["__value"]).alias("history"))
    return neighbors.join(h.where("__last = neighbor_vidx").drop("__last"), ["neighbor_id", "neighbor_vidx"])
