"""From flat tables to nested records: null scrubbing, id checks, nesting, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

# Strings that stand for a missing value.
SENTINELS = ["NaN", "nan", "None", "none", "NULL", "null", "N/A", "n/a", ""]


def scrub(df: DataFrame, sentinels: bool = True) -> DataFrame:
    """NaN and sentinel strings to null, decimals to double; all other values unchanged."""
    def clean(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType) and sentinels:
            c = F.when(~c.isin(SENTINELS), c)
        return c.alias(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def valid_id(c: Column) -> Column:
    """An id without white space around it; null if nothing is left."""
    s = strip(c.cast("string"))
    return F.when(s != "", s)


def rest_of(df: DataFrame, *keys: str) -> Column:
    """All columns but the keys, as a struct."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])


def children(df: DataFrame, key: str, name: str, order: list[str] | None = None) -> DataFrame:
    """One row a key with the list of its rows, in the order of the given columns, then of all: folded before any join, so nothing multiplies."""
    own = [c for c in df.columns if c != key]
    first = [c for c in order or [] if c in own]
    row = F.struct(*[F.col(f"`{c}`") for c in [*first, *[c for c in own if c not in first]]])
    sorted_rows = F.array_sort(F.collect_list(row))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(sorted_rows, lambda r: F.struct(*[r[c].alias(c) for c in own])).alias(name))


def children_by(df: DataFrame, key: str, kind: str, fields: dict[str, tuple[str, dict[str, str]]], order: list[str] | None = None) -> DataFrame:
    """One row a key with a list for each kind of its rows: ``children`` of several kinds from one scan and one shuffle.

    ``fields`` names each list, the kind that it holds and what its rows have: ``{list: (kind, {field: column})}``. Rows are in the order of the
    given columns, then of all; a key without rows of a kind has an empty list. Null keys go.
    """
    first = order or []
    lists = []
    for name, (tag, named) in fields.items():
        row = F.struct(*[F.col(c) for c in first], *[F.col(c).alias(f) for f, c in named.items() if f not in first])
        kept = F.array_sort(F.collect_list(F.when(F.col(kind) == tag, row)))
        lists.append(kept.alias(name))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*lists)


def nest(person: DataFrame, encounters: DataFrame, tables: dict[str, DataFrame] | DataFrame, person_id: str = "person_id", owner: str = "PatientEpicId_SH",
         encounter_id: str = "EncounterId_SH", order: list[str] | None = None, drop_unidentified: bool = False) -> DataFrame:
    """patient_id, demographics, encounters: one row per person, persons without encounters included.

    ``tables`` are the child tables by the name of their list, or one table of lists by encounter (``children_by``).

    Encounters without an id keep no children; ``drop_unidentified`` leaves them out. A repeated encounter id gets all
    its children each time. Encounters are listed by their id.
    """
    e = encounters.withColumn(encounter_id, valid_id(F.col(encounter_id)))
    if drop_unidentified:
        e = e.where(F.col(encounter_id).isNotNull())
    e = e.withColumn("__details", rest_of(encounters, owner, encounter_id)).select(owner, encounter_id, "__details")
    if isinstance(tables, DataFrame):
        folded = [tables]
    else:
        folded = [children(t.withColumn(encounter_id, valid_id(F.col(encounter_id))), encounter_id, name, order) for name, t in tables.items()]
    names = [c for t in folded for c in t.columns if c != encounter_id]
    for t in folded:
        e = e.join(t, encounter_id, "left")
    e = e.withColumns({n: F.coalesce(F.col(n), F.array().cast(e.schema[n].dataType)) for n in names})
    row = F.struct(F.col(encounter_id).alias("encounter_id"), F.col("__details").alias("details"), *names)
    lists = e.groupBy(F.col(owner).cast("string").alias("patient_id")).agg(F.array_sort(F.collect_list(row)).alias("encounters"))
    p = person.select(F.col(person_id).cast("string").alias("patient_id"), rest_of(person, person_id).alias("demographics"))
    out = p.join(lists, "patient_id", "left")
    return out.withColumn("encounters", F.coalesce("encounters", F.array().cast(out.schema["encounters"].dataType)))


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id the log does not have."""
    return df.join(done.select(F.col(done.columns[0]).alias(key)), key, "left_anti")


def processed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(F.col(done.columns[0]).alias(key)), key, "left_semi")


def lookup_or_miss(left: DataFrame, rights: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that every right table has, joined; and a table (key, missing) of the others in place of log lines."""
    out = left
    for name, r in rights.items():
        out = out.join(r.withColumn(f"__{name}", F.lit(True)), key, "left")
    missing = F.concat_ws(",", *[F.when(F.col(f"__{n}").isNull(), F.lit(n)) for n in rights])
    flags = [f"__{n}" for n in rights]
    return out.where(missing == "").drop(*flags), out.where(missing != "").select(key, missing.alias("missing"))
