"""Sources: flat tables, positional tables, nested records, word vectors, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..stages import exists
from .wordvectors import word_vectors_binary  # noqa: F401


def flat_csv(spark: SparkSession, path: str, ddl: str, drop_malformed: bool = True) -> DataFrame:
    """A CSV with a header. Columns of ``ddl`` have its types, all others are strings; malformed rows go or are counted in ``_corrupt_record``."""
    wanted = {f.name: f for f in T._parse_datatype_string(ddl).fields}
    header = spark.read.option("header", True).csv(path).columns
    fields = [wanted.get(c, T.StructField(c, T.StringType())) for c in header]
    if not drop_malformed:
        fields.append(T.StructField("_corrupt_record", T.StringType()))
    mode = "DROPMALFORMED" if drop_malformed else "PERMISSIVE"
    return spark.read.option("header", True).option("mode", mode).option("enforceSchema", False).schema(T.StructType(fields)).csv(path)


def flat_tables(spark: SparkSession, root: str, names=tuple(schema.TABLES)) -> dict[str, DataFrame]:
    """All flat tables of a folder; a missing file gives an empty table with the named columns."""
    out = {}
    for n in names:
        path = f"{root}/{n}.csv"
        out[n] = flat_csv(spark, path, schema.TABLES[n]) if exists(spark, path) else spark.createDataFrame([], schema.TABLES[n])
    return out


def positional_csv(spark: SparkSession, path: str, names: tuple[str, ...] = ("term", "code")) -> DataFrame:
    """The first columns of a CSV by position, whatever its header calls them."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, names)])


def patients_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested records: one JSON array, or one record a line."""
    return spark.read.schema(schema.PATIENT).option("multiLine", not lines).json(path)


def records_json(spark: SparkSession, path: str, ddl: str | None = None, lines: bool = False) -> DataFrame:
    r = spark.read.option("multiLine", not lines)
    return (r.schema(ddl) if ddl else r).json(path)


def model_tables(spark: SparkSession, root: str) -> DataFrame:
    """Scores of all models and categories: partition folders become columns."""
    return spark.read.parquet(root)


def tagged_files(spark: SparkSession, glob: str, column: str = "model") -> DataFrame:
    """CSV files of several models in one table, tagged with the name of their file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    return spark.read.option("header", True).csv(glob).withColumn(column, name)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' AND NOT startswith(id, '#')")


def word_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 .. vd`` a line, with or without a header line of two numbers."""
    parts = F.split(F.regexp_replace("value", r"\s+$", ""), " ")
    df = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return df.select(F.get("p", F.lit(0)).alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.try_cast("double")).alias("vec"))


def rows_where(df: DataFrame, column: str, value) -> DataFrame:
    """The point query: a literal, never text pasted into SQL."""
    return df.where(F.col(column) == F.lit(value))


def rows_in(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The IN-list query, as a semi-join."""
    return df.join(keys.select(column), column, "left_semi")


def first_keys(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first distinct keys, in order: a peek."""
    return df.select(column).distinct().orderBy(column).limit(n)


def peek(df: DataFrame, n: int = 5) -> dict:
    """Rows, columns, emptiness and the first rows."""
    return {"rows": df.count(), "columns": df.columns, "empty": df.isEmpty(), "head": df.take(n)}
