"""What the operators share: the shared folder, written intermediate tables, words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, return.
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="visitloom-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/visitloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _scratch[app])
    return f"{_scratch[app]}/{what}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already; the folder is then the cluster's to clean
        pass


def written(df: DataFrame, what: str = "table", codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the folder behind a table of ``written`` once nothing lazy reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(spark, folder)


def drop_shuffles(df: DataFrame) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to; it does so only when the driver collects its garbage.

    The driver gives back the memory of these plans and of their generated classes, too.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_CLASS + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept."""
    return F.translate(text, UPPER, LOWER)


def prepare_workers(spark: SparkSession) -> None:
    """Before Python runs on executors: they get this package, and Arrow batches are kept small, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
