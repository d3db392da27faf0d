"""What a session needs before Python of this package runs on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent
        base = f"{tempfile.mkdtemp(prefix=f'{package.name}-')}/{package.name}"
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))


def one_thread() -> None:
    """Let the matrix library of this worker use one thread: every core has a task already, and its threads would wait for each other."""
    import ctypes

    if not Path("/proc/self/maps").exists():
        return
    with open("/proc/self/maps") as maps:
        paths = {line.split(maxsplit=5)[-1].strip() for line in maps if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
