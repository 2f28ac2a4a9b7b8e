"""What a Spark session needs before it runs this package's Python functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application, through the driver's file server."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="manyview-")  # the server reads the file when an executor asks for it
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = Path(folder) / "copy"
        shutil.copytree(package, copy / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", copy))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in spark.checkpoint.dir; a temporary one where it names
    none and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not context.getCheckpointDir() and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="manyview-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
