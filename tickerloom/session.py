"""Session defaults: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "tickerloom", **conf: str) -> SparkSession:
    """A session with this package's defaults; a cluster's own settings win where `master` is not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> str:
    """Send this package to all executors, where it is not installed or on their PYTHONPATH; the archive's path."""
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tickerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(archive)
    return archive


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir; where unset, a local one of our own, which a cluster refuses."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tickerloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder: every reader sees the same rows, whatever they came from."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
