"""Spark session with the settings that the engine's results rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Days are zone-less in the data model; ANSI errors beat silent nulls; AQE sizes shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "gristmill", **extra: str) -> SparkSession:
    """The running session, or a new one; master only where spark-submit has not set it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: once a context, as an archive that Spark serves to them.

    Local workers that find it through PYTHONPATH already are left alone.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    known = sc.master.startswith("local") and str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if known or getattr(sc, "_gristmill_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gristmill-')}/gristmill", "zip", root, "gristmill")
    sc.addPyFile(archive)
    sc._gristmill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
