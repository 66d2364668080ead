"""A session with the settings that the engine expects: UTC, adaptive plans, ANSI arithmetic."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """``PYTHONPATH`` or ``--py-files`` has to bring the package to executors on other machines."""
    builder = SparkSession.builder.appName("sparrowmill").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", partitions)
    return builder.getOrCreate()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share; a local one only where the session runs on one machine and names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparrowmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return os.path.join(path.rstrip("/"), f"{tag}-{uuid.uuid4().hex}")
