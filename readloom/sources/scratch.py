"""Folders for files that a query writes and reads back: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a single local process, which has the setting unset, may use a folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="readloom-files-"))
        base = _own[0]
    return f"{base.rstrip('/')}/readloom-{tag}-{uuid.uuid4().hex}"
