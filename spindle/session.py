"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Timestamps are naive local times: a UTC session keeps every calendar
    function on them free of daylight-saving shifts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def get_session(app: str = "spindle", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint directory of the session, which all executors share on a
    cluster. Only a session whose driver runs all tasks itself gets a temporary
    folder when none is set."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spindle-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a small derived table that several branches of a plan use, so
    that none of them derives it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
