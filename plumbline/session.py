"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(name: str = "plumbline", master: str | None = None, **settings: object) -> SparkSession:
    """A session with adaptive execution and UTC times; ``settings`` use ``_`` for ``.``.

    Looking up a call site for every column expression is switched off: the expressions of a
    wide table's metrics are built here, and their call sites would tell the user nothing.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), str(value))
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can reach.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="plumbline-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
