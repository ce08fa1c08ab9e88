"""SparkSession settings that every query of this library assumes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that are safe to change on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "objsql", **conf: str) -> SparkSession:
    """The active session with RUNTIME applied, or a new one built from ``conf``.

    Master, memory and partition counts belong to the deployment, so they are
    only set when the caller passes them.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folder: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see (spark.checkpoint.dir); where that is unset, in a temporary one if all runs in this process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="objsql-"))
        folder = _own_folder[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
