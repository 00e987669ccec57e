"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000  # the JVM compiles no longer method

_own_folder: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """The folder of this application below the one the session or its context names.

    Only a session of one machine without the setting gets a folder of its own;
    elsewhere a machine-local folder would be lost with its machine, and other
    executors could not read it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        named = _own_folder.get(context.applicationId) or tempfile.mkdtemp(prefix="surveyloom-")
        _own_folder[context.applicationId] = named
    return f"{named.rstrip('/')}/surveyloom/{context.applicationId}"


def scratch_folder(spark: SparkSession) -> str:
    """A fresh path for one table."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a later stage that loses an executor re-reads the
    file instead of recomputing, and every reader sees the same rows.  Being
    Parquet, the copy also gives the planner its true size.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_wide(df: DataFrame) -> DataFrame:
    """``settle`` for projections of many long expressions.

    Fused into one method they pass what the JVM compiles, and every row is
    interpreted.  Above this limit Spark cuts them into methods of their own.
    """
    conf = df.sparkSession.conf
    before = conf.get(METHOD_LIMIT)
    conf.set(METHOD_LIMIT, str(COMPILED_BYTES))
    try:
        return settle(df)
    finally:
        conf.set(METHOD_LIMIT, before)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables this application has settled; call it once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
