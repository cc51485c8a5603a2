"""Scratch tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder.

    Without ``spark.checkpoint.dir`` a local session, as in tests, gets a temporary folder of this machine; any other fails, as
    its executors would write to folders of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="marlspike-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/marlspike-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no rerun."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
