"""Tables written between the steps of a job that needs more than one action."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# for sessions whose entry point has named a folder, by application
_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _ROOTS.get(spark.sparkContext.applicationId)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def use_local_scratch(spark: SparkSession) -> None:
    """For tests, benchmarks and checks on one machine: a new folder, only where none is set."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.applicationId in _ROOTS:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _ROOTS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    This cuts the lineage: a lost executor re-reads the table, it does not
    re-run the loop that made it. The file sizes also give the planner real
    statistics, so it broadcasts only what is measured to be small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
