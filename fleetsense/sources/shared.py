"""The folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder in the warehouse, or with a local master (one machine) a temporary one that goes when Python ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/fleetsense"
    if not found:
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="fleetsense-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        found = _LOCAL[0]
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it again: cuts the lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
