"""Tables and folders that driver and executors share, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new name there. Where the setting is unset, in local mode a temporary folder that goes with the process, on a cluster an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="celestrum-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/celestrum-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: cuts the lineage, so later steps don't compute it again, and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
