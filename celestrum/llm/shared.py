"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, in local mode a temporary folder of its own that goes with the process, on a cluster an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="celestrum-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", where)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{root(spark)}/celestrum-{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path under which workers open files of the shared folder themselves."""
    local = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in local or not local.startswith("/"):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on all machines; spark.checkpoint.dir is {path}")
    return local


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """At most n rows, those with the least hashes of the key, one of each key.

    Hashes are first held against a bound that about twice as many pass, so no
    task hands on more than its share of those, however many tasks there are.
    """
    h = F.shiftrightunsigned(F.xxhash64(*key), 1)
    total = df.count()
    if total > 2 * n:
        df = df.where(h <= int(2 * n / total * (2**63 - 1)))
    return df.dropDuplicates(list(key)).orderBy(h, *key).limit(n)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column has (column names ignore case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
