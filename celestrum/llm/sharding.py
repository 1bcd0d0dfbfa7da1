"""Sharding with byte balance by Karmarkar-Karp differencing.

Rows with equal texts are one group and stay together. Groups are dealt over
tasks by their text's digest; each task differences its own groups into one
partial partition of as many sums as there are shards. Partial partitions are
nodes of the same algorithm: FAN of them are combined in one task, largest
spread first and in opposite order, and so on up a tree until one is left.
Which part became part of which is a table at each step, joined on the way
back down; nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celestrum.llm import shared
from celestrum.llm.differencing import combine

SHARDS = 40
#: Bytes of a row besides its text.
ROW_BYTES = 16
GROUPS_PER_TASK = 20_000
ROWS_PER_BUCKET = 20_000
#: Partial partitions that one task combines.
FAN = 500
#: Parts (of some tens of bytes) up to which their table goes to all tasks.
SMALL = 200_000


def _ends(parent: list[int], slots: np.ndarray) -> np.ndarray:
    """Number in `slots` of the slot that each slot became part of."""
    part = {slot: k for k, slot in enumerate(slots.tolist())}
    out = np.empty(len(parent), dtype=np.int32)
    for k in range(len(parent)):
        r = k
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        out[k] = part[r]
    return out


def _deal(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Of a task's groups (key, bytes): key, task, part, bytes."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    order = np.array(table.column(0).to_pylist(), dtype=object).argsort(kind="stable")
    table = table.take(pa.array(order))
    sizes = table.column(1).to_numpy()
    parent, _, slots = combine([(sizes[k : k + 1], np.array([k])) for k in range(len(sizes))], shards, len(sizes))
    task = TaskContext.get().partitionId()
    out = _ends(parent, slots)
    yield from pa.table({"group": table.column(0), "task": pa.array(np.full(len(out), task), type=pa.int32()), "part": pa.array(out), "bytes": table.column(1)}).to_batches()


def _combine(df: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Partial partitions (task, part, bytes) of one node of the tree become one: `into` is the part that each part goes to."""
    df = df.sort_values(["task", "part"], kind="stable").reset_index(drop=True)
    nodes = [(own["bytes"].to_numpy(), own.index.to_numpy()) for _, own in df.groupby("task")]
    parent, _, slots = combine(nodes, shards, len(df))
    return df.assign(into=_ends(parent, slots))


def assign(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES, groups_per_task: int = GROUPS_PER_TASK, fan: int = FAN) -> DataFrame:
    """docs' columns and size, shard, slot.

    size: UTF-8 bytes of text and row_bytes; slot: a row's number in its shard,
    gapless from 0. Sums of sizes over shards are near equal, as far as groups
    of equal texts allow, which aren't divided: one larger than its share fills
    a shard alone. Null texts are empty, and a group with empty ones. Repeated
    rows count each; columns named size, shard or slot are replaced, others stay,
    whatever their names. No rows: none.
    """
    rows, group = keyed(docs, row_bytes)
    return assign_keyed(rows, group, shards, groups_per_task, fan)


def keyed(docs: DataFrame, row_bytes: int = ROW_BYTES) -> tuple[DataFrame, str]:
    """docs' columns, size and the text's digest, and the latter's name."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop("size", "shard", "slot")
    (group,) = shared.free(docs.columns, "_group")
    return docs.withColumns({"size": F.octet_length(text).cast("long") + row_bytes, group: F.md5(text.cast("binary"))}), group


def shards_of(groups: DataFrame, shards: int, groups_per_task: int, fan: int) -> DataFrame:
    """group, shard of groups (group, bytes)."""
    tasks = max(1, -(-groups.count() // groups_per_task))
    dealt = groups.repartition(tasks, "group").mapInArrow(lambda it: _deal(it, shards), "group string, task int, part int, bytes bigint")
    dealt = shared.written(dealt, "dealt")
    nodes = (dealt.agg(F.max("task")).first()[0] or 0) + 1
    parts, steps = dealt.groupBy("task", "part").agg(F.sum("bytes").alias("bytes")), []
    while not steps or nodes > 1:
        above = -(-nodes // fan)
        tree = parts.withColumn("up", F.floor(F.col("task") / fan).cast("int")).repartition(above, "up").groupBy("up")
        step = shared.written(tree.applyInPandas(lambda df: _combine(df, shards), "task int, part int, bytes long, up int, into int"), "step")
        steps.append((step, nodes))
        parts, nodes = step.groupBy(F.col("up").alias("task"), F.col("into").alias("part")).agg(F.sum("bytes").alias("bytes")), above
    where = None
    for step, nodes in reversed(steps):
        if where is None:
            where = step.select("task", "part", F.col("into").alias("shard"))
            continue
        above = where.withColumnsRenamed({"task": "up", "part": "into"})
        where = step.join(above, ["up", "into"]).select("task", "part", "shard")
    # As many rows as the lowest step has parts.
    where = F.broadcast(where) if steps[0][1] * shards <= SMALL else where
    return dealt.join(where, ["task", "part"]).select("group", "shard")


def assign_keyed(rows: DataFrame, group: str, shards: int = SHARDS, groups_per_task: int = GROUPS_PER_TASK, fan: int = FAN) -> DataFrame:
    """As assign, for rows that have size and the digest `group` already. Copies of one text share a key of the last join, whose skew is left to adaptive execution."""
    columns = [c for c in rows.columns if c != group]
    rows = shared.written(rows, "rows")
    groups = shared.written(rows.groupBy(F.col(group).alias("group")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    n_rows = groups.agg(F.sum("n")).first()[0]
    where = shards_of(groups.select("group", "bytes"), shards, groups_per_task, fan).withColumnRenamed("group", group)
    # A row's bucket follows from its values, so counts and numbers below agree whenever a task runs again.
    buckets = max(1, -(-(n_rows or 0) // ROWS_PER_BUCKET))
    values = [f.name for f in rows.schema.fields if "map" not in f.dataType.simpleString()]
    bucket, n, start, k = shared.free([*rows.columns, "shard", "slot"], "_bucket", "_n", "_start", "_k")
    placed = rows.join(where, group).withColumn(bucket, F.pmod(F.xxhash64(*values), F.lit(buckets)))
    counts = placed.groupBy("shard", bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy("shard", bucket).orderBy(*[c for c in values if c != "text"])
    return placed.withColumn(k, F.row_number().over(within)).join(starts, ["shard", bucket]).withColumn("slot", F.col(start) + F.col(k) - 1).select(*columns, "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the rows as Parquet, a folder for each shard, and return them as read back."""
    assign(docs, shards).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, group = keyed(docs)
    rows = rows.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")
    return assign_keyed(rows, group).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
