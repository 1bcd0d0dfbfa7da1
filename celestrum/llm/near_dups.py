"""Near-duplicate texts by an inverted join of signature coordinates.

A text's set is its distinct word shingles; its signature the COORDINATES least
hashes of the set under as many hash functions. Two sets of similarity s agree
in a coordinate with probability s, so pairs that agree in fewer than `agree`
coordinates aren't looked at further: as many as a pair just similar enough
falls short of once in a million (39 of 64 at a similarity of 0.85).

Texts are posted under their (coordinate, value) pairs. Texts that agree in
`agree` places agree in one of each text's COORDINATES - agree + 1 rarest pairs
(prefix filter), so only those are posted, and of them only pairs that more
than one set has. Each list is merged on its own: members' agreements are
counted, and members already linked to each other through others are skipped.
Lists of more than CHUNK are dealt into chunks and merged chunk by chunk, each
with each. Agreeing pairs are confirmed on the whole sets.

Equal sets are one node from the start. Sets and signatures are in files of the
shared folder, to which lists refer; no list holds a text.

Joins are merge joins by hint: what is joined grows with the corpus, and Spark
would broadcast it by way of the driver on estimates that don't see what an
explode adds (the 64 pairs of a text) or how well a file compresses.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import bytewords as bw
from celestrum.llm import mapped, shared
from celestrum.llm.components import components

COORDINATES = 64
#: Chance that a pair just similar enough isn't looked at.
MISS = 1e-6
CHUNK = 1024
#: Lists up to this length give pairs, which are confirmed once for all lists; longer ones are confirmed in place.
SHORT = 12

_A = bw.mix(np.arange(1000, 1000 + COORDINATES, dtype=bw.U64)) | bw.U64(1)
_B = bw.mix(np.arange(2000, 2000 + COORDINATES, dtype=bw.U64)) | bw.U64(1)


def agreement(percent: int) -> int:
    """Most coordinates of which a pair of that similarity agrees in fewer with a chance of at most MISS."""
    p, total = percent / 100, 0.0
    for m in range(COORDINATES):
        total += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if total > MISS:
            return m
    return COORDINATES


def sets_of(texts: bw.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row one after the other, and the rows' bounds."""
    w = bw.words(texts, bw.SPACED)
    n = np.diff(w.of_row)
    row, value = [], []
    g = bw.grams(w.hashes, size)
    if len(g):
        inside = w.row[: len(g)] == w.row[size - 1 :]
        row.append(w.row[: len(g)][inside])
        value.append(g[inside])
    for short in range(1, size):
        at = np.flatnonzero(n == short)
        if len(at):
            row.append(at)
            value.append(bw.grams(w.hashes[(w.of_row[at][:, None] + np.arange(short)[None, :]).ravel()], short)[::short])
    if not row:
        return np.zeros(0, dtype=bw.U64), np.zeros(len(texts) + 1, dtype=np.int64)
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of least hashes for each set; starts: where each, none of them empty, begins."""
    out = np.empty((len(starts), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        x = values * _A[k]
        x ^= x >> bw.U64(32)
        x *= _B[k]
        out[:, k] = np.minimum.reduceat((x >> bw.U64(32)).astype(np.uint32), starts)
    return out


SET_FIELDS = "doc_id bigint, n_shingles bigint, key binary, file bigint, at bigint"


def _write_sets(batches: Iterator[pa.RecordBatch], folder: str, size: int, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A file for this attempt of the task: a signature and its set, again and again. Equal sets of a task are stored once. carry: the columns from the third on, under other names."""
    file = uuid.uuid4().int >> 66
    os.makedirs(folder, exist_ok=True)
    known: dict[bytes, int] = {}
    end = 0
    with open(f"{folder}/{file}", "wb") as f:
        for batch in batches:
            for texts in bw.slices(batch.column(1)):
                values, bounds = sets_of(texts, size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                keys: list[bytes | None] = [None] * len(texts)
                at = np.zeros(len(texts), dtype=np.int64)
                if len(full):
                    signed = signatures(values, bounds[full])
                    for k, r in enumerate(full.tolist()):
                        data = values[bounds[r] : bounds[r + 1]].tobytes()
                        keys[r] = key = hashlib.blake2b(data, digest_size=16).digest()
                        if key not in known:
                            known[key] = end
                            f.write(signed[k].tobytes())
                            f.write(data)
                            end += 4 * COORDINATES + len(data)
                        at[r] = known[key]
                f.flush()
                own = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_pydict(
                    {c: own.column(2 + k) for k, c in enumerate(carry)} | {"doc_id": own.column(0), "n_shingles": pa.array(n, type=pa.int64()), "key": pa.array(keys, type=pa.binary()), "file": pa.array(np.full(len(n), file), type=pa.int64()), "at": pa.array(at, type=pa.int64())}
                )


class Sets:
    """Signatures and sets by file and place, memory-mapped."""

    def __init__(self, folder: str) -> None:
        self.files = mapped.Recent(lambda name: np.frombuffer(mapped.whole(f"{folder}/{name}"), dtype=np.uint8))

    def signatures(self, file: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row for each place, file by file."""
        out = np.empty((len(file), COORDINATES), dtype=np.uint32)
        order = np.argsort(file, kind="stable")
        names, first = np.unique(file[order], return_index=True)
        for name, own in zip(names.tolist(), np.split(order, first[1:]), strict=False):
            out[own] = self.files[name].view(np.uint32)[(at[own] // 4)[:, None] + np.arange(COORDINATES)]
        return out

    def set(self, file: int, at: int, n: int) -> np.ndarray:
        at += 4 * COORDINATES
        return self.files[file][at : at + 8 * n].view(bw.U64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, have 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int(np.count_nonzero(bw.found_in(a, b) >= 0))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _tokens(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    sets = Sets(folder)
    place = np.arange(COORDINATES, dtype=bw.U64) << bw.U64(32)
    for batch in batches:
        rep, file, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        signed = sets.signatures(file, at).astype(bw.U64)
        tokens = bw.mix((signed | place[None, :]).ravel()).view(np.int64)
        yield pa.RecordBatch.from_pydict({"rep": pa.array(rep.astype(np.int64)), "tokens": pa.ListArray.from_arrays(np.arange(0, len(tokens) + 1, COORDINATES, dtype=np.int32), pa.array(tokens))})


PAIRS = "a bigint, b bigint, sure boolean, a_file bigint, a_at bigint, a_n bigint, b_file bigint, b_at bigint, b_n bigint"


def _merge_lists(batches: Iterator[pa.RecordBatch], folder: str, percent: int, agree: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token, x, y; a list is the rows that agree in them. Columns: token, x, y, rep, chunk, n, file, at."""
    sets = Sets(folder)
    held: list[np.ndarray] = []
    out: list[tuple] = []

    def merge(rows: np.ndarray) -> None:
        x, y = int(rows[0, 1]), int(rows[0, 2])
        rep, chunk, n, file, at = rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6], rows[:, 7]
        size = len(rows)
        if size < 2:
            return
        signed = sets.signatures(file, at)
        group, groups = np.arange(size), size
        short = x == y == 0 and size <= longest

        def pair(i: int, j: int, sure: bool) -> tuple:
            i, j = (i, j) if rep[i] < rep[j] else (j, i)
            return (int(rep[i]), int(rep[j]), sure, int(file[i]), int(at[i]), int(n[i]), int(file[j]), int(at[j]), int(n[j]))

        for i in range(size - 1):
            rest = np.arange(i + 1, size)
            rest = rest[group[rest] != group[i]]
            if x != y:
                rest = rest[chunk[rest] != chunk[i]]
            if not len(rest):
                continue
            rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
            rest = rest[(signed[rest] == signed[i]).sum(axis=1) >= agree]
            if short:
                out.extend(pair(i, j, False) for j in rest.tolist())
                continue
            own = sets.set(int(file[i]), int(at[i]), int(n[i]))
            for j in rest.tolist():
                if group[i] != group[j] and linked(own, sets.set(int(file[j]), int(at[j]), int(n[j])), percent):
                    out.append(pair(i, j, True))
                    group[group == group[j]] = group[i]
                    groups -= 1
            if groups == 1:
                return

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6]
        columns = list(zip(*out, strict=True))
        out.clear()
        names = [f.split()[0] for f in PAIRS.split(", ")]
        return pa.RecordBatch.from_pydict({c: pa.array(v, type=k) for c, v, k in zip(names, columns, kinds, strict=True)})

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        parts = np.split(rows, cuts)
        if held and (held[-1][-1, :3] == parts[0][0, :3]).all():
            held.append(parts.pop(0))
        if parts:
            if held:
                merge(np.concatenate(held))
            for part in parts[:-1]:
                merge(part)
            held = [parts[-1]]
        if len(out) > 5000:
            yield batch_of()
    if held:
        merge(np.concatenate(held))
    if out:
        yield batch_of()


def _confirm(batches: Iterator[pa.RecordBatch], folder: str, percent: int) -> Iterator[pa.RecordBatch]:
    sets = Sets(folder)
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        keep = [(r[0], r[1]) for r in rows if linked(sets.set(r[2], r[3], r[4]), sets.set(r[5], r[6], r[7]), percent)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([k[0] for k in keep], type=pa.int64()), "b": pa.array([k[1] for k in keep], type=pa.int64())})


def find_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, carry: tuple[str, ...] = (), chunk: int = CHUNK, short: int = SHORT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the columns of carry, for each row of docs (doc_id, text, ...).

    Texts are linked if 100 * intersection >= percent * union of their sets. Words
    are what ASCII white space leaves, A-Z lower-cased; a text of fewer words than
    a shingle has its whole sequence as its only shingle; null texts and texts
    without words have no shingles and no links. component_id is the least doc_id
    that is reached over links; kept is doc_id = component_id. Rows with a null
    doc_id link nothing, have no component and are kept. Rows given twice are
    there twice. Columns that aren't carried are left out; carried ones may have any
    names but those of the result. The set of a text takes about ten times its size.
    """
    if not set(carry).isdisjoint(("doc_id", "n_shingles", "component_id", "kept")):
        raise ValueError(f"carried columns {carry} have names of the result")
    spark = docs.sparkSession
    agree = agreement(percent)
    prefix = COORDINATES - agree + 1
    folder = shared.mounted(shared.folder(spark, "sets"))
    own = tuple(f"carried{k}" for k in range(len(carry)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)])
    extra = "".join(f"{o} {docs.schema[c].dataType.simpleString()}, " for c, o in zip(carry, own, strict=True))
    found = shared.written(rows.mapInArrow(lambda it: _write_sets(it, folder, shingle, own), extra + SET_FIELDS), "found")
    reps = (
        found.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "file", "at")).alias("r"))
        .select("key", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.file").alias("file"), F.col("r.at").alias("at"))
    )
    # Nodes are sets, by their digests of 128 bits; their numbers are made once, when the table is written.
    reps = shared.written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    posted = reps.select("node", "file", "at").mapInArrow(lambda it: _tokens(it, folder), "rep bigint, tokens array<bigint>").select("rep", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    shared_tokens = posted.hint("merge").join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("own"))
    # Pairs that no other set has are the rarest; they fill the front of the prefix, where nothing can meet them.
    rest = F.lit(prefix - COORDINATES) + F.size("own")
    lists = shared_tokens.where(rest > 0).select("rep", F.explode(F.slice("own", F.lit(1), rest)).alias("t")).select("rep", "t.token", F.ceil(F.col("t.often") / chunk).cast("int").alias("q"))
    lists = lists.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("q")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    lists = lists.select("token", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "rep", "chunk")
    lists = lists.hint("merge").join(reps.select(F.col("node").alias("rep"), "n", "file", "at"), "rep").select("token", "x", "y", "rep", "chunk", "n", "file", "at")
    # Merging takes much time for its few bytes, so it is dealt finer than by size.
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = lists.repartition(tasks, "token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(lambda it: _merge_lists(it, folder, percent, agree, short), PAIRS)
    merged = shared.written(merged, "merged")
    unsure = merged.where("NOT sure").select("a", "b", "a_file", "a_at", "a_n", "b_file", "b_at", "b_n").dropDuplicates(["a", "b"])
    links = merged.where("sure").select("a", "b").unionByName(unsure.mapInArrow(lambda it: _confirm(it, folder, percent), "a bigint, b bigint"))
    roots = components(links)
    nodes = reps.select("key", "node", "rep").hint("merge").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = nodes.hint("merge").join(least, "root").select("key", "component_id")
    out = found.hint("merge").join(placed, "key", "left").select(*[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)], "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return find_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=3, percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
