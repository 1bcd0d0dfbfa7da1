"""Quality classifier: supervised subword embeddings.

A text's features are a constant, its words, whether each word repeats the one
before it, and its byte 3- and 4-grams, hashed into BUCKETS rows of an embedding table; their mean goes through a softmax over
the two classes. Table and output layer are learned by plain stochastic
gradient descent in numpy, on a bounded sample of labelled rows. Once learned,
the two classes' difference is one number a bucket, so scoring is one lookup a
feature over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import bytewords as bw

BUCKET_BITS = 18
DIM = 8
EPOCHS = 6
RATE = 4.0
#: The classifier is fitted on at most so many labelled rows, and so many bytes of their texts.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 64 << 20
#: Buckets of the features that aren't hashed.
_CONSTANT, _REPEATED, _NEW = 0, 1, 2


def _features(texts: bw.Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kinds of features: buckets, and the first and last (exclusive) of each row among them."""
    data, bounds = texts.data.astype(np.uint32), texts.bounds
    shift = np.uint32(32 - BUCKET_BITS)
    out = []
    w = bw.words(texts, bw.SPACED, fold=False)
    out.append(((w.hashes >> bw.U64(64 - BUCKET_BITS)).astype(np.int64), w.of_row[:-1], w.of_row[1:]))
    repeats = np.concatenate([[False], w.hashes[1:] == w.hashes[:-1]]) if len(w.hashes) else np.zeros(0, dtype=bool)
    repeats[w.of_row[:-1][np.diff(w.of_row) > 0]] = False  # a row's first word has none before it
    out.append((np.where(repeats, _REPEATED, _NEW), w.of_row[:-1], w.of_row[1:]))
    for n in (3, 4):
        if len(data) < n:
            continue
        gram = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            gram |= data[k : len(data) - n + 1 + k] << np.uint32(8 * k)
        first = np.minimum(bounds[:-1], len(gram))
        out.append((((gram + np.uint32(n)) * np.uint32(2654435761) >> shift).astype(np.int64), first, np.maximum(first, bounds[1:] - n + 1)))
    return out


def fit(texts: list, labels: list[int], seed: int = 7) -> np.ndarray:
    """Score of each bucket: the classes' difference, label 1 less label 0. No rows, or one class alone: zeros, so every score is 0.5."""
    size = 1 << BUCKET_BITS
    if len(set(labels)) < 2:
        return np.zeros(size, dtype=np.float32)
    docs = []
    for part in bw.slices(pa.array(texts, type=pa.large_string())):
        kinds = _features(part)
        for k in range(len(part)):
            found = np.concatenate([[_CONSTANT], *(f[a[k] : b[k]] for f, a, b in kinds)])
            bucket, count = np.unique(found, return_counts=True)
            docs.append((bucket.astype(np.int32), (count / len(found)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), dtype=np.float32)
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)).tolist():
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            bucket, weight = docs[k]
            mean = weight @ table[bucket]
            logit = mean @ out
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= (rate * np.float32(0.1)) * np.outer(mean, p)
            # Each feature moves by its share of the text; the square root keeps rare ones from standing still.
            table[bucket] -= rate * np.sqrt(weight)[:, None] * back[None, :] * np.float32(0.2)
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32)


def _score(batches: Iterator[pa.RecordBatch], model: np.ndarray, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
        scores = []
        for texts in bw.slices(batch.column(batch.schema.get_field_index("text"))):
            total, count = np.full(len(texts), float(model[_CONSTANT])), np.ones(len(texts))
            for bucket, first, last in _features(texts):
                sums = np.concatenate([[0.0], np.cumsum(model[bucket], dtype=np.float64)])
                total += sums[last] - sums[first]
                count += last - first
            scores.append(1 / (1 + np.exp(-np.clip(total / count, -500, 500))))
        yield pa.RecordBatch.from_pydict(keys | {"score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """The model from a sample of labels (doc_id, quality) and their texts in docs (doc_id, text).

    The sample is the labelled ids with the least hashes; texts that don't fit
    into what is left of the bytes are left out of it. Labels other than 0
    and 1, null ids, and ids with both labels are left out; of an id's texts
    the least counts; null texts are empty. Labelled texts of which none fits
    are an error.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("_label"), F.max("quality").cast("int").alias("_other"))
        .where(F.col("_label") == F.col("_other"))
        .select("doc_id", "_label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    sized = rows.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    # At most sample_rows ids and sizes come to the driver.
    sizes = sized.select("doc_id", "_bytes").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    ids, left = [], sample_bytes
    for r in sizes:
        if r["_bytes"] <= left:
            ids.append((r["doc_id"],))
            left -= r["_bytes"]
    if sizes and not ids:
        raise ValueError(f"none of {len(sizes)} labelled texts has at most {sample_bytes} bytes")
    if len(ids) < len(sizes):
        sized = sized.join(F.broadcast(docs.sparkSession.createDataFrame(ids, sized.select("doc_id").schema)), "doc_id")
    taken = sized.select("doc_id", "text", "_label").toPandas().sort_values("doc_id")
    return fit([None if pd.isna(t) else t for t in taken["text"]], taken["_label"].astype(int).tolist())


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """docs' columns and score (0 to 1). Null texts are empty and get the constant's score; a column named score is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float a bucket
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda it: _score(it, shared.value, columns), f"{fields}, score double")


def fold(doc_id, parts: int):
    """Remainder of crc32 of the id's text; of a null id 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    model = learn(docs, labels)
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
