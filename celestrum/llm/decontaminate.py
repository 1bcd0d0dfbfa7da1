"""Benchmark decontamination by winnowing.

Of each run of `SELECT` consecutive word `GRAM`-grams the one with the least
hash is a fingerprint. GRAM + SELECT - 1 = 13, so two texts that share 13
consecutive words share a fingerprint at the same place of that passage.
Fingerprints of documents are joined with those of the benchmark, and around
each hit all windows that contain it are compared whole. Items of fewer than 13
words are one window each; those are looked up at every place, for each length
that occurs.

Benchmark items go to the workers in blocks of at most `BLOCK_BYTES` of text;
each block is one pass over the documents, and with several blocks only the
hit spans of documents that have any are written and gathered by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import bytewords as bw
from celestrum.llm import shared

WINDOW = 13
GRAM = 6
SELECT = WINDOW - GRAM + 1
#: Most text bytes of benchmark items in one broadcast block.
BLOCK_BYTES = 32 << 20


@dataclass
class Block:
    """Fingerprints and windows of some items, sorted; window k is of items[of_window[k]:of_window[k + 1]]."""

    fingerprints: np.ndarray
    #: Length -> sorted window hashes, CSR offsets, item names.
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def index_items(ids: list, texts: list) -> Block:
    prints, found = [], {}
    for texts_ in bw.slices(pa.array(texts, type=pa.large_string())):
        w = bw.words(texts_, bw.ALNUM)
        for k in range(len(texts_)):
            h = w.hashes[w.of_row[k] : w.of_row[k + 1]]
            if not len(h):
                continue
            name, size = str(ids[texts_.first + k]), min(len(h), WINDOW)
            found.setdefault(size, []).append((np.unique(bw.grams(h, size)), name))
            if size == WINDOW:
                g = bw.grams(h, GRAM)
                prints.append(g[bw.winnowed(g, SELECT)])
    windows = {}
    for size, parts in found.items():
        hashes = np.concatenate([h for h, _ in parts])
        names = np.repeat(np.array([n for _, n in parts], dtype=object), [len(h) for h, _ in parts])
        order = np.argsort(hashes, kind="stable")
        table, first = np.unique(hashes[order], return_index=True)
        windows[size] = (table, np.append(first, len(hashes)), names[order])
    return Block(np.unique(np.concatenate(prints)) if prints else np.zeros(0, dtype=bw.U64), windows)


def hits_of(w: bw.Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and window number (length * 2**40 + k) of every benchmark window in the documents' words."""
    n = len(w.hashes)
    first, size, window = [], [], []
    for length, (table, _, _) in block.windows.items():
        if n < length:
            continue
        if length == WINDOW:
            g = bw.grams(w.hashes, GRAM)
            at = np.flatnonzero(bw.winnowed(g, SELECT))
            at = at[bw.found_in(g[at], block.fingerprints) >= 0]
            if not len(at):
                continue
            near = np.unique((at[:, None] - np.arange(SELECT)[None, :]).ravel())
            near = near[(near >= 0) & (near <= n - WINDOW)]
        else:
            near = np.arange(n - length + 1)
        near = near[w.row[near] == w.row[near + length - 1]]
        if not len(near):
            continue
        k = bw.found_in(_grams_at(w.hashes, near, length), table)
        near, k = near[k >= 0], k[k >= 0]
        first.append(near)
        size.append(np.full(len(near), length))
        window.append((length << 40) + k)
    if not first:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(first), np.concatenate(size), np.concatenate(window)


def _grams_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    if len(at) * n > 4 * len(hashes):
        return bw.grams(hashes, n)[at]
    flat = hashes[(at[:, None] + np.arange(n)[None, :]).ravel()]
    return bw.grams(flat, n)[::n]


def _names(block: Block, windows: np.ndarray) -> set:
    out: set = set()
    for key in np.unique(windows).tolist():
        _, bounds, names = block.windows[key >> 40]
        k = key & ((1 << 40) - 1)
        out.update(names[bounds[k] : bounds[k + 1]].tolist())
    return out


def _runs(hit: np.ndarray) -> np.ndarray:
    """First and end of each run of true, in turn."""
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).ravel()


def _find(batches: Iterator[pa.RecordBatch], block: Block, ids: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows with hits their spans (first word and end, in turn) and items."""
    for batch in batches:
        for texts in bw.slices(batch.column(batch.schema.get_field_index("text"))):
            w = bw.words(texts, bw.ALNUM)
            hit, items = _hit(w, block)
            rows = sorted(items)
            own = batch.slice(texts.first, len(texts))
            keys = {c: own.column(own.schema.get_field_index(c)).take(pa.array(rows, type=pa.int64())) for c in ids}
            spans = pa.array([_runs(hit[w.of_row[k] : w.of_row[k + 1]]) for k in rows], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(keys | {"spans": spans, "items": pa.array([items[k] for k in rows], type=pa.list_(pa.string()))})


def _hit(w: bw.Words, block: Block) -> tuple[np.ndarray, dict[int, list[str]]]:
    """Whether each word is hit, and the sorted names of items by row."""
    first, size, window = hits_of(w, block)
    row = w.row[first]
    edges = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + size, -1)
    order = np.argsort(row, kind="stable")
    rows, begin = np.unique(row[order], return_index=True)
    parts = np.split(window[order], begin[1:]) if len(rows) else []
    return np.cumsum(edges[:-1]) > 0, {k: sorted(_names(block, part)) for k, part in zip(rows.tolist(), parts, strict=True)}


def _mark(batches: Iterator[pa.RecordBatch], block: Block | None, columns: list[str], cut: bool) -> Iterator[pa.RecordBatch]:
    """All rows with n_words, n_hit and items; block: what to look for, or None if the spans are in columns _spans and _items. cut: hit words go from the text."""
    for batch in batches:
        for texts in bw.slices(batch.column(batch.schema.get_field_index("text"))):
            w = bw.words(texts, bw.ALNUM)
            own = batch.slice(texts.first, len(texts))
            arrays = dict(zip(own.schema.names, own.columns, strict=True))
            if block is None:
                hit, items = np.zeros(len(w.hashes), dtype=bool), {}
                for k, (spans, names) in enumerate(zip(arrays["_spans"].to_pylist(), arrays["_items"].to_pylist(), strict=True)):
                    if spans:
                        items[k] = names
                        for i in range(0, len(spans), 2):
                            hit[w.of_row[k] + spans[i] : w.of_row[k] + spans[i + 1]] = True
            else:
                hit, items = _hit(w, block)
            total = np.concatenate([[0], np.cumsum(hit)])
            made = {
                "n_words": pa.array(np.diff(w.of_row), type=pa.int64()),
                "n_hit": pa.array(total[w.of_row[1:]] - total[w.of_row[:-1]], type=pa.int64()),
                "items": pa.array([items.get(k, []) for k in range(len(texts))], type=pa.list_(pa.string())),
            }
            if cut and items:
                out = arrays["text"].to_pylist()
                for k in items:
                    runs = w.of_row[k] + _runs(hit[w.of_row[k] : w.of_row[k + 1]])
                    kept, at = [], texts.bounds[k]
                    for i, j in runs.reshape(-1, 2).tolist():
                        kept.append(texts.data[at : w.starts[i]])
                        at = w.ends[j - 1]
                    out[k] = b"".join([*(x.tobytes() for x in kept), texts.data[at : texts.bounds[k + 1]].tobytes()]).decode(errors="ignore")
                arrays["text"] = pa.array(out, type=pa.string())
            yield pa.RecordBatch.from_pydict({c: arrays[c] for c in columns} | made)


def _blocks(spark, benchmark: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of a checked size; items with null ids or texts have no part."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // (max(1, block_bytes // 2))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.collect()
        yield index_items([r[0] for r in rows], [r[1] for r in rows])


def find_contamination(docs: DataFrame, benchmark: DataFrame, cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns and n_words, n_hit, items (sorted names of the items that have a window in the text).

    docs: text and others; benchmark: item_id, text. With cut, hit words go from
    text. Null texts have no words. Repeated rows stay; columns named n_words,
    n_hit or items are replaced. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "items")
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_words bigint, n_hit bigint, items array<string>"
    blocks = _blocks(spark, benchmark, block_bytes)
    sc = spark.sparkContext
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        one = sc.broadcast(first)
        return docs.mapInArrow(lambda it: _mark(it, one.value, columns, cut), fields)
    tagged = docs.withColumns({"_a": F.xxhash64("text"), "_b": F.crc32(F.col("text").cast("binary"))})
    hits = None
    for block in (first, second, *blocks):
        one = sc.broadcast(block)
        # Equal texts have equal hits: one row of each is enough, and only rows with hits are gathered.
        found = tagged.select("_a", "_b", "text").mapInArrow(lambda it, one=one: _find(it, one.value, ["_a", "_b"]), "_a bigint, _b bigint, spans array<bigint>, items array<string>").dropDuplicates(["_a", "_b"])
        # Written, so the block can go before the next one comes.
        found = shared.written(found, "hits")
        one.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    joined = hits.groupBy("_a", "_b").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    return tagged.join(joined, ["_a", "_b"], "left").drop("_a", "_b").mapInArrow(lambda it: _mark(it, None, columns, cut), fields)


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM iw),
hits AS (SELECT r, k, m, item_id FROM (
           SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS g
           FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths WHERE len(w) >= m)) JOIN iw USING (m, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
