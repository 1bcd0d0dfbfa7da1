"""Exact top-k search by pivot-table elimination.

Distances of every vector to many pivots are a table. For a query q and a row x
each pivot p gives |d(q,p) - d(x,p)| <= d(q,x); the greatest of them bounds the
distance from below and so the inner product, (|q|^2 + |x|^2 - d^2) / 2, from
above. Rows of a batch are sorted by their nearest pivot and their distance to
it and cut into candidate blocks, whose ranges of the table bound all their rows
at once. A query's best-bound block is evaluated first, the others follow as long
as their bounds reach the k-th best score, which only rises; that makes the
result exact whatever the pivots are.

Queries are blocks of at most about QUERY_BLOCK in files of the shared folder,
memory-mapped by the tasks; a scan of the rows takes WAVE of those blocks. Each task
keeps its k best of each query, and a ranking over those gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celestrum.llm import mapped, shared

QUERY_BLOCK = 2048
#: Blocks of queries that one scan of the rows takes; a task holds k scores and ids of each of their queries.
WAVE = 256
PIVOTS = 32
#: Pivots are chosen from at most so many rows.
PIVOT_SAMPLE = 2000
ROWS_AT_ONCE = 16384
#: Rows of a candidate block.
BLOCK = 128


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from those chosen."""
    if not len(vectors):
        return vectors
    chosen = [int(np.argmax((vectors**2).sum(axis=1)))]
    gap = ((vectors - vectors[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(vectors)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros((len(vectors), 0))
    square = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Candidates:
    """A batch of rows in blocks, with the ranges of the blocks' rows in the pivot table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, block: int = BLOCK) -> None:
        table = distances(vectors, pivots)
        order = np.argsort(ids, kind="stable")
        if len(pivots):
            nearest = table.argmin(axis=1)
            order = np.lexsort((ids, table[np.arange(len(ids)), nearest], nearest))
        self.ids, self.vectors, table = ids[order], vectors[order], table[order]
        self.first = np.arange(0, len(ids), block)
        self.last = np.append(self.first[1:], len(ids))
        self.low, self.high = np.minimum.reduceat(table, self.first, axis=0), np.maximum.reduceat(table, self.first, axis=0)
        self.norm = np.maximum.reduceat((self.vectors**2).sum(axis=1), self.first)

    def bounds(self, queries: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Queries x blocks: no row of the block scores more."""
        gap = np.zeros((len(queries), len(self.first)))
        for p in range(table.shape[1]):
            d = table[:, p : p + 1]
            np.maximum(gap, np.maximum(self.low[:, p] - d, d - self.high[:, p]), out=gap)
        # Scores are whole numbers, so half a unit is far more than rounding needs.
        return ((queries**2).sum(axis=1)[:, None] + self.norm[None, :] - gap**2) / 2 + 0.5


class Best:
    """The k best rows of each query so far: scores falling, ids rising among equal ones; unfilled places score -inf."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """which: distinct queries; ids: one for each column of scores, or one for each place (those of -inf scores don't count)."""
        # Few reach the k-th best score, and only they are merged.
        query, column = np.nonzero(scores >= np.maximum(self.scores[which, -1], -1e300)[:, None])
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate([query, np.repeat(touched, self.k)])
        i = np.concatenate([ids[column], self.ids[which[touched]].ravel()])
        s = np.concatenate([scores[query, column], self.scores[which[touched]].ravel()])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        keep = place < self.k
        self.scores[which[q[keep]], place[keep]], self.ids[which[q[keep]], place[keep]] = s[keep], i[keep]


def evaluate(best: Best, own: np.ndarray, queries: np.ndarray, table: np.ndarray, rows: Candidates) -> int:
    """Take a batch of rows into the best; own: the queries' ids, which are no candidates. Returns for how many pairs of a query and a row the product was computed."""
    bound = rows.bounds(queries, table)
    done = 0

    def block(b: int, which: np.ndarray) -> int:
        part = slice(rows.first[b], rows.last[b])
        scores = queries[which] @ rows.vectors[part].T
        scores[own[which][:, None] == rows.ids[part][None, :]] = -np.inf
        best.add(which, rows.ids[part], scores)
        return scores.size

    first = bound.argmax(axis=1)
    order = np.argsort(first, kind="stable")
    blocks, begin = np.unique(first[order], return_index=True)
    for b, which in zip(blocks.tolist(), np.split(order, begin[1:]), strict=True):
        done += block(b, which)
    bound[np.arange(len(queries)), first] = -np.inf
    # The others by falling bounds, of any query; a query takes no part in blocks that can't reach its k-th best score.
    for b in np.argsort(-bound.max(axis=0), kind="stable").tolist():
        which = np.flatnonzero((bound[:, b] >= best.scores[:, -1]) & (bound[:, b] > -np.inf))
        if len(which):
            done += block(b, which)
    return done


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(256 * x); shorter vectors are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = np.floor(256 * flat)
    return out


def _store_queries(table: pa.Table, path: str, dim: int) -> pa.Table:
    b = table.column("block")[0].as_py()
    table = table.combine_chunks().sort_by("vec_id")
    vectors = _matrix(table.column("embedding").combine_chunks(), dim)
    mapped.store(f"{path}/queries-{b}", {"ids": table.column("vec_id").to_numpy(), "vectors": vectors.ravel()})
    return pa.table({"n": pa.array([1], type=pa.int64())})


def _search(batches: Iterator[pa.RecordBatch], path: str, there: np.ndarray, blocks: range, pivots: np.ndarray, dim: int, k: int, counter) -> Iterator[pa.RecordBatch]:
    files = mapped.Folder(f"{path}/queries", there)
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, Best]] = {}
    held: list[pa.RecordBatch] = []

    def take() -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        if not rows.num_rows:
            return
        candidates = Candidates(rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks(), dim), pivots)
        for b in blocks:
            file = files[b]
            if file is None:
                continue
            queries = file["vectors"].reshape(len(file["ids"]), dim)
            if b not in found:
                found[b] = Best(len(queries), k)
            done = evaluate(found[b], file["ids"], queries, distances(queries, pivots), candidates)
            if counter is not None:
                counter.add(done)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            held.append(batch.slice(at, ROWS_AT_ONCE))
            if sum(h.num_rows for h in held) >= ROWS_AT_ONCE:
                take()
    if held:
        take()
    for b, best in found.items():
        query, place = np.nonzero(best.scores > -np.inf)
        if len(query):
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(files[b]["ids"][query], type=pa.int64()), "vec_id": pa.array(best.ids[query, place], type=pa.int64()), "score": pa.array(best.scores[query, place].astype(np.int64), type=pa.int64())})


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components only."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)


def search(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, wave: int = WAVE, counter=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product of each query, exact.

    vectors: vec_id, embedding; is_query: a condition on vec_id. Rows with the
    query's own vec_id are no candidates. Vectors that are null or hold null or
    non-finite components, and null ids, take no part; shorter vectors count as
    filled with zeros. Query ids given twice are one query (the least vector
    counts); candidate rows given twice count twice. Ties go to the smaller
    vec_id. Scores are exact up to 2**53. No queries or rows: no result rows.
    counter: an accumulator that gets the number of products computed.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    dim, n_queries = rows.agg(F.max(F.size("embedding")), F.count(F.when(is_query, 1))).first()
    dim = dim or 0
    path = shared.mounted(shared.folder(spark, "queries"))
    blocks = max(1, -(-n_queries // query_block))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    stored = queries.repartition(blocks, "block").groupBy("block").applyInArrow(lambda t: _store_queries(t, path, dim), "n long").agg(F.sum("n")).first()[0]
    there = mapped.manifest(path, "queries", blocks, stored or 0)
    sample = shared.sample(rows, PIVOT_SAMPLE, "vec_id").toArrow().combine_chunks()
    chosen = choose_pivots(_matrix(sample.column(1).combine_chunks(), dim) if sample.num_rows else np.zeros((0, dim)), pivots)
    found = None
    for at in range(0, blocks, wave):
        part = range(at, min(blocks, at + wave))
        one = rows.mapInArrow(lambda it, part=part: _search(it, path, there, part, chosen, dim, k, counter), "query_id long, vec_id long, score long")
        found = one if found is None else found.unionByName(one)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
