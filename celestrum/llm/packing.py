"""Packing of tokenised documents into sequences by Karmarkar-Karp differencing.

A document's ids are cut into whole windows, which fill a sequence each, and a
rest; the rest is cut into pieces of at most PIECE ids. Pieces of a task are
gathered into blocks of BLOCK_PIECES; each block is dealt into the least number
of sequences that could hold it by multiway differencing, which makes them
nearly equal, and into one more as long as one is over capacity. No row
leaves its task, so there is no shuffle; a sequence's id is made of the
task's number and a running one.

Tokenizing: the byte-level tokenizer begins a new piece where white space
begins, and at the last of several white-space characters in a row if something
visible follows (an ASCII space there goes with what follows, others are pieces
of their own); likewise between an ASCII letter and ASCII punctuation. Texts are
cut there, at spaces and line breaks, each distinct piece is tokenized once and
its ids are kept in a bounded cache. Texts with a special token's text are
tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import bytewords as bw
from celestrum.llm.differencing import difference

CAPACITY = 1024
PIECE = 256
BLOCK_PIECES = 1024
CACHE_PIECES = 400_000

_ids = np.arange(256)
_LETTER = ((_ids >= 65) & (_ids <= 90)) | ((_ids >= 97) & (_ids <= 122))
_PUNCT = (_ids > 32) & (_ids < 127) & ~_LETTER & ~((_ids >= 48) & (_ids <= 57))
_BLANK = (_ids == 32) | ((_ids >= 9) & (_ids <= 13))
#: White space beyond ASCII.
_BLANKS = [chr(k).encode() for k in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _blank(data: np.ndarray) -> np.ndarray:
    """True for the bytes of white space."""
    out = _BLANK[data]
    for lead in {b[0] for b in _BLANKS}:
        at = np.flatnonzero(data == lead)
        for b in _BLANKS if len(at) else ():
            if b[0] == lead:
                found = at[at + len(b) <= len(data)]
                for k in range(1, len(b)):
                    found = found[data[found + k] == b[k]]
                for k in range(len(b)):
                    out[found + k] = True
    return out


def _cuts(texts: bw.Texts) -> np.ndarray:
    """True where texts may be cut without changing their ids; their beginnings are among these."""
    data, n = texts.data, len(texts.data)
    begins = texts.bounds[:-1][texts.bounds[:-1] < n]
    blank = _blank(data)
    after_blank = np.concatenate([[False], blank[:-1]])
    after_blank[begins] = False
    visible_next = np.concatenate([~blank[1:], [False]])
    visible_next[begins[begins > 0] - 1] = False
    space, line = data == 32, data == 10
    cut = (space & (~after_blank | visible_next)) | (_LETTER[np.concatenate([[32], data[:-1]])] & _PUNCT[data])
    # The last of several blanks is a piece of its own if it's a line break.
    cut |= line & after_blank & visible_next
    cut[1:] |= (line & visible_next)[:-1]
    cut[begins] = True
    return cut


class Encoder:
    """Ids of whole texts as the tokenizer file gives them, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros(0, dtype=bw.U64)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, data: bytes) -> np.ndarray:
        return np.array(self._encode([data.decode()])[0], dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.table) + len(hashes) > CACHE_PIECES:
            self._clear()
        got = self._encode(texts)
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        first = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for ids in got for i in ids], dtype=np.uint32)])
        table = np.concatenate([self.table, hashes])
        order = np.argsort(table, kind="stable")
        self.table, self.first, self.size = table[order], np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: bw.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the rows' bounds in them."""
        data, n = texts.data, len(texts.data)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        odd = set()
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd.add(int(np.searchsorted(texts.bounds, at, side="right") - 1))
                at = raw.find(token, at + 1)
        starts = np.flatnonzero(_cuts(texts))
        ends = np.append(starts[1:], n)
        sums, down = bw.prefix_hashes(data)
        hashes = bw.span_hashes(sums, down, starts, ends)
        piece_of_row = np.searchsorted(starts, texts.bounds)
        wanted, where, index = np.unique(hashes, return_index=True, return_inverse=True)
        missing = bw.found_in(wanted, self.table) < 0
        if missing.any():
            at = where[missing]
            new = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            size = len(self.table)
            self._learn(wanted[missing], new)
            if len(self.table) < size + len(new):  # the cache was cleared: the rest is to be learned again
                rest = np.flatnonzero(bw.found_in(wanted, self.table) < 0)
                if len(rest):
                    at = where[rest]
                    self._learn_all(wanted[rest], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        k = bw.found_in(wanted, self.table)[index]
        size, first = self.size[k], self.first[k]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(first - (end - size), size) + np.arange(end[-1])]
        bounds = np.concatenate([[0], end])[piece_of_row]
        if odd:
            parts = [ids[bounds[r] : bounds[r + 1]] if r not in odd else self._whole(raw[texts.bounds[r] : texts.bounds[r + 1]]) for r in range(len(texts))]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds

    def _learn_all(self, hashes: np.ndarray, texts: list[str]) -> None:
        global CACHE_PIECES
        kept, CACHE_PIECES = CACHE_PIECES, 1 << 62  # one slice may hold more than the cache does
        try:
            self._learn(hashes, texts)
        finally:
            CACHE_PIECES = kept


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each piece: the fewest that differencing keeps within capacity, tried from the least possible number upwards."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part = difference(sizes, ways)
        if not len(part) or np.bincount(part, weights=sizes, minlength=ways).max() <= capacity:
            return part
        ways += 1


def _pack(batches: Iterator[pa.RecordBatch], path: str, columns: list[str], capacity: int, piece: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    base, made = TaskContext.get().partitionId() << 40, 0
    held: list[tuple] = []  # (key row as a batch, row, start, length, crc, doc tokens, ids)

    def emit(pieces: list[tuple], sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        keys = pa.Table.from_batches([b.slice(r, 1) for b, r, *_ in pieces]).combine_chunks() if columns else None
        arrays = {c: keys.column(c).combine_chunks() for c in columns}
        for c in columns:
            if isinstance(arrays[c], pa.ChunkedArray):
                arrays[c] = arrays[c].chunk(0)
        for k, c in ((2, "start"), (3, "length"), (4, "ids_crc32"), (5, "doc_tokens")):
            arrays[c] = pa.array([p[k] for p in pieces], type=pa.int64())
        arrays["sequence_id"] = pa.array(sequence, type=pa.int64())
        arrays["offset"] = pa.array(offset, type=pa.int64())
        if with_ids:
            arrays["ids"] = pa.array([p[6].astype(np.int32) for p in pieces], type=pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(arrays)

    def flush() -> pa.RecordBatch:
        nonlocal made
        sizes = np.array([p[3] for p in held], dtype=np.int64)
        part = windows_of(sizes, capacity)
        order = np.lexsort((np.arange(len(part)), part))
        ends = np.cumsum(sizes[order])
        new = np.concatenate([[True], part[order][1:] != part[order][:-1]])
        begins = (ends - sizes[order])[new]
        offset = (ends - sizes[order]) - np.repeat(begins, np.diff(np.append(np.flatnonzero(new), len(part))))
        out = emit([held[k] for k in order.tolist()], base + made + part[order], offset)
        made += int(part.max()) + 1
        held.clear()
        return out

    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        keys = batch.select(columns) if columns else batch
        for texts in bw.slices(text):
            ids, bounds = enc.encode(texts)
            full: list[tuple] = []
            for k in range(len(texts)):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                n = len(own)
                at = 0
                while at < n:
                    size = capacity if n - at >= capacity else min(piece, n - at)
                    cut = own[at : at + size]
                    row = (keys, texts.first + k, at, size, zlib.crc32(cut.tobytes()), n, cut if with_ids else None)
                    (full if size == capacity else held).append(row)
                    at += size
                    if len(held) >= BLOCK_PIECES:
                        yield flush()
            for k in range(0, len(full), 4096):
                some = full[k : k + 4096]
                yield emit(some, base + made + np.arange(len(some)), np.zeros(len(some), dtype=np.int64))
                made += len(some)
    if held:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, columns: list[str] | None = None, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """A row for each piece: `columns` of its document (by default all but text), start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    tokenizer: path of a tokenizer file that workers can read. Null texts are
    empty; an empty text is the end id alone. Repeated rows are packed as often
    as they come. Columns of docs that are named like a made one are left out.
    No rows: no pieces.
    """
    made = {"start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"}
    columns = [c for c in (docs.columns if columns is None else columns) if c != "text" and c not in made]
    kept = docs.select("text", *columns)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]] + [f"{c} bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + ["ids array<int>"] * with_ids
    return kept.mapInArrow(lambda it: _pack(it, tokenizer, columns, capacity, piece, end_id, with_ids), ", ".join(fields))


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer or default_tokenizer(), with_ids=False)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokens, sequences and padded places of packed pieces; sequences whose length is a power of two aren't padded."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    is_power = F.bit_count("n") == 1
    return used.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum(F.when(is_power, 0).otherwise(capacity - F.col("n"))).alias("padded"))
