"""Language-model scoring: an interpolated modified Kneser-Ney model of any order.

Counting goes by shuffles of packed, compressed arrays. First the words: each
task counts its words by 64-bit hash and sends sorted arrays by the hash's
leading bits; each bucket is merged and stored as a sorted array, in which a
word's place is its number. Then the n-grams of the highest order, as columns of
word numbers, by their context (all words but the last): each bucket is stored
as sorted contexts with their next words and counts, and its n-grams less their
first word are sent on, with the number of different words before them, as the
counts of the order below. So it goes down to single words, whose continuation
counts are summed by ranges of word numbers. Texts begin with order - 1 begin
signs.

Contexts whose words are all very frequent are dealt over several buckets by the
next word; their totals are added up when they are read. Of a context's 64-bit
hash a bucket keeps the low half, sorted within cells that the high half gives.

N-grams are sorted as single integers, since that takes far less time than
sorting by columns: those of some texts by the places of their words among the
different words of these texts, those of several tasks by one column after the
other, the numbers of what is equal so far before it. Texts to score look up
each different context once, and each different n-gram in it.

Files are in the shared folder and are memory-mapped by the workers that score.
Buckets are sized by the bytes of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import bytewords as bw
from celestrum.llm import mapped, shared

#: The query's order: words of the longest n-grams.
ORDER = 3
#: Bytes of training text for each bucket.
BUCKET_TEXT = 32 << 20
#: Word numbers in one range of continuation counts.
RANGE = 1 << 20
#: Different keys that a task holds before it sends them.
HELD = 1_000_000
#: Least cells of a bucket, in which contexts are sorted by the low halves of their hashes; there are more if more than CELL contexts come to each.
CELLS, CELL = 1 << 14, 8
#: Contexts of words that all occur more often are dealt over several buckets: one for each so many. At most SPLITS words are so frequent.
SPLIT, SPLITS = 4 << 20, 4096
#: Next words up to which a context's totals are added up when it is read.
LONG = 32
END = bw.U64(0x1F3D5B79_2468ACE1)
_C = bw.U64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", compression_level=6)


@dataclass
class Tokens:
    """Hashes of rows' words, each row closed by the end; row k at bounds[k]:bounds[k + 1].

    Of a long text's pieces each is one row: lead tokens of the piece before come
    first, only the last has an end, and `more` says that another follows.
    """

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    lead: int = 0
    more: bool = False


def tokens_of(column: pa.Array, order: int, limit: int = 2 * bw.SLICE_BYTES) -> Iterator[Tokens]:
    for texts in bw.slices(column):
        before, n = None, 0
        for piece in bw.pieces(texts, bw.SPACED, limit):
            w = bw.words(piece, bw.SPACED)
            n += len(piece.data)
            if len(texts) > 1 or before is None and n == len(texts.data):
                bounds = w.of_row + np.arange(len(w.of_row))
                out = np.full(len(w.hashes) + len(texts), END, dtype=bw.U64)
                out[np.arange(len(w.hashes)) + w.row] = w.hashes
                yield Tokens(texts.first, out, bounds)
                continue
            more = n < len(texts.data)
            lead = np.zeros(0, dtype=bw.U64) if before is None else before
            out = np.concatenate([lead, w.hashes, np.full(int(not more), END)])
            yield Tokens(texts.first, out, np.array([0, len(out)]), len(lead), more)
            before = out[max(0, len(out) - (order - 1)) :]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """By the leading 32 bits, in the values' order."""
    return ((values >> bw.U64(32)) * bw.U64(buckets) >> bw.U64(32)).astype(np.int64)


def _sealed(columns: list[np.ndarray]) -> bytes:
    """Columns of one unsigned type, the first ascending, compressed by planes of bytes."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    size = columns[0].dtype.itemsize
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, size).T.tobytes() for c in columns)
    return bytes([size]) + len(columns[0]).to_bytes(8, "little") + _CODEC.compress(planes, asbytes=True)


def _opened(sealed: bytes, width: int) -> list[np.ndarray]:
    size, n = sealed[0], int.from_bytes(sealed[1:9], "little")
    planes = np.frombuffer(pa.decompress(sealed[9:], decompressed_size=size * width * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, size, n)
    columns = [np.ascontiguousarray(p.T).view(f"<u{size}").ravel() for p in planes]
    columns[0] = np.cumsum(columns[0], dtype=columns[0].dtype)
    return columns


def _begins(values: np.ndarray) -> np.ndarray:
    """Where other values begin than the one before."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[k], begins[k] + 1, ... of each k, sizes[k] of them."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted different n-grams with their counts."""
    if not len(counts):
        return columns, counts
    if columns[0].dtype.itemsize == 4:
        key = columns[0].astype(bw.U64)
        if len(columns) > 1:
            key = key << bw.U64(32) | columns[1]
        order = np.argsort(key)
        key = key[order]
        for c in columns[2:]:
            key = (np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])).astype(bw.U64) << bw.U64(32)) | c[order]
            again = np.argsort(key)
            order, key = order[again], key[again]
        first = _begins(key)
    else:
        order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
        first = np.flatnonzero(np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)]))
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first, dtype=np.int64)


def _packs(columns: list[np.ndarray], most: int) -> np.ndarray | None:
    """Rows of numbers from 0 to `most` as single integers in the rows' order; none if 64 bits are too few."""
    bits = most.bit_length()
    if bits * len(columns) > 64:
        return None
    out = columns[0].astype(bw.U64)
    for c in columns[1:]:
        out = out << bw.U64(bits) | c.astype(bw.U64)
    return out


def _unpacked(packs: np.ndarray, width: int, most: int) -> list[np.ndarray]:
    bits = most.bit_length()
    return [(packs >> bw.U64(bits * k) & bw.U64((1 << bits) - 1)).astype(np.int64) for k in range(width - 1, -1, -1)]


GRAMS = "bucket int, keys binary, counts binary, stats array<bigint>"


def _packed(columns: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray, stats: list[int]) -> pa.RecordBatch:
    """A row for each bucket; the first has the stats."""
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    parts = np.split(order, first[1:])
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(which, type=pa.int32()),
            "keys": pa.array([_sealed([c[p] for c in columns]) for p in parts], type=pa.binary()),
            "counts": pa.array([_CODEC.compress(counts[p].astype(np.uint32).tobytes(), asbytes=True) for p in parts], type=pa.binary()),
            "stats": pa.array([stats] + [[0] * len(stats)] * (len(parts) - 1), type=pa.list_(pa.int64())),
        }
    )


def _merged(table: pa.Table, width: int) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
    parts = [_opened(k, width) for k in table.column("keys").to_pylist()]
    counts = [np.frombuffer(pa.decompress(c, decompressed_size=4 * len(p[0]), codec="zstd", asbytes=True), dtype=np.uint32) for c, p in zip(table.column("counts").to_pylist(), parts, strict=True)]
    columns, counts = _summed([np.concatenate([p[k] for p in parts]) for k in range(width)], np.concatenate(counts))
    return table.column("bucket")[0].as_py(), columns, counts, np.sum(table.column("stats").to_pylist(), axis=0, dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch], order: int, counted, bucket_of, stats: int, most: int) -> Iterator[pa.RecordBatch]:
    """counted(tokens of some texts) over a task, sent whenever more than `most` different ones are held."""
    held, fresh, n_fresh = [], [], 0

    def merged():
        held.append(counted(fresh))
        if len(held) > 1:
            held[:] = [_summed([np.concatenate([c[k] for c, _ in held]) for k in range(len(held[0][0]))], np.concatenate([c for _, c in held]))]
        return held[0]

    for batch in batches:
        for tokens in tokens_of(batch.column(batch.schema.get_field_index("text")), order):
            fresh.append(tokens)
            n_fresh += len(tokens.hashes)
            if n_fresh > most + most // 2:
                columns, counts = merged()
                fresh, n_fresh = [], 0
                if len(counts) > most:
                    yield _packed(columns, counts, bucket_of(columns), [0] * stats)
                    held = []
    if fresh:
        merged()
    if held:
        columns, counts = held[0]
        if len(counts):
            yield _packed(columns, counts, bucket_of(columns), [0] * stats)


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts.astype(np.uint8)


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4."""
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def _discounts(n: list[int]) -> np.ndarray:
    """For counts 0, 1, 2 and from 3; where too little is counted to tell, half a step each."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0, [0, 1, 2, 3])


@dataclass
class Model:
    """What workers need besides the files."""

    path: str
    buckets: int
    #: Number of the first word of each bucket, and of all words.
    first: np.ndarray
    tokens: int
    order: int
    gram_buckets: int
    #: Type of word numbers; its greatest is the begin sign.
    kind: np.dtype
    #: Very frequent words, and over how many buckets their contexts are dealt.
    hot: np.ndarray
    hot_parts: np.ndarray
    #: By the number of words, from 1 on.
    discounts: list[np.ndarray]
    #: Manifests of the files.
    there: dict[str, np.ndarray] = field(default_factory=dict)
    #: Sum of continuation counts, and the weight that goes to the uniform distribution.
    pairs: int = 0
    rest: float = 1.0

    @property
    def begin(self) -> int:
        return int(np.iinfo(self.kind).max)

    def contexts(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of contexts, given as columns of word numbers, and over how many buckets each is dealt."""
        out, parts = np.zeros(len(columns[0]), dtype=bw.U64), None
        for c in columns:
            out = bw.mix(out * _C + c.astype(bw.U64) + bw.U64(1))
            k = bw.found_in(c.astype(np.int64), self.hot)
            own = np.where(k >= 0, self.hot_parts[k], 1) if len(self.hot) else np.ones(len(c), dtype=np.int64)
            parts = own if parts is None else np.minimum(parts, own)
        return out, parts

    def bucket_of(self, columns: list[np.ndarray]) -> np.ndarray:
        if len(columns) == 1:
            return (columns[0] // self.kind.type(RANGE)).astype(np.int64)
        return _bucket(_dealt(*self.contexts(columns[:-1]), columns[-1]), self.gram_buckets)


def _dealt(context: np.ndarray, parts: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the context, or of the part of it that has the word."""
    some = np.flatnonzero(parts > 1)
    if not len(some):
        return context
    out = context.copy()
    part = bw.mix(word[some].astype(bw.U64) + _C) % parts[some].astype(bw.U64)
    out[some] = _part(context[some], part)
    return out


def _part(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    return bw.mix(context * _C + part.astype(bw.U64) + bw.U64(1))


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value among values[low:high], which are sorted; -1 where it isn't."""
    if not len(values) or not len(wanted):
        return np.full(len(wanted), -1, dtype=np.int64)
    size, low = high - low, low.copy()
    step = 1 << (max(int(size.max()), 1).bit_length() - 1)
    while step:
        # Those among fewer values need no look.
        some = np.flatnonzero(size >= step)
        some = some if 2 * len(some) < len(size) else slice(None)
        probe = low[some] + step
        low[some] = np.where((probe <= high[some]) & (np.take(values, probe - 1, mode="clip") < wanted[some]), probe, low[some])
        step >>= 1
    return np.where((low < high) & (np.take(values, low, mode="clip") == wanted), low, -1)


def _cells(context: np.ndarray, buckets: int, cells: int) -> np.ndarray:
    """Cell of each context in its bucket."""
    return _bucket(context, buckets * cells) % cells


def _stored(context: np.ndarray, word: np.ndarray, counts: np.ndarray, buckets: int) -> dict[str, np.ndarray]:
    """The arrays of a bucket, of n-grams whose words ascend within a context.

    Contexts are in cells; a bit tells those with several next words (many), and
    how many have them is known before each 64 contexts. Then the word and count of
    those with one next word (lone), words and counts of the others, and totals of
    those with many.
    """
    n_cells = CELLS
    while n_cells * CELL < len(_begins(context)) and 2 * n_cells * buckets <= 1 << 32:
        n_cells *= 2
    key = _cells(context, buckets, n_cells).astype(bw.U64) << bw.U64(32) | context & bw.U64(0xFFFFFFFF)
    begins = _begins(key)
    order = np.argsort(key[begins], kind="stable")
    order = _spread(begins[order], np.diff(np.append(begins, len(key)))[order])
    if ((key[order[1:]] == key[order[:-1]]) & (word[order[1:]] < word[order[:-1]])).any():  # contexts of one cell and low half
        order = np.lexsort((word, key))
    key, word, counts = key[order], word[order], _narrow(counts[order])
    begins = _begins(key)
    n, key = np.diff(np.append(begins, len(word))), key[begins]
    lone, many = begins[n == 1], begins[n > 1]
    size = n[n > 1]
    starts = np.cumsum(size) - size
    flat = _spread(many, size)
    long = np.flatnonzero(size > LONG)
    own = counts[flat].astype(np.int64)
    sums = lambda v: np.add.reduceat(v.astype(np.int64), starts)[long] if len(starts) else np.zeros(0, dtype=np.int64)
    bits = np.packbits(np.append(n > 1, np.zeros(-len(n) % 64, dtype=bool)), bitorder="little").view("<u8")
    ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
    return {
        "cells": np.searchsorted(key, np.arange(n_cells + 1, dtype=bw.U64) << bw.U64(32)).astype(np.uint32), "contexts": key.astype(np.uint32),
        "many": bits, "many_before": (np.concatenate([[0], ranks[:-1]])[: len(bits)]).astype(np.uint32),
        "lone_word": word[lone], "lone_count": counts[lone], "first": np.append(starts, size.sum()).astype(np.uint32), "words": word[flat], "counts": counts[flat],
        "long": long.astype(np.uint32), "total": sums(own), "one": sums(own == 1), "two": sums(own == 2),
    }


def _found(file: dict[str, np.ndarray], context: np.ndarray, sizes: np.ndarray, word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the next words, sizes[k] of them for the k-th context; of each context: total, how many next words come once, twice, more often."""
    count, stats = np.zeros(len(word), dtype=np.int64), np.zeros((4, len(context)), dtype=np.int64)
    cell = _cells(context, buckets, len(file["cells"]) - 1)
    place = _bisect(file["contexts"], file["cells"][cell].astype(np.int64), file["cells"][cell + 1].astype(np.int64), context.astype(np.uint32))
    at = np.flatnonzero(place >= 0)
    place, of = place[at], np.cumsum(sizes) - sizes
    block, bit = place >> 6, (place & 63).astype(bw.U64)
    bits = file["many"][block]
    several = (bits >> bit & bw.U64(1)).astype(bool)
    rank = file["many_before"][block] + np.bitwise_count(bits & ((bw.U64(1) << bit) - bw.U64(1))).astype(np.int64)

    lone = ~several
    k, own_at = place[lone] - rank[lone], at[lone]
    own = file["lone_count"][k].astype(np.int64)
    stats[:, own_at] = own, own == 1, own == 2, own > 2
    asked = _spread(of[own_at], sizes[own_at])
    count[asked] = np.where(np.repeat(file["lone_word"][k], sizes[own_at]) == word[asked], np.repeat(own, sizes[own_at]), 0)

    k, own_at = rank[several], at[several]
    begin, end = file["first"][k].astype(np.int64), file["first"][k + 1].astype(np.int64)
    long = bw.found_in(k, file["long"].astype(np.int64))
    some = long >= 0
    m = long[some]
    total, one, two = file["total"][m], file["one"][m], file["two"][m]
    stats[:, own_at[some]] = total, one, two, (end - begin)[some] - one - two
    short = np.flatnonzero(~some)
    if len(short):
        n = (end - begin)[short]
        starts = np.cumsum(n) - n
        own = file["counts"][_spread(begin[short], n)]
        total, one, two = (np.add.reduceat(v, starts, dtype=np.int64) for v in (own, own == 1, own == 2))
        stats[:, own_at[short]] = total, one, two, n - one - two
    asked = _spread(of[own_at], sizes[own_at])
    w = _bisect(file["words"], np.repeat(begin, sizes[own_at]), np.repeat(end, sizes[own_at]), word[asked])
    hit = w >= 0
    count[asked[hit]] = file["counts"][w[hit]]
    return count, stats


class Reader:
    def __init__(self, model: Model) -> None:
        self.m = model
        folder = lambda kind: mapped.Folder(f"{model.path}/{kind}", model.there[kind]) if kind in model.there else None
        self.words, self.ranges = folder("words"), folder("before")
        self.grams = {k: folder(f"grams{k}") for k in range(2, model.order + 1)}
        #: Totals of contexts that are dealt over several buckets; there are few.
        self.totals: dict[tuple[int, int], np.ndarray] = {}

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of sorted, different words; number -1 and count 0 for unknown ones."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        bucket = _bucket(hashes, self.m.buckets)
        which, first = np.unique(bucket, return_index=True)
        for b, at in zip(which.tolist(), np.split(np.arange(len(hashes)), first[1:]), strict=False):
            file = self.words[b]
            if file is None:
                continue
            k = bw.found_in(hashes[at], file["keys"])
            at, k = at[k >= 0], k[k >= 0]
            number[at], count[at] = self.m.first[b] + k, file["counts"][k]
        return number, count

    def before(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), dtype=np.int64)
        part = numbers // RANGE
        for p in np.unique(part[numbers >= 0]).tolist():
            at, file = np.flatnonzero(part == p), self.ranges[p]
            if file is not None:
                out[at] = file["counts"][numbers[at] - p * RANGE]
        return out

    def followers(self, k: int, columns: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts of k - 1 words, equal ones together, and next words: counts, the contexts' totals and the weights they leave."""
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])[: len(word)]
        begins, of = np.flatnonzero(new), np.cumsum(new) - 1
        context, parts = self.m.contexts([c[begins] for c in columns])
        if (parts > 1).any():
            dealt = _dealt(context[of], parts[of], word)
            begins = np.flatnonzero(new | np.concatenate([[True], dealt[1:] != dealt[:-1]])[: len(word)])
            context, parts, dealt = context[of[begins]], parts[of[begins]], dealt[begins]
        else:
            dealt = context
        sizes = np.diff(np.append(begins, len(word)))
        count, stats = self._look(k, dealt, begins, sizes, word)
        for c in np.unique(context[parts > 1]):
            at = np.flatnonzero(context == c)
            if (k, int(c)) not in self.totals:
                every = _part(np.full(int(parts[at[0]]), c), np.arange(int(parts[at[0]])))
                none = np.zeros(len(every), dtype=np.int64)
                self.totals[k, int(c)] = self._look(k, every, none, none, none)[1].sum(axis=1)
            stats[:, at] = self.totals[k, int(c)][:, None]
        d, total = self.m.discounts[k], stats[0]
        left = np.where(total > 0, (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]) / np.maximum(total, 1), 1.0)
        return count, np.repeat(total, sizes), np.repeat(left, sizes)

    def _look(self, k: int, context: np.ndarray, begins: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What _found gives, over all buckets; the k-th context's next words are at begins[k], begins[k] + 1, ..."""
        count, stats = np.zeros(len(word), dtype=np.int64), np.zeros((4, len(context)), dtype=np.int64)
        order = np.argsort(context)
        bucket = _bucket(context[order], self.m.gram_buckets)
        first = _begins(bucket)
        for b, at in zip(bucket[first].tolist(), np.split(order, first[1:]), strict=False):
            file = self.grams[k][b]
            if file is not None:
                asked = _spread(begins[at], sizes[at])
                count[asked], stats[:, at] = _found(file, context[at], sizes[at], word[asked], self.m.gram_buckets)
        return count, stats

    def score(self, tokens: Tokens) -> dict[str, np.ndarray]:
        m = self.m
        words, index = np.unique(tokens.hashes, return_inverse=True)
        number, count = self.numbers(words)
        size = int(m.first[-1])
        known = count > 0
        base = np.log10((count + 1) / (m.tokens + size + 1))
        before = self.before(number)
        low = np.full(len(words), 1 / (size + 1))
        if m.pairs:
            low = np.maximum(before - m.discounts[1][np.minimum(before, 3)], 0) / m.pairs + m.rest / (size + 1)
        # Words by their places among the different ones; the place after them is the begin sign's.
        none = len(words)
        ids = np.append(number, m.begin)
        p = low[index]
        for k in range(2, m.order + 1):
            history = _history(index, tokens.bounds, k, none)
            # Contexts with unknown words leave all to the lower order.
            whole = np.flatnonzero(np.all([ids[h] >= 0 for h in history], axis=0))
            columns, of = _different([c[whole] for c in (*history, index)], none)
            *columns, word = (ids[c] for c in columns)
            # A number that no word has stands for unknown next words.
            count_k, total, left = self.followers(k, columns, np.where(word < 0, m.begin, word))
            high = np.maximum(count_k - m.discounts[k][np.minimum(count_k, 3)], 0) / np.maximum(total, 1)
            p[whole] = high[of] + left[of] * p[whole]
        # Every row has a token, its end, or if it goes on, words.
        first = tokens.bounds[:-1] + tokens.lead
        sums = lambda v: np.add.reduceat(v, first) if len(v) > tokens.lead else np.zeros(len(first), dtype=v.dtype)
        return {"n_tokens": tokens.bounds[1:] - first, "n_known": sums(known[index].astype(np.int64)), "base_score": sums(base[index]), "score": sums(np.log10(p))}


def _history(ids: np.ndarray, bounds: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The order - 1 words before each, from the farthest on; begin signs before the row."""
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    begin = np.int64(min(begin, np.iinfo(np.int64).max))
    return [np.where(place >= j, np.concatenate([np.full(min(j, len(ids)), begin), ids[:-j]]), begin) for j in range(order - 1, 0, -1)]


def _different(columns: list[np.ndarray], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted different rows of numbers from 0 to `most`, and which of them each row is."""
    packs = _packs(columns, most)
    if packs is not None:
        packs, of = np.unique(packs, return_inverse=True)
        return _unpacked(packs, len(columns), most), of
    order = np.lexsort(columns[::-1])
    new = np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)])[: len(order)]
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in columns], of


def _counted_words(some: list[Tokens]) -> tuple[list[np.ndarray], np.ndarray]:
    hashes = np.sort(np.concatenate([t.hashes[t.lead :] for t in some]))
    first = _begins(hashes)
    return [hashes[first]], np.diff(np.append(first, len(hashes)))


def _counted_grams(reader: Reader, some: list[Tokens], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted different n-grams of words' numbers, with their counts. Words are numbered in the order of their hashes."""
    words, index = np.unique(np.concatenate([t.hashes for t in some]), return_inverse=True)
    ids, none = np.append(reader.numbers(words)[0], reader.m.begin).astype(reader.m.kind), len(words)
    ends = np.cumsum([len(t.hashes) for t in some])
    parts = [[c[t.lead :] for c in (*_history(own, t.bounds, order, none), own)] for t, own in zip(some, np.split(index, ends[:-1]), strict=True)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    packs = _packs(columns, none)
    if packs is None:
        return _summed([ids[c] for c in columns], np.ones(len(columns[0]), dtype=np.int64))
    packs.sort()
    first = _begins(packs)
    return [ids[c] for c in _unpacked(packs[first], order, none)], np.diff(np.append(first, len(packs)))


def train(texts: DataFrame, order: int = 2, split: int = SPLIT, held: int = HELD, wide: bool = False) -> Model:
    """Count the texts (column text; null ones are empty) and store the model, of 2 words or more, in the shared folder.

    split: contexts whose words all occur more often are dealt over several
    buckets; held: different keys a task holds; wide: word numbers have 64 bits
    (as they have from 2**32 - 1 different words on). A text of more than four
    megabytes is worked through in pieces.
    """
    if order < 2:
        raise ValueError(f"order {order}; it is 2 or more")
    spark = texts.sparkSession
    texts = texts.select("text")
    path = shared.mounted(shared.folder(spark, "ngram"))
    size, n_texts = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(8, -(-(size or 0) // BUCKET_TEXT))

    def store_words(table: pa.Table) -> pa.Table:
        b, (keys,), counts, _ = _merged(table, 1)
        mapped.store(f"{path}/words-{b}", {"keys": keys, "counts": _narrow(counts)})
        often = np.flatnonzero(counts > split)
        one = lambda v, kind: pa.array([v], type=kind)
        return pa.table({"bucket": one(b, pa.int32()), "n": one(len(keys), pa.int64()), "total": one(int(counts.sum()), pa.int64()), "often": one(often, pa.list_(pa.int64())), "counts": one(counts[often], pa.list_(pa.int64()))})

    words = texts.mapInArrow(lambda it: _count(it, 1, _counted_words, lambda c: _bucket(c[0], buckets), 1, held), GRAMS)
    found = words.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(store_words, "bucket int, n long, total long, often array<long>, counts array<long>").collect()  # a row for each bucket
    n = np.zeros(buckets, dtype=np.int64)
    for r in found:
        n[r["bucket"]] = r["n"]
    first = np.concatenate([[0], np.cumsum(n)])
    kind = np.dtype(np.uint32 if first[-1] < (1 << 32) - 1 and not wide else np.int64)
    n_tokens = sum(r["total"] for r in found)
    often = [(int(first[r["bucket"]]) + k, c) for r in found for k, c in zip(r["often"], r["counts"], strict=True)] + [(int(np.iinfo(kind).max), n_texts)]
    least = max(split, n_tokens // SPLITS)
    hot = sorted((k, -(-c // least)) for k, c in often if c > least)
    model = Model(path, buckets, first, n_tokens, order, max(8, -(-(size or 0) * (order - 1) // BUCKET_TEXT)), kind, *(np.array(v, dtype=np.int64) for v in (zip(*hot, strict=True) if hot else ([], []))), [_discounts([0] * 4)] * (order + 1))
    model.there["words"] = mapped.manifest(path, "words", buckets, len(found))

    # By order: how many counts are 1 to 4, and files; then the sum of continuation counts, and how many are over 2.
    n_stats = 5 * (order + 1) + 2

    def count_grams(it):
        reader = Reader(model)
        return _count(it, order, lambda some: _counted_grams(reader, some, order), model.bucket_of, n_stats, held)

    def store_grams(table: pa.Table, k: int) -> pa.Table:
        b, columns, counts, stats = _merged(table, k)
        stats[5 * k : 5 * k + 5] += [*_of_counts(counts), 1]
        suffixes, before = _summed(columns[1:], np.ones(len(counts), dtype=np.int64))
        out = _packed(suffixes, before, model.bucket_of(suffixes), stats.tolist())
        mapped.store(f"{path}/grams{k}-{b}", _stored(_dealt(*model.contexts(columns[:-1]), columns[-1]), columns[-1], counts, model.gram_buckets))
        return pa.Table.from_batches([out])

    def storing(k: int):
        return lambda table: store_grams(table, k)

    def store_before(table: pa.Table) -> pa.Table:
        part, (keys,), counts, stats = _merged(table, 1)
        dense = np.zeros(min(RANGE, int(first[-1]) - part * RANGE), dtype=np.uint32)
        dense[keys.astype(np.int64) - part * RANGE] = counts
        mapped.store(f"{path}/before-{part}", {"counts": dense})
        stats[5:10] += [*_of_counts(dense), 1]
        stats[-2:] += [int(dense.sum()), int(np.count_nonzero(dense > 2))]
        return pa.table({"stats": pa.array([stats.tolist()], type=pa.list_(pa.int64()))})

    grams = texts.mapInArrow(count_grams, GRAMS)
    for k in range(order, 1, -1):
        grams = grams.repartition(model.gram_buckets, "bucket").groupBy("bucket").applyInArrow(storing(k), GRAMS)
    stats = [r["stats"] for r in grams.groupBy("bucket").applyInArrow(store_before, "stats array<bigint>").collect()]  # a row for each range
    stats = np.sum(stats, axis=0, dtype=np.int64).tolist() if stats else [0] * n_stats
    for k in range(2, order + 1):
        model.there[f"grams{k}"] = mapped.manifest(path, f"grams{k}", model.gram_buckets, stats[5 * k + 4])
    model.there["before"] = mapped.manifest(path, "before", int(first[-1]) // RANGE + 1, stats[9])
    model.discounts = [_discounts(stats[5 * k : 5 * k + 4]) for k in range(order + 1)]
    n1, n2 = stats[5:7]
    total, more = stats[-2:]
    d = model.discounts[1]
    model.pairs = total
    model.rest = float(d[1] * n1 + d[2] * n2 + d[3] * more) / total if total else 1.0
    return model


MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty and have one token, their end. score is the model's
    log10 probability of the text, base_score that of a unigram model with one
    added to each count. Repeated rows stay; columns named like a made one are
    replaced. A text of more than four megabytes is scored in pieces.
    """
    docs = docs.drop(*MADE)
    columns = docs.columns

    def run(batches):
        reader = Reader(model)
        for batch in batches:
            held: dict[str, np.ndarray] = {}
            for tokens in tokens_of(batch.column(batch.schema.get_field_index("text")), model.order):
                got = reader.score(tokens)
                got = {k: held[k] + v if held else v for k, v in got.items()}
                held = got if tokens.more else {}
                if tokens.more:
                    continue
                n = len(got["score"])
                own = batch.slice(tokens.first, n)
                arrays = {c: own.column(k) for k, c in enumerate(own.schema.names)}
                arrays |= {"n_tokens": pa.array(got["n_tokens"], type=pa.int64()), "n_known": pa.array(got["n_known"], type=pa.int64()), "train_tokens": pa.array(np.full(n, model.tokens), type=pa.int64()), "base_score": pa.array(got["base_score"]), "score": pa.array(got["score"])}
                yield pa.RecordBatch.from_pydict({c: arrays[c] for c in (*columns, *MADE)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out():
    """crc32 of the id's text leaves 2 modulo 7; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()), ORDER)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
