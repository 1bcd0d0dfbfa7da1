"""Suffix-array deduplication of byte strings that occur more than once.

A window is WINDOW bytes. Of the GRAM-byte grams that a window holds, the one
with the least hash is an anchor, so equal windows have equal anchors at the
same place (winnowing). The context of an anchor is all bytes of windows that
hold it. Over all texts:

1. Contexts are counted by their digests, which spread over all tasks whatever
   their anchors are; equal ones become one with its first place (by id and
   place). Then the different contexts of each anchor are counted.
2. The first of equal contexts goes to its anchor's bucket, if the anchor has
   others. There suffixes are sorted (a sparse suffix array: those that start at
   the anchors, and likewise the reversed bytes before them, with the common
   prefixes of neighbours), which gives the suffix order of the windows that
   start so many bytes before the anchor. In that order the previous and the next
   suffix with a smaller place give each its longest previous factor.
3. Texts are read again. A window goes if its longest previous factor is WINDOW
   or more, or, unless the first is to stay, if it is such a factor itself.

Of equal contexts all but the first have the whole context as previous factor,
so one of them stands for all. An anchor with more than CROWD different contexts
is divided further, by window: a window's hash gives its bucket, equal windows
become one in each task, and the same two arrays are computed over the windows in
order of their hashes. What 1 and 2 find is in sorted hash arrays in the shared
folder, memory-mapped by the tasks of 2 and 3. Long texts are worked through in
parts that overlap.
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
from celestrum.llm import mapped, shared

WINDOW = 200
GRAM = 24
BUCKET_TEXT = 24 << 20
SLICE_BYTES = 1 << 20
HELD = 300_000
HELD_BYTES = 8 << 20
#: Contexts that are sorted together, if their anchors have so many.
BLOCK = 8_000
CROWD = 20_000
_MAX = bw.U64(0xFFFFFFFFFFFFFFFF)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """By the leading 32 bits, in the values' order."""
    return ((values >> bw.U64(32)) * bw.U64(buckets) >> bw.U64(32)).astype(np.int64)



@dataclass
class Docs:
    """What tells documents apart: the id (least for a null one), and a digest of the text and of whether the id is null."""

    id: np.ndarray
    tag: np.ndarray


@dataclass
class Part:
    """Some texts, or a part of a long one with what surrounds it; it answers for bytes low to high of data. base: bytes of the text before data."""

    texts: bw.Texts
    docs: Docs
    base: int
    low: int
    high: int


def _parts(texts: bw.Texts, docs: Docs, window: int, limit: int = 2 * SLICE_BYTES) -> Iterator[Part]:
    n = len(texts.data)
    if n <= limit:
        yield Part(texts, docs, 0, 0, n)
        return
    # A text of its own. An anchor follows from the bytes a window to each side, and so does its context.
    for at in range(0, n, limit):
        first, last = max(0, at - 3 * window), min(n, at + limit + 3 * window)
        yield Part(bw.Texts(texts.first, texts.data[first:last], np.array([0, last - first])), docs, first, at - first, min(n, at + limit) - first)


class Anchors:
    """Anchors of a part and up to a window around it; left and right: bytes of the context before the anchor and from it on; own: in the part."""

    def __init__(self, part: Part, window: int) -> None:
        texts = part.texts
        reach = window - GRAM + 1  # grams in a window
        data, bounds = texts.data, texts.bounds
        n = len(data)
        self.sums, self.down = bw.prefix_hashes(data)
        if n < GRAM:
            self.at = self.row = self.left = self.right = np.zeros(0, dtype=np.int64)
            self.hash = self.digest = np.zeros(0, dtype=bw.U64)
            self.own = np.zeros(0, dtype=bool)
            return
        h = bw.mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: n - GRAM + 1])
        ends = bounds[1:-1]
        ends = ends[(ends > 0) & (ends < n)]
        cross = np.unique((ends[:, None] - np.arange(1, GRAM)[None, :]).ravel())
        cross = cross[(cross >= 0) & (cross < len(h))]
        h[cross] = _MAX
        at = np.flatnonzero(bw.winnowed(h, reach) & (h != _MAX))
        at = at[(at >= part.low - window) & (at < part.high + window)]
        row = np.searchsorted(bounds, at, side="right") - 1
        left = np.minimum(at - bounds[row], reach - 1)
        right = np.minimum(bounds[row + 1] - at, window)
        whole = left + right >= window
        self.at, self.row, self.left, self.right = at[whole], row[whole], left[whole], right[whole]
        self.hash = bw.mix(h[self.at])  # least hashes are small; buckets go by leading bits
        span = bw.span_hashes(self.sums, self.down, self.at - self.left, self.at + self.right)
        self.digest = bw.mix(span + (self.left * 65536 + self.right).astype(bw.U64) * bw.U64(0x9E3779B97F4A7C15))
        self.own = (self.at >= part.low) & (self.at < part.high)


FIELDS = (("anchor", bw.U64), ("digest", bw.U64), ("count", np.uint32), ("doc", np.int64), ("tag", bw.U64), ("place", np.int64))
PACKED = "bucket int, " + ", ".join(f"{n} binary" for n, _ in FIELDS)


def _least_first(a: dict[str, np.ndarray], by: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows with equal keys become one: counts are summed, of (doc, tag, place) the least stays. Sorted by the keys."""
    order = np.lexsort((a["place"], a["tag"], a["doc"], *(a[k] for k in reversed(by))))
    a = {k: v[order] for k, v in a.items()}
    if not len(order):
        return a, order
    first = np.flatnonzero(np.concatenate([[True], np.any([a[k][1:] != a[k][:-1] for k in by], axis=0)]))
    count = np.minimum(np.add.reduceat(a["count"].astype(np.int64), first), 1 << 30).astype(np.uint32)
    return {k: v[first] for k, v in a.items()} | {"count": count}, order[first]


def _packed(a: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    parts = np.split(order, first[1:])
    return pa.RecordBatch.from_pydict({"bucket": pa.array(which, type=pa.int32())} | {k: pa.array([a[k][p].astype(t).tobytes() for p in parts], type=pa.binary()) for k, t in FIELDS})


def _unpacked(table: pa.Table) -> tuple[int, dict[str, np.ndarray]]:
    return table.column("bucket")[0].as_py(), {k: np.frombuffer(b"".join(table.column(k).to_pylist()), dtype=t) for k, t in FIELDS}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bw.Texts, Docs]]:
    """Columns: the id, the text, others."""
    for batch in batches:
        column = batch.column(0)
        ids, null = column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        for texts in bw.slices(batch.column(1), SLICE_BYTES):
            rows = slice(texts.first, texts.first + len(texts))
            if len(texts.data) > 2 * SLICE_BYTES:
                tag = np.frombuffer(hashlib.blake2b(texts.data, digest_size=8).digest(), dtype=bw.U64)
            else:
                sums, down = bw.prefix_hashes(texts.data)
                tag = bw.span_hashes(sums, down, texts.bounds[:-1], texts.bounds[1:])
            yield batch, texts, Docs(ids[rows], np.where(null[rows], ~tag, tag))


def _each_part(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Part]:
    for _, texts, docs in _batches(batches):
        yield from _parts(texts, docs, window)


def _occurrences(a: Anchors, part: Part, some: np.ndarray) -> dict[str, np.ndarray]:
    row = a.row[some]
    return {"anchor": a.hash[some], "digest": a.digest[some], "count": np.ones(len(some), dtype=np.uint32), "doc": part.docs.id[row], "tag": part.docs.tag[row], "place": part.base + a.at[some] - part.texts.bounds[row]}


def _join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _count(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Contexts by their digests."""
    held, n = [], 0
    for part in _each_part(batches, window):
        a = Anchors(part, window)
        held.append(_occurrences(a, part, np.flatnonzero(a.own)))
        n += len(held[-1]["anchor"])
        if n > HELD:
            joined, _ = _least_first(_join(held), ("digest",))
            yield _packed(joined, bucket_of(joined["digest"], buckets))
            held, n = [], 0
    if n:
        joined, _ = _least_first(_join(held), ("digest",))
        yield _packed(joined, bucket_of(joined["digest"], buckets))


ANCHORS = "bucket int, anchors binary, counts binary, files long"


def _settle_contexts(table: pa.Table, path: str, buckets: int) -> pa.Table:
    """The file of a bucket: contexts that occur twice, with their first places. Sent on: how many different contexts anchors have here."""
    b, a = _unpacked(table)
    a, _ = _least_first(a, ("digest",))
    twin = a["count"] > 1
    mapped.store(f"{path}/contexts-{b}", {k: a[k][twin] for k in ("digest", "doc", "tag", "place")})
    anchors, counts = np.unique(a["anchor"], return_counts=True)
    bucket = bucket_of(anchors, buckets)
    which, first = np.unique(bucket, return_index=True)
    parts = [slice(i, j) for i, j in zip(first, np.append(first[1:], len(bucket)), strict=True)]
    return pa.table(
        {
            "bucket": pa.array(which, type=pa.int32()),
            "anchors": pa.array([anchors[p].tobytes() for p in parts], type=pa.binary()),
            "counts": pa.array([counts[p].astype(np.uint32).tobytes() for p in parts], type=pa.binary()),
            "files": pa.array([1] + [0] * (len(parts) - 1), type=pa.int64()),
        }
    )


def _settle_anchors(table: pa.Table, path: str, crowd: int) -> pa.Table:
    """The file of a bucket: anchors that have different contexts, and whether they are crowded."""
    b = table.column("bucket")[0].as_py()
    anchors = np.frombuffer(b"".join(table.column("anchors").to_pylist()), dtype=bw.U64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.uint32).astype(np.int64)
    order = np.argsort(anchors, kind="stable")
    anchors, counts = anchors[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    anchors, counts = anchors[first], np.add.reduceat(counts, first)
    mapped.store(f"{path}/anchors-{b}", {"anchor": anchors[counts > 1], "crowded": (counts[counts > 1] > crowd).astype(np.uint8)})
    return pa.table({"contexts": pa.array([sum(table.column("files").to_pylist())], type=pa.int64()), "anchors": pa.array([1], type=pa.int64())})


class Lookup:
    """What the folder has about anchors. there: the manifest of each kind of file."""

    def __init__(self, path: str, buckets: int, there: dict[str, np.ndarray]) -> None:
        self.buckets = buckets
        self.files = {k: mapped.Folder(f"{path}/{k}", v) for k, v in there.items()}

    def several(self, a: Anchors) -> np.ndarray:
        """1 for anchors with different contexts, 2 for crowded ones."""
        out = np.zeros(len(a.at), dtype=np.uint8)
        for at, file in self._by_bucket("anchors", a.hash):
            k = bw.found_in(a.hash[at], file["anchor"])
            out[at[k >= 0]] = 1 + file["crowded"][k[k >= 0]]
        return out

    def twins(self, a: Anchors, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """Whether the context occurs twice, and whether this is its first place."""
        twin, here = np.zeros(len(a.at), dtype=bool), np.ones(len(a.at), dtype=bool)
        for at, file in self._by_bucket("contexts", a.digest):
            k = bw.found_in(a.digest[at], file["digest"])
            at, k = at[k >= 0], k[k >= 0]
            row = a.row[at]
            twin[at] = True
            here[at] = (file["doc"][k] == part.docs.id[row]) & (file["tag"][k] == part.docs.tag[row]) & (file["place"][k] == part.base + a.at[at] - part.texts.bounds[row])
        return twin, here

    def _by_bucket(self, kind: str, values: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        bucket = bucket_of(values, self.buckets)
        order = np.argsort(bucket, kind="stable")
        which, first = np.unique(bucket[order], return_index=True)
        for b, at in zip(which.tolist(), np.split(order, first[1:]), strict=False):
            file = self.files[kind][b]
            if file is not None:
                yield at, file


def _windows(a: Anchors, some: np.ndarray, part: Part, window: int) -> np.ndarray:
    """Starts, from the part's first byte less a window on, of all windows that hold one of the anchors for which `some` is true."""
    edges = np.zeros(len(part.texts.data) + 1, dtype=np.int32)
    np.add.at(edges, (a.at - a.left)[some], 1)
    np.add.at(edges, (a.at + a.right - window + 1)[some], -1)
    start = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    return start[(start > part.low - window) & (start < part.high)]


CONTEXTS = PACKED + ", sizes binary, bytes binary"


def _send(batches: Iterator[pa.RecordBatch], look: Lookup, window: int) -> Iterator[pa.RecordBatch]:
    """The first of equal contexts of anchors that have several; windows of crowded anchors by their hashes, under buckets from look.buckets on."""
    buckets = look.buckets
    held, sizes, texts_held, n_bytes = [], [], [], 0
    hashed, n_hashed = [], 0

    def contexts() -> pa.RecordBatch:
        a, pick = _least_first(_join(held), ("anchor", "digest"))
        left_right, where = np.concatenate(sizes), np.concatenate([t for t, _ in texts_held])
        blob = b"".join(b for _, b in texts_held)
        ends = np.cumsum(where)
        bucket = bucket_of(a["anchor"], buckets)
        base = _packed(a, bucket)
        order = np.argsort(bucket, kind="stable")
        parts = np.split(order, np.unique(bucket[order], return_index=True)[1][1:])
        return (
            pa.Table.from_batches([base])
            .append_column("sizes", pa.array([left_right[pick[p]].astype(np.uint32).tobytes() for p in parts], type=pa.binary()))
            .append_column("bytes", pa.array([b"".join(blob[ends[k] - where[k] : ends[k]] for k in pick[p].tolist()) for p in parts], type=pa.binary()))
            .combine_chunks()
            .to_batches()[0]
        )

    def windows() -> pa.RecordBatch:
        a, _ = _least_first(_join(hashed), ("anchor",))
        base = _packed(a, buckets + bucket_of(a["anchor"], buckets))
        nothing = pa.array([b""] * base.num_rows, type=pa.binary())
        return pa.Table.from_batches([base]).append_column("sizes", nothing).append_column("bytes", nothing).combine_chunks().to_batches()[0]

    for part in _each_part(batches, window):
        texts, docs = part.texts, part.docs
        a = Anchors(part, window)
        several = look.several(a)
        some = np.flatnonzero((several == 1) & a.own)
        if len(some):
            some = some[look.twins(a, part)[1][some]]
        if len(some):
            held.append(_occurrences(a, part, some))
            sizes.append(a.left[some] * 65536 + a.right[some])
            start, size = a.at[some] - a.left[some], a.left[some] + a.right[some]
            total = np.cumsum(size)
            texts_held.append((size, texts.data[np.repeat(start - (total - size), size) + np.arange(total[-1])].tobytes()))
            n_bytes += int(total[-1])
        start = _windows(a, several == 2, part, window)
        start = start[start >= part.low]
        if len(start):
            row = np.searchsorted(texts.bounds, start, side="right") - 1
            h = bw.span_hashes(a.sums, a.down, start, start + window)
            hashed.append({"anchor": h, "digest": h, "count": np.ones(len(h), dtype=np.uint32), "doc": docs.id[row], "tag": docs.tag[row], "place": part.base + start - texts.bounds[row]})
            n_hashed += len(h)
            if n_hashed > HELD:
                yield windows()
                hashed, n_hashed = [], 0
        if n_bytes > HELD_BYTES:
            yield contexts()
            held, sizes, texts_held, n_bytes = [], [], [], 0
    if held:
        yield contexts()
    if hashed:
        yield windows()


def nearest_smaller(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in suffix order the nearest one before with a smaller place (-1: none) and what both have in common.

    common: what each has in common with the one before. All pointers jump at
    once: over a suffix with no smaller place goes where that one's pointer goes.
    """
    to, low = np.arange(len(place)) - 1, common.copy()
    low[:1] = 0
    todo = np.flatnonzero(low > 0)
    todo = todo[place[to[todo]] >= place[todo]]
    while len(todo):
        over = to[todo]
        low[todo] = np.minimum(low[todo], low[over])
        to[todo] = to[over]
        todo = todo[low[todo] > 0]
        todo = todo[place[to[todo]] >= place[todo]]
    return np.where(low > 0, to, -1), low


def previous_factors(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous factors of suffixes in suffix order, and where they are: the previous and the next suffix with a smaller place (-1: none).

    The longer of what a suffix has in common with the two is the longest string
    at its place that also starts at a smaller one.
    """
    before, low = nearest_smaller(place, common)
    after, high = nearest_smaller(place[::-1], np.concatenate([[0], common[:0:-1]]) if len(common) else common)
    after, high = np.where(after >= 0, len(place) - 1 - after, -1)[::-1], high[::-1]
    return np.maximum(low, high), before, after


def _sorted_rows(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes by group and bytes, and with how many bytes each agrees with the one before (-1: another group)."""
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
    width, flat = keyed.shape[1], keyed.tobytes()
    order = np.array(sorted(range(len(rows)), key=lambda k: flat[k * width : (k + 1) * width]), dtype=np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def _most(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What each has in common with any other at most: with a neighbour in the order."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(common, np.append(common[1:], -1))
    return out


def context_factors(group: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context and each number l of bytes before the anchor at which a window may start: whether the longest previous
    factor there is a window or more, and whether the window there is the previous factor of a later one.

    group: number of the anchor; first: rank of the context's first place;
    after: the bytes from the anchor on, before: those before it, from it backwards,
    each row filled up beyond right and left.

    after sorted is the suffix array of the anchors' suffixes, with the bytes in
    common with the suffix before as its LCP array; before sorted is that of the
    reversed texts. Suffixes that start l bytes before the anchor, cut at a window,
    are in suffix order if they are so by the latter's classes of l bytes, and within
    those by the former; two neighbours have a window in common if no smaller LCP
    lies between them in either array. Shorter common prefixes count as none.
    """
    n, width = before.shape[0], before.shape[1] + 1
    order_a, common_a = _sorted_rows(group, after)
    order_b, common_b = _sorted_rows(group, before)
    most_a, most_b = _most(order_a, common_a), _most(order_b, common_b)
    later, source = np.zeros((n, width), dtype=bool), np.zeros((n, width), dtype=bool)
    rank_a, class_a, class_b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    rank_a[order_a] = np.arange(n)
    able = np.flatnonzero(most_a + most_b >= window)
    for l in range(width):  # noqa: E741
        some = able[(left[able] >= l) & (right[able] >= window - l) & (most_b[able] >= l) & (most_a[able] >= window - l)]
        if len(some) < 2:
            continue
        class_a[order_a] = np.cumsum(common_a < window - l)
        class_b[order_b] = np.cumsum(common_b < l)
        some = some[np.argsort(class_b[some] * n + rank_a[some], kind="stable")]
        same = np.concatenate([[False], (class_b[some[1:]] == class_b[some[:-1]]) & (class_a[some[1:]] == class_a[some[:-1]])])
        shared_ = same | np.append(same[1:], False)
        some, same = some[shared_], same[shared_]
        if not len(some):
            continue
        length, back, ahead = previous_factors(first[some], np.where(same, window, 0))
        later[some, l] = length >= window
        for to in (back, ahead):
            source[some[to[to >= 0]], l] = True
    return later, source


def _sort(table: pa.Table, path: str, buckets: int, window: int) -> pa.Table:
    b, a = _unpacked(table)
    if b >= buckets:  # windows of crowded anchors: equal ones are neighbours in order of their hashes
        order = np.lexsort((a["place"], a["tag"], a["doc"], a["anchor"]))
        a = {k: v[order] for k, v in a.items()}
        many = a["count"] > 1
        same = np.concatenate([[False], a["anchor"][1:] == a["anchor"][:-1]])
        length, _, _ = previous_factors(np.arange(len(order)), np.where(same, window, 0))
        # The first of equal ones stands for them, if a task has several or another has one.
        first = (length < window) & (many | np.append(same[1:], False))
        mapped.store(f"{path}/windows-{b - buckets}", {"window": a["anchor"][first], "doc": a["doc"][first], "tag": a["tag"][first], "place": a["place"][first]})
        return pa.table({"sorted": pa.array([0], type=pa.int64()), "windows": pa.array([1], type=pa.int64())})
    size = np.frombuffer(b"".join(table.column("sizes").to_pylist()), dtype=np.uint32).astype(np.int64)
    data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8)
    length = (size >> 16) + (size & 65535)
    ends = np.cumsum(length)
    a, pick = _least_first(a, ("anchor", "digest"))
    length, start, size = length[pick], (ends - length)[pick], size[pick]
    digests, left, right = a["digest"], size >> 16, size & 65535
    width = window - GRAM + 1
    order = np.lexsort((a["place"], a["tag"], a["doc"]))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], np.any([a[k][order][1:] != a[k][order][:-1] for k in ("doc", "tag", "place")], axis=0)]))
    group = np.cumsum(np.concatenate([[True], a["anchor"][1:] != a["anchor"][:-1]])) - 1
    later = np.zeros((len(digests), width), dtype=bool)
    source = np.zeros((len(digests), width), dtype=bool)
    k = 0
    while k < len(digests):
        # Whole anchors, as many as make a block; no anchor has more than the crowd's limit of contexts.
        j = int(np.searchsorted(group, group[min(len(group) - 1, k + BLOCK)])) if k + BLOCK < len(group) else len(group)
        j = j if j > k else int(np.searchsorted(group, group[k], side="right"))
        own = np.arange(k, j)
        k = j
        after = np.zeros((len(own), window), dtype=np.uint8)
        before = np.zeros((len(own), width - 1), dtype=np.uint8)
        middle = start[own] + left[own]
        row, place = np.nonzero(np.arange(window)[None, :] < right[own][:, None])
        after[row, place] = data[middle[row] + place]
        row, place = np.nonzero(np.arange(width - 1)[None, :] < left[own][:, None])
        before[row, place] = data[middle[row] - 1 - place]
        _, first = np.unique(rank[own], return_inverse=True)
        behind, ahead = context_factors(group[own] - group[own[0]], first, left[own], right[own], before, after, window)
        # From bytes before the anchor to the window's place in the context.
        at = left[own][:, None] - np.arange(width)[None, :]
        row, l = np.nonzero(at >= 0)  # noqa: E741
        later[own[row], at[row, l]] = behind[row, l]
        source[own[row], at[row, l]] = ahead[row, l]
    order = np.argsort(digests, kind="stable")
    order = order[(later | source).any(axis=1)[order]]
    mapped.store(f"{path}/sorted-{b}", {"digest": digests[order], "later": np.packbits(later[order], axis=1).ravel(), "source": np.packbits(source[order], axis=1).ravel()})
    return pa.table({"sorted": pa.array([1], type=pa.int64()), "windows": pa.array([0], type=pa.int64())})


def _removed(look: Lookup, part: Part, window: int, keep_first: bool) -> np.ndarray:
    """For each byte of the part whether a window covers it that has a previous factor as long as itself (or, unless the first stays, is one)."""
    texts, docs = part.texts, part.docs
    a = Anchors(part, window)
    several = look.several(a)
    twin, here = look.twins(a, part)
    edges = np.zeros(len(texts.data) + 1, dtype=np.int32)
    width = window - GRAM + 1
    packed_width = -(-width // 8)
    # All windows of a context that occurs earlier have previous factors in it.
    plain = np.flatnonzero((twin & ~here if keep_first else twin) & (several < 2))
    np.add.at(edges, a.at[plain] - a.left[plain], 1)
    np.add.at(edges, a.at[plain] + a.right[plain], -1)
    starts = []
    some = np.flatnonzero((several == 1) & (here if keep_first else ~twin))
    bucket = bucket_of(a.hash[some], look.buckets)
    for b in np.unique(bucket).tolist():
        file = look.files["sorted"][b]
        if file is None:
            continue
        at = some[bucket == b]
        k = bw.found_in(a.digest[at], file["digest"])
        at, k = at[k >= 0], k[k >= 0]
        bits = file["later"].reshape(-1, packed_width)[k]
        if not keep_first:
            bits = bits | file["source"].reshape(-1, packed_width)[k]
        bits = np.unpackbits(bits, axis=1)[:, :width].astype(bool)
        bits &= np.arange(width)[None, :] <= (a.left[at] + a.right[at] - window)[:, None]
        i, offset = np.nonzero(bits)
        starts.append(a.at[at[i]] - a.left[at[i]] + offset)
    start = _windows(a, several == 2, part, window)
    if len(start):
        row = np.searchsorted(texts.bounds, start, side="right") - 1
        h = bw.span_hashes(a.sums, a.down, start, start + window)
        of = bucket_of(h, look.buckets)
        for b in np.unique(of).tolist():
            file = look.files["windows"][b]
            if file is None:
                continue
            at = np.flatnonzero(of == b)
            w = bw.found_in(h[at], file["window"])
            at, w = at[w >= 0], w[w >= 0]
            if keep_first:
                later = ~((file["doc"][w] == docs.id[row[at]]) & (file["tag"][w] == docs.tag[row[at]]) & (file["place"][w] == part.base + start[at] - texts.bounds[row[at]]))
                at = at[later]
            starts.append(start[at])
    if starts:
        start = np.concatenate(starts)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + window, -1)
    return (np.cumsum(edges[:-1]) > 0)[part.low : part.high]


def _manifests(df: DataFrame, path: str, buckets: int, *kinds: str) -> dict[str, np.ndarray]:
    written = df.agg(*[F.sum(k) for k in kinds]).first()
    return {k: mapped.manifest(path, k, buckets, n or 0) for k, n in zip(kinds, written, strict=True)}


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_first: bool = False, id_column: str = "doc_id", details: bool = True, crowd: int = CROWD) -> DataFrame:
    """docs' columns with text cut, and n_bytes, n_removed, n_spans, kept_sha256 (details).

    Each byte that is covered by a string of `window` bytes that starts at another
    place too, in any row or the same, is removed; strings are those of the input.
    With keep_first the first of equal strings, by id (null ones first), then by a digest
    of the text and then by place, stays; rows with the same id (or none) and text are then
    one document. Null texts are empty (and
    stay null); texts shorter than the window are left as they are. Characters of
    which a part is removed go from `text`, while kept_sha256 is of the bytes kept.
    Columns named like a detail are replaced; others stay, whatever their names.
    A text of more than two megabytes is worked through in parts of that size.
    """
    spark = docs.sparkSession
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    docs = docs.drop(*made) if details else docs
    columns = docs.columns
    (id_,) = shared.free(columns, "_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    path = shared.mounted(shared.folder(spark, "repeats"))
    keyed = docs.select(F.col(id_column).cast("long").alias(id_), "text", *[c for c in columns if c != "text"])
    texts = keyed.select(id_, "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_TEXT))
    contexts = texts.mapInArrow(lambda it: _count(it, buckets, window), PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _settle_contexts(t, path, buckets), ANCHORS)
    anchors = contexts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _settle_anchors(t, path, crowd), "contexts long, anchors long")
    there = _manifests(anchors, path, buckets, "contexts", "anchors")
    sent = texts.mapInArrow(lambda it: _send(it, Lookup(path, buckets, there), window), CONTEXTS).repartition(2 * buckets, "bucket")
    gathered = sent.groupBy("bucket").applyInArrow(lambda t: _sort(t, path, buckets, window), "sorted long, windows long")
    found = there | _manifests(gathered, path, buckets, "sorted", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(path, buckets, found)
        for batch, part, own_docs in _batches(batches):
            gone = np.concatenate([_removed(look, p, window, keep_first) for p in _parts(part, own_docs, window)])
            own = batch.slice(part.first, len(part))
            arrays = dict(zip(own.schema.names, own.columns, strict=True))
            given, out = arrays["text"], []
            total = np.concatenate([[0], np.cumsum(gone)])
            n_removed = total[part.bounds[1:]] - total[part.bounds[:-1]]
            edge = gone & ~np.concatenate([[False], gone[:-1]])
            first = part.bounds[:-1][np.diff(part.bounds) > 0]
            edge[first] = gone[first]
            spans = np.concatenate([[0], np.cumsum(edge)])
            digests = []
            for k in range(len(part)):
                i, j = part.bounds[k], part.bounds[k + 1]
                if n_removed[k] or details:
                    kept = part.data[i:j][~gone[i:j]].tobytes() if n_removed[k] else part.data[i:j].tobytes()
                    digests.append(hashlib.sha256(kept).hexdigest() if details else None)
                    out.append(kept.decode(errors="ignore") if n_removed[k] else given[k].as_py())
                else:
                    out.append(given[k].as_py())
            arrays["text"] = pa.array(out, type=pa.string())
            if details:
                arrays |= {"n_bytes": pa.array(np.diff(part.bounds), type=pa.int64()), "n_removed": pa.array(n_removed, type=pa.int64()), "n_spans": pa.array(spans[part.bounds[1:]] - spans[part.bounds[:-1]], type=pa.int64()), "kept_sha256": pa.array(digests, type=pa.string())}
            yield pa.RecordBatch.from_pydict({c: arrays[c] for c in (*columns, *(made if details else ()))})

    return keyed.mapInArrow(run, fields + (", n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" if details else ""))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("text")


#: Texts as hexadecimal digits, cut into chunks so that no window is looked for far into a string.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunk AS (SELECT r, c, substr(h, 2 * c + 1, 2 * 1199) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2, 1000)) AS c FROM d)),
win AS (SELECT r, c + k AS p, md5_number(substr(h, 2 * k + 1, 400)) AS g FROM (SELECT r, c, h, unnest(range(0, least(1000, length(h) // 2 - 199))) AS k FROM chunk)),
hit AS (SELECT r, p FROM win SEMI JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
edge AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200, true) AS fresh FROM hit),
span AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM edge) GROUP BY r, i),
kept AS (SELECT r, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM span WINDOW w AS (PARTITION BY r ORDER BY a)
         UNION ALL SELECT r, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN span USING (r) GROUP BY r),
rest AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM kept JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM span GROUP BY r)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.h, ''))) AS kept_sha256
FROM d JOIN rest USING (r) LEFT JOIN gone USING (r)
"""
