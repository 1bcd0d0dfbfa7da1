"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts come as Arrow arrays and are worked through in slices of a few megabytes,
and longer texts in pieces, so a task's memory doesn't follow its partition, and
hardly its longest text. A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of a well-known splittable generator)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_b = np.arange(256)
#: Words are what is between the bytes 0x20 and 0x09-0x0D.
SPACED = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
#: Words are of 0-9, A-Z, a-z and whatever is beyond ASCII.
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
LOWER = _lower()
LINE = np.array([10], dtype=np.uint8)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _P, dtype=U64)]), dtype=U64)
                self.down = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _P_INV, dtype=U64)]), dtype=U64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sums, down: the hash of data[i:j] is mix((sums[j] - sums[i]) * down[i])."""
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return sums, down


def span_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Texts:
    """Some consecutive rows: data holds their bytes one after the other, row k at bounds[k]:bounds[k + 1]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    #: Words of row k are at of_row[k]:of_row[k + 1].
    of_row: np.ndarray


def _string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Nulls are empty. A text longer than the limit is a slice of its own."""
    column = _string_array(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Texts(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(texts: Texts, inside: np.ndarray, fold: bool = True) -> Words:
    """Words of bytes for which `inside` is true, hashed with A-Z lower-cased (unless fold is false). No word crosses rows. A long text is worked through in pieces."""
    data = texts.data
    n, rows = len(data), len(texts)
    if rows == 1 and n > 2 * SLICE_BYTES:
        parts, at = [], 0
        for piece in pieces(texts, inside, SLICE_BYTES):
            w = words(Texts(0, np.concatenate([piece.data, LINE]), np.array([0, len(piece.data), len(piece.data) + 1])), inside, fold)
            parts.append((w.starts + at, w.ends + at, w.hashes))
            at += len(piece.data)
        starts, ends, hashes = (np.concatenate(v) for v in zip(*parts, strict=True))
        return Words(starts, ends, np.zeros(len(starts), dtype=np.int64), hashes, np.array([0, len(starts)]))
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(0, dtype=U64), np.zeros(rows + 1, dtype=np.int64))
    is_in = inside[data]
    first = np.zeros(n + 1, dtype=bool)
    first[texts.bounds] = True
    after = np.concatenate([[False], is_in[:-1]])
    starts = np.flatnonzero(is_in & (~after | first[:-1]))
    ends = np.flatnonzero(is_in & (np.concatenate([~is_in[1:], [True]]) | first[1:])) + 1
    sums, down = prefix_hashes(LOWER[data] if fold else data)
    of_row = np.searchsorted(starts, texts.bounds)
    return Words(starts, ends, np.repeat(np.arange(rows), np.diff(of_row)), span_hashes(sums, down, starts, ends), of_row)


def pieces(texts: Texts, inside: np.ndarray, limit: int = 2 * SLICE_BYTES) -> Iterator[Texts]:
    """A text that is a slice of its own in pieces of about `limit` bytes, cut where no word is; other slices as they are. A longer word isn't cut."""
    data, n = texts.data, len(texts.data)
    if len(texts) != 1 or n <= limit:
        yield texts
        return
    at = 0
    while at < n:
        end, look = min(n, at + limit), 1 << 12
        while end < n and inside[data[end]]:
            stop = np.flatnonzero(~inside[data[end : end + look]])
            end = end + int(stop[0]) if len(stop) else min(n, end + look)
        yield Texts(texts.first, data[at:end], np.array([0, end - at]))
        at = end


_Q = U64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place; shorter by n - 1 (empty if there are fewer)."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=U64)
    factor = 1
    for k in range(n):
        out += hashes[k : k + size] * U64(factor)
        factor = factor * int(_Q) % (1 << 64)
    return mix(out + U64(n))


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each window; shorter by width - 1."""
    f = np.minimum if least else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """True where a value is the least of one of the windows of `width` values it is in. Each window has such a place."""
    if len(hashes) < width:
        return np.ones(len(hashes), dtype=bool)
    least = sliding(hashes, width, True)
    padded = np.concatenate([np.zeros(width - 1, dtype=U64), least, np.zeros(width - 1, dtype=U64)])
    return sliding(padded, width, False) == hashes


def found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 where it isn't."""
    if not len(table) or not len(values):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)
