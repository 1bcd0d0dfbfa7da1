"""64-bit cells on a Hilbert curve over the faces of a cube.

A cell's id holds three bits of face, two bits a level of the place along the
curve, a one and zeros: so a cell's descendants are a range of ids around its
own. Ids are signed longs here; within a face their order is the curve's.
Encoding and decoding are numpy in Arrow batches, all else is bit operations.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celestrum.functions.coords import column

MAX_LEVEL = 30
# Fixed values of the curve: place along it for each orientation and (i, j) bits, and how each place turns what is inside.
PLACE = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
TURN = np.array([1, 0, 0, 3])


def _square(u: np.ndarray) -> np.ndarray:
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def _unsquare(s: np.ndarray) -> np.ndarray:
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Leaf ids of unit vectors."""
    v = np.stack([x, y, z])
    axis = np.abs(v).argmax(axis=0)
    face = axis + 3 * (np.take_along_axis(v, axis[None, :], 0)[0] < 0)
    u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z], mode="clip")
    w = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z], mode="clip")
    size = 1 << MAX_LEVEL
    i, j = (np.clip(np.floor(_square(t) * size), 0, size - 1).astype(np.int64) for t in (u, w))
    turn, place = face & 1, np.zeros(len(x), dtype=np.uint64)
    for k in range(MAX_LEVEL - 1, -1, -1):
        p = PLACE[turn, ((i >> k) & 1) << 1 | (j >> k) & 1]
        place = (place << np.uint64(2)) | p.astype(np.uint64)
        turn = turn ^ TURN[p]
    return ((face.astype(np.uint64) << np.uint64(61)) | (place << np.uint64(1)) | np.uint64(1)).view(np.int64)


def decode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of cells' centres."""
    raw = ids.view(np.uint64)
    face = (raw >> np.uint64(61)).astype(np.int64)
    low = raw & (~raw + np.uint64(1))
    level = (60 - np.round(np.log2(low.astype(np.float64))).astype(np.int64)) // 2
    turn, i, j = face & 1, np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    bits_of = np.argsort(PLACE, axis=1)
    for k in range(MAX_LEVEL):
        p = ((raw >> np.uint64(2 * (MAX_LEVEL - 1 - k) + 1)) & np.uint64(3)).astype(np.int64)
        inside = k < level
        bits = bits_of[turn, p]
        i, j = np.where(inside, i << 1 | bits >> 1, i), np.where(inside, j << 1 | bits & 1, j)
        turn = np.where(inside, turn ^ TURN[p], turn)
    n = np.exp2(level)
    u, w = _unsquare((i + 0.5) / n), _unsquare((j + 0.5) / n)
    one = np.ones(len(ids))
    x = np.choose(face, [one, -u, -u, -one, w, w], mode="clip")
    y = np.choose(face, [u, one, -w, -w, -one, u], mode="clip")
    z = np.choose(face, [w, w, one, -u, -u, -one], mode="clip")
    size = np.sqrt(x * x + y * y + z * z)
    return x / size, y / size, z / size


def corners(ids: np.ndarray) -> np.ndarray:
    """Unit vectors of cells' corners, in turn around them: cells x 4 x 3."""
    raw = ids.view(np.uint64)
    face = (raw >> np.uint64(61)).astype(np.int64)
    level = (60 - np.round(np.log2((raw & (~raw + np.uint64(1))).astype(np.float64))).astype(np.int64)) // 2
    x, y, z = decode(ids)
    u, w = (np.choose(face, c, mode="clip") for c in ([y / x, -x / y, -x / z, z / x, z / y, -y / z], [z / x, z / y, -y / z, y / x, -x / y, -x / z]))
    n, out = np.exp2(level), []
    i, j = np.floor(_square(u) * n), np.floor(_square(w) * n)
    one = np.ones(len(ids))
    for di, dj in ((0, 0), (1, 0), (1, 1), (0, 1)):
        a, b = _unsquare((i + di) / n), _unsquare((j + dj) / n)
        v = np.stack([np.choose(face, c, mode="clip") for c in ([one, -a, -a, -one, b, b], [a, one, -b, -b, -one, a], [b, b, one, -a, -a, -one])], axis=1)
        out.append(v / np.linalg.norm(v, axis=1, keepdims=True))
    return np.stack(out, axis=1)


@F.pandas_udf(T.DoubleType())
def exact_area(ids: pd.Series) -> pd.Series:
    """Steradians of cells, as two triangles each."""
    with np.errstate(divide="ignore", invalid="ignore"):
        c = corners(ids.to_numpy(np.int64))

    def triangle(p, q, s):
        dots = (p * q).sum(axis=1) + (q * s).sum(axis=1) + (s * p).sum(axis=1)
        return 2 * np.arctan2(np.abs((np.cross(p, q) * s).sum(axis=1)), 1 + dots)

    return pd.Series(triangle(c[:, 0], c[:, 1], c[:, 2]) + triangle(c[:, 0], c[:, 2], c[:, 3]))


@F.pandas_udf(T.LongType())
def leaf_id(ra: pd.Series, dec: pd.Series) -> pd.Series:
    """Leaf cell of (longitude, latitude) in degrees."""
    a, d = np.radians(ra.to_numpy(float)), np.radians(dec.to_numpy(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        return pd.Series(encode(np.cos(a) * np.cos(d), np.sin(a) * np.cos(d), np.sin(d)))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"]))
def center(ids: pd.Series) -> pd.DataFrame:
    x, y, z = decode(ids.to_numpy(np.int64))
    return pd.DataFrame({"x": x, "y": y, "z": z})


def _bit(level: int) -> int:
    return 1 << (2 * (MAX_LEVEL - level))


def parent(cell, level: int) -> Column:
    low = _bit(level)
    return column(cell).bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(low))


def lowest_bit(cell) -> Column:
    return column(cell).bitwiseAND(-column(cell))


def level_of(cell) -> Column:
    return (MAX_LEVEL - F.round(F.log2(lowest_bit(cell).cast("double")) / 2)).cast("int")


def range_min(cell) -> Column:
    return column(cell) - (lowest_bit(cell) - 1)


def range_max(cell) -> Column:
    return column(cell) + (lowest_bit(cell) - 1)


def contains(cell, other) -> Column:
    return column(other).between(range_min(cell), range_max(cell))


def children(cell) -> Column:
    """Array of the four children; of a leaf, empty."""
    quarter = F.shiftright(lowest_bit(cell), 2)
    four = F.array(*[column(cell) + k * quarter for k in (-3, -1, 1, 3)])
    return F.when(lowest_bit(cell) > 1, four).otherwise(F.array().cast("array<bigint>"))


def token(cell) -> Column:
    return F.regexp_replace(F.lower(F.lpad(F.hex(column(cell)), 16, "0")), "0+$", "")


def from_token(text) -> Column:
    """The id of a token: its two halves of eight digits, since a whole one may be above the largest long."""
    whole = F.rpad(column(text) if not isinstance(text, str) else F.col(text), 16, "0")
    high, low = F.conv(F.substring(whole, 1, 8), 16, 10).cast("long"), F.conv(F.substring(whole, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def size(cell) -> Column:
    """In leaf cells."""
    return lowest_bit(cell)


def next_cell(cell) -> Column:
    """The next cell of the same level along the curve."""
    return column(cell) + 2 * lowest_bit(cell)


def siblings(cell) -> Column:
    """Array of the parent's four children, this one among them; empty for a face."""
    up = column(cell).bitwiseAND(-(4 * lowest_bit(cell))).bitwiseOR(4 * lowest_bit(cell))
    four = F.array(*[up + k * lowest_bit(cell) for k in (-3, -1, 1, 3)])
    return F.when(level_of(cell) > 0, four).otherwise(F.array().cast("array<bigint>"))


def average_area(level) -> Column:
    """Square degrees."""
    return F.lit(4.0 * math.pi * (180.0 / math.pi) ** 2 / 6.0) / F.pow(F.lit(4.0), column(level))


def curve_order(cell) -> list[Column]:
    """Along the curve over all faces: ids as unsigned numbers."""
    return [F.shiftrightunsigned(column(cell), 61), column(cell)]


def ancestors(cells: DataFrame, own: bool = True, name: str = "up") -> DataFrame:
    """A row for each cell that holds the row's cell, itself included unless own is false."""
    last = level_of("cell") if own else level_of("cell") - 1
    bits = F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda k: F.pow(F.lit(4.0), F.lit(MAX_LEVEL) - k).cast("bigint"))
    return cells.withColumn("_bit", F.explode(bits)).withColumn(name, F.col("cell").bitwiseAND(-F.col("_bit")).bitwiseOR(F.col("_bit"))).drop("_bit")


def normalize(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Distinct cells of which none lies in another, four siblings made their parent, as often as there are four.

    Of every cell that holds some the leaves held are summed, and a cell becomes the coarsest that is full: three shuffles whatever the levels.
    """
    some = cells.select(F.col(cell).alias("cell")).distinct()
    inside = ancestors(some, own=False).join(some.select(F.col("cell").alias("up")), "up", "left_semi").select("cell").distinct()
    up = ancestors(some.join(inside, "cell", "left_anti"))
    full = up.groupBy("up").agg(F.sum(size("cell")).alias("_held")).where(F.col("_held") == size("up")).select("up")
    return up.join(full, "up").groupBy("cell").agg(F.max_by("up", size("up")).alias("up")).select(F.col("up").alias("cell")).distinct()


def denormalize(cells: DataFrame, level: int) -> DataFrame:
    """Cells coarser than the level divided down to it; finer ones stay."""
    step = 2 * _bit(level)
    parts = F.when(level_of("cell") < level, F.sequence(range_min("cell") + (_bit(level) - 1), range_max("cell") - (_bit(level) - 1), F.lit(step))).otherwise(F.array("cell"))
    return cells.select(F.explode(parts).alias("cell"))


def random_leaf(cell, seed: int, *key) -> Column:
    """A leaf cell of the cell, all as likely, by a hash of the key."""
    share = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return range_min(cell) + 2 * F.floor(share * size(cell).cast("double")).cast("bigint")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalize(a.select("cell").unionByName(b.select("cell")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smaller of each two cells of which one holds the other."""
    in_b = ancestors(a.select("cell")).join(b.select(F.col("cell").alias("up")), "up", "left_semi").select("cell")
    in_a = ancestors(b.select("cell")).join(a.select(F.col("cell").alias("up")), "up", "left_semi").select("cell")
    return normalize(in_b.unionByName(in_a))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What of a is not in b: cells of a that b covers in part become the children, clear of b, of the cells in them that hold some of b."""
    a, b = a.select("cell").distinct(), b.select("cell").distinct()
    inside = ancestors(a).join(b.select(F.col("cell").alias("up")), "up", "left_semi").select("cell").distinct()
    left = a.join(inside, "cell", "left_anti")
    holders = ancestors(b, own=False).select(F.col("up").alias("cell")).distinct()
    touched = holders.unionByName(b).distinct()
    parts = ancestors(holders).join(left.select(F.col("cell").alias("up")), "up", "left_semi").select("cell").distinct()
    pieces = parts.select(F.explode(children("cell")).alias("cell")).join(touched, "cell", "left_anti")
    return normalize(left.join(holders, "cell", "left_anti").unionByName(pieces))


def status(some: DataFrame, cells: DataFrame) -> DataFrame:
    """some's cells and status: 1 if a normalized union holds the cell, -1 if it has part of it, 0 if none; share: the part it has."""
    some = some.select("cell").distinct()
    whole = ancestors(some).join(cells.select(F.col("cell").alias("up")), "up", "left_semi").select("cell").distinct().withColumn("_whole", F.lit(1.0))
    part = ancestors(cells.select("cell"), own=False).join(some.select(F.col("cell").alias("up")), "up", "left_semi").groupBy(F.col("up").alias("cell")).agg((F.sum(size("cell")) / F.first(size("up"))).alias("_part"))
    out = some.join(whole, "cell", "left").join(part, "cell", "left").withColumn("share", F.coalesce("_whole", "_part", F.lit(0.0)))
    return out.select("cell", "share", F.when(F.col("_whole").isNotNull() | (F.col("share") >= 1.0), 1).when(F.col("share") > 0, -1).otherwise(0).alias("status"))


def soften(cells: DataFrame, level: int, share: float = 0.5) -> DataFrame:
    """No cell finer than level: finer ones become their ancestor there if it is held to that share, else go."""
    fine = cells.select("cell").where(level_of("cell") > level)
    up = fine.groupBy(parent("cell", level).alias("up")).agg(F.sum(size("cell")).alias("_held")).where(F.col("_held") >= share * size("up"))
    return normalize(cells.select("cell").where(level_of("cell") <= level).unionByName(up.select(F.col("up").alias("cell"))))


def regions(cells: DataFrame, n_regions: int) -> DataFrame:
    """cell, region: cells along the curve in n runs of near-equal size, each closed when half of the next cell would pass its share.

    Running sums are over cells of level 6 (at most 24,576) and within each of them.
    """
    some = cells.select("cell").distinct().withColumn("_size", size("cell").cast("double"))
    coarse = F.when(level_of("cell") > 6, parent("cell", 6)).otherwise(F.col("cell"))
    some = some.withColumn("_up", coarse)
    ups = some.groupBy("_up").agg(F.sum("_size").alias("_sum"))
    total = ups.agg(F.sum("_sum")).first()[0] or 1.0
    upto = Window.orderBy(*curve_order("_up")).rowsBetween(Window.unboundedPreceding, -1)
    ups = ups.withColumn("_start", F.coalesce(F.sum("_sum").over(upto), F.lit(0.0))).drop("_sum")
    within = Window.partitionBy("_up").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = some.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0.0))).join(ups, "_up")
    middle = F.col("_start") + F.col("_before") + F.col("_size") / 2
    return placed.select("cell", F.least(F.lit(n_regions - 1), F.floor(middle / (total / n_regions))).cast("int").alias("region"))


def locate(points: DataFrame, cells: DataFrame, leaf: str = "leaf", levels: range | None = None) -> DataFrame:
    """points in one of the cells (column cell): an equi-join on ancestors of the levels that occur."""
    some = cells.select("cell").distinct()
    levels = levels or [r[0] for r in some.select(level_of("cell").alias("l")).distinct().collect()]  # at most 31
    ups = F.array(*[parent(leaf, k) for k in levels]) if len(levels) else F.array().cast("array<bigint>")
    return points.withColumn("cell", F.explode(ups)).join(some, "cell")


def covering(axis: tuple[float, float, float], radius_deg: float, level: int) -> np.ndarray:
    """Ids of the cells of one level that may touch a circle: from the faces down, cells farther than the circle and their own size are left out."""
    at = np.array(axis) / math.sqrt(sum(v * v for v in axis))
    ids = np.array([(f << 61) | (1 << 60) for f in range(6)], dtype=np.uint64).view(np.int64)
    for k in range(level + 1):
        if k:
            quarter = np.int64(_bit(k))
            ids = (ids[:, None] + np.array([-3, -1, 1, 3], dtype=np.int64)[None, :] * quarter).ravel()
        x, y, z = decode(ids)
        angle = np.arccos(np.clip(x * at[0] + y * at[1] + z * at[2], -1, 1))
        ids = ids[angle <= math.radians(radius_deg) + min(math.pi, 2.5 / 2**k)]
    return np.sort(ids)


def coverer(axis: tuple[float, float, float], radius_deg: float, most: int, finest: int = MAX_LEVEL, interior: bool = False) -> np.ndarray:
    """Ids of at most `most` cells (six at least) of several levels that hold a circle, or with interior lie in it.

    The coarsest cell that the circle cuts is divided as long as the cells stay within `most`; that many cells is all the driver holds.
    """
    at = np.array(axis) / math.sqrt(sum(v * v for v in axis))
    far = math.radians(radius_deg)

    def judge(ids: np.ndarray, level: int) -> np.ndarray:
        """2: in the circle, 1: may be cut by it, 0: outside."""
        x, y, z = decode(ids)
        angle, reach = np.arccos(np.clip(x * at[0] + y * at[1] + z * at[2], -1, 1)), min(math.pi, 2.5 / 2**level)
        return np.where(angle + reach <= far, 2, np.where(angle <= far + reach, 1, 0))

    def of(ids: np.ndarray, level: int) -> list[tuple[int, int, int]]:
        return [(level, int(c), int(j)) for c, j in zip(ids, judge(ids, level), strict=True) if j]

    faces = np.array([(f << 61) | (1 << 60) for f in range(6)], dtype=np.uint64).view(np.int64)
    done, todo = [], deque()
    for one in of(faces, 0):
        (done if one[2] == 2 else todo).append(one)
    while todo and todo[0][0] < finest:
        level, cell, _ = todo.popleft()
        parts = of(np.array([cell + k * _bit(level + 1) for k in (-3, -1, 1, 3)], dtype=np.int64), level + 1)
        inside, cut_ = [p for p in parts if p[2] == 2], [p for p in parts if p[2] == 1]
        if len(done) + len(inside) + (0 if interior else len(todo) + len(cut_)) > most or len(todo) + len(cut_) > 4 * most + 24:
            todo.appendleft((level, cell, 1))
            break
        done += inside
        todo.extend(cut_)
    return np.sort(np.array([c for _, c, _ in (done if interior else [*done, *todo])], dtype=np.int64))
