"""Counts and searches of two catalogs by blocks of points.

A block is a tile of the sky with its points in the order of a tree (see trees),
so it is a few arrays in a row. There are about a hundred tiles, more where they'd
get large, and a tile with very many points is several blocks. Blocks meet by an
equi-join on cells; each block of the larger catalog gets the blocks of the other
that it can have pairs with, a part of them at a time. So what is shuffled grows as
the catalogs do, a task holds some blocks, and what it works through are the pairs
near the edges of bins: the others are counted by the totals of tree nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from celestrum.functions import cells
from celestrum.operators import trees
from celestrum.operators.points import candidates, resolution_for
from celestrum.sources import scratch

#: Points that a block has on average, and at most; tiles, unless their blocks would be too large.
POINTS, MOST = 1 << 14, 1 << 18
TILES = 128
#: Bytes of a point in a block, without what its own columns take, and of blocks that a task gets at once.
BYTES, AT_ONCE = 32, 64 << 20

BLOCK = "block long, n long, cx double, cy double, cz double, radius double, widest double, v binary, many binary, weight binary, own binary, regions array<int>, sizes array<int>, payload binary"


def _pack(table: pa.Table, payload: list[str], scale: float) -> pa.Table:
    columns = {c: table.column(c).to_numpy() for c in ("ux", "uy", "uz", "weight", "region", "many", *(["own"] if scale else []))}
    v = np.stack([columns[c] for c in ("ux", "uy", "uz")], axis=1)
    many, weight, region = columns["many"].astype(np.int64), columns["weight"], columns["region"]
    # A fourth axis: the largest angle of each point.
    wide = np.minimum(np.radians(scale * columns["own"]), math.pi) if scale else np.zeros(len(v))
    by = np.argsort(region, kind="stable")
    names, first = np.unique(region[by], return_index=True)
    sizes = np.diff(np.r_[first, len(by)])
    at = np.concatenate([v, wide[:, None]], axis=1)[by]
    by = np.concatenate([by[k : k + n][trees.order(at[k : k + n])] for k, n in zip(first, sizes, strict=True)])
    middle = v.sum(axis=0)
    size = math.sqrt(float(middle @ middle))
    middle = middle / size if size > 1e-9 else v[0]
    radius = math.degrees(float(trees.angle(v, middle).max())) + 1e-7
    one = lambda x, kind: pa.array([x], type=kind)
    raw = lambda x, kind, given: one(np.ascontiguousarray(x[by], dtype=kind).tobytes() if given else None, pa.binary())
    sink = pa.BufferOutputStream()
    if payload:
        with pa.ipc.new_stream(sink, table.select(payload).schema) as out:
            out.write_table(table.select(payload).take(pa.array(by)).combine_chunks())
    return pa.table(
        {
            "block": one(table.column("block")[0].as_py(), pa.int64()), "n": one(len(v), pa.int64()), **{f"c{c}": one(float(x), pa.float64()) for c, x in zip("xyz", middle, strict=True)},
            "radius": one(radius, pa.float64()), "widest": one(math.degrees(float(wide.max())), pa.float64()), "v": raw(v, np.float64, True), "many": raw(many, np.int64, (many != 1).any()),
            "weight": raw(weight, np.float64, (weight != 1.0).any()), "own": raw(columns["own"] if scale else v[:, 0], np.float64, bool(scale)), "regions": one(names.astype(np.int32), pa.list_(pa.int32())), "sizes": one(sizes.astype(np.int32), pa.list_(pa.int32())),
            "payload": one(sink.getvalue().to_pybytes() if payload else None, pa.binary()),
        }
    )


def blocked(points: DataFrame, wanted: int = POINTS, most: int = MOST, *, payload: tuple[str, ...] = (), scale: float = 0.0) -> DataFrame:
    """A row for each block of a catalog with ux, uy, uz, weight and region (an integer, or -1).

    payload: columns that are kept with each point. scale: points have a column own,
    and angles of at most `scale` times its degrees. Without a payload, equal points of
    tiles with many are one with a multiplicity.
    """
    kept = ["ux", "uy", "uz", "weight", "region", *(["own"] if scale else [])]
    names = [f"_p{k}" for k in range(len(payload))]
    points = points.where(~(F.isnan("ux") | F.isnan("uy") | F.isnan("uz"))).select(*kept, *[F.col(c).alias(n) for c, n in zip(payload, names, strict=True)])
    points = points.withColumns({"weight": F.col("weight").cast("double"), "region": F.col("region").cast("int")})
    at = cells.with_cell(points, 1 << cells.MIN_LEVEL, ("_x", "_y"))
    # 7,488 rows at most.
    held = [(r["_x"], r["_y"], r["count"]) for r in at.groupBy("_x", "_y").count().collect()]
    n = sum(c for *_, c in held)
    tiles = min(n / wanted, max(TILES, 2 * n / most))
    up = max(0, min(6, round(math.log2(math.sqrt(cells.SUPERPIXELS / max(1.0, tiles))))))
    counts: dict[int, int] = {}
    for x, y, c in held:
        tile = (y >> up) * cells.NX0 * cells.SUPER_RES + (x >> up)
        counts[tile] = counts.get(tile, 0) + c
    at = at.withColumn("_tile", F.shiftright("_y", up) * (cells.NX0 * cells.SUPER_RES) + F.shiftright("_x", up)).drop("_x", "_y")
    large = [(tile, -(-c // most)) for tile, c in counts.items() if c > most]
    own = [c for c in at.columns if c != "_tile"]
    if large:
        at = at.withColumn("many", F.lit(1).cast("long")) if payload else at.groupBy("_tile", *own).agg(F.count("*").alias("many"))
        parts = F.broadcast(points.sparkSession.createDataFrame(large, "_tile long, _parts long"))
        at = at.join(parts, "_tile", "left").withColumn("block", F.col("_tile") * (1 << 20) + F.pmod(F.xxhash64(*own), F.coalesce("_parts", F.lit(1))))
    else:
        at = at.withColumns({"many": F.lit(1).cast("long"), "block": F.col("_tile") * (1 << 20)})
    # As many partitions as there are to be: the work isn't in proportion to bytes.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = at.select("block", "many", *own).repartition(n, "block").groupBy("block").applyInArrow(lambda t: _pack(t, names, scale), BLOCK)
    return scratch.written(packed, "blocks")


def _opened(table: pa.Table) -> Iterator[dict]:
    """Rows of blocks as arrays, and their trees by region."""
    for k in range(len(table)):
        row = {c: table.column(c)[k] for c in ("v", "many", "weight", "own", "payload")}
        read = lambda c, kind, row=row: None if not row[c].is_valid else np.frombuffer(row[c].as_buffer(), dtype=kind)
        v, many, weight = read("v", np.float64).reshape(-1, 3), read("many", np.int64), read("weight", np.float64)
        some, begin = [], 0
        for region, size in zip(table.column("regions")[k].as_py(), table.column("sizes")[k].as_py(), strict=True):
            part = slice(begin, begin + size)
            some.append((region, part, trees.Tree(v[part], None if many is None else many[part], None if weight is None else weight[part])))
            begin += size
        rows = pa.ipc.open_stream(row["payload"].as_buffer()).read_all() if row["payload"].is_valid else None
        yield {"block": table.column("block")[k].as_py(), "n": len(v), "own": read("own", np.float64), "trees": some, "payload": rows}


def _bounds(own: np.ndarray | None, part: slice, n: int, edge: float):
    """Of an edge, in degrees or in units of the points' own angle."""
    theta = np.full(n, math.radians(edge)) if own is None else np.radians(np.where(own[part] == np.inf, 180.0 if edge > 0 else 0.0, np.minimum(own[part], 1e6) * edge))
    return trees.cosines(theta)


def _within(one: dict, two: dict, edges: list[float], weighted: bool):
    """For trees of two blocks: region and tree of one, its part, region of the other, and for each edge the counts and weights within, None where that is nothing."""
    for region, part, a in one["trees"]:
        bounds = [None if k == 0 and e <= 0 else _bounds(one["own"], part, len(a.v), e) for k, e in enumerate(edges)]
        for other, _, b in two["trees"]:
            need = weighted and not (a.weight is None and b.weight is None)
            yield region, part, a, other, [(0.0, 0.0) if at is None else trees.within(a, b, *at, need) for at in bounds], need


def _binned(left: pa.Table, right: pa.Table, edges: list[float], same: bool) -> pa.Table:
    """Sums by bin and regions of blocks with blocks. same: of one catalog with itself; two blocks meet once and count both ways."""
    found: dict[tuple[int, int, int], list] = {}

    def add(key, n, w):
        sums = found.setdefault(key, [0, 0.0])
        sums[0] += n
        sums[1] += w

    two = list(_opened(right))
    for one in _opened(left):
        for other in two:
            for region, _, a, region_b, sums, weighed in _within(one, other, edges, True):
                for k, ((n0, w0), (n1, w1)) in enumerate(zip(sums, sums[1:], strict=False)):
                    n = n1 - n0
                    count = int(round(float(n.sum() if a.many is None else n @ a.many)))
                    if count:
                        weight = float((w1 - w0) @ a.own) if weighed else float(count)
                        add((k, region, region_b), count, weight)
                        if same and one["block"] != other["block"]:
                            add((k, region_b, region), count, weight)
    keys, sums = (list(zip(*x, strict=True)) if found else [[]] * 3 for x in (found, found.values()))
    return pa.table({n: pa.array(v, type=t) for n, v, t in zip(("bin", "region_a", "region_b", "n_pairs", "weight"), (*keys[:3], *sums[:2]), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)})


def _met(left: DataFrame, right: DataFrame, reach: Column, least: float, f: Callable, schema, once: bool = False, copied: int = BYTES) -> DataFrame:
    """f of blocks of left and of right (columns of blocks): every two that may have pairs at angles from `least` to `reach` degrees, a column of left, meet in one call.

    The catalog with fewer points is copied to the blocks of the other. once: left is right, and two blocks meet once.
    """
    spark = left.sparkSession
    a, b = (df.agg(F.sum("n"), F.max("radius"), F.max(reach) if k == 0 else F.lit(0.0)).first() for k, df in enumerate((left, right)))
    farthest = min(180.0, (a[2] or 0.0) + (a[1] or 0.0) + (b[1] or 0.0) + 1e-3)
    probes = left.select(F.col("block").alias("a"), F.col("radius").alias("_ra"), reach.alias("_to"), F.col("cx").alias("ux"), F.col("cy").alias("uy"), F.col("cz").alias("uz"))
    targets = right.select(F.col("block").alias("b"), F.col("radius").alias("_rb"), F.col("cx").alias("ux"), F.col("cy").alias("uy"), F.col("cz").alias("uz"))
    probes = probes.withColumn("_reach", F.least(F.lit(180.0), F.col("_to") + F.col("_ra") + (b[1] or 0.0) + 1e-3))
    near = candidates(probes, targets, F.col("_reach"), resolution_for(farthest))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_dot")))))
    near = near.where((angle - F.col("_ra") - F.col("_rb") - 1e-5 <= F.col("_to")) & (angle + F.col("_ra") + F.col("_rb") + 1e-5 >= least))
    if once:
        # Either way round, by a hash: no block has all its pairs on one side.
        turned = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(2)) == 0
        near = near.where((F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == turned))
    moves = "a" if (a[0] or 0) <= (b[0] or 0) else "b"
    stays = "b" if moves == "a" else "a"
    share = (1.0 - math.cos(math.radians(farthest))) / 2.0
    parts = max(1, math.ceil((a if moves == "a" else b)[0] * copied * share / AT_ONCE)) if a[0] and b[0] else 1
    met = scratch.written(near.select("a", "b", (F.col(stays) * parts + F.pmod(F.xxhash64(moves), F.lit(parts))).alias("_group")), "near")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sent(df: DataFrame, side: str) -> DataFrame:
        # New names, as both sides may be one table.
        df, to = df.toDF(*df.columns), met.select(F.col(side).alias("_at"), F.col("_group").alias(f"_group_{side}"))
        # As many partitions as there are to be: work isn't in proportion to bytes.
        return df.join(to if side == moves else to.distinct(), F.col("block") == F.col("_at")).drop("_at").repartition(n, f"_group_{side}").groupBy(f"_group_{side}")

    return sent(left, "a").cogroup(sent(right, "b")).applyInArrow(f, schema)


def _side(df: DataFrame, regions: bool) -> DataFrame:
    region = F.coalesce(F.col("region").cast("int"), F.lit(-1)) if regions else F.lit(-1)
    more = ["own"] if "own" in df.columns else []
    return df.select("ux", "uy", "uz", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), region.alias("region"), *more).dropna(subset=["ux", "uy", "uz", *more])


def of_catalog(df: DataFrame, regions: bool = False, scale: float = 0.0) -> DataFrame:
    """Blocks for pairs_of_blocks. Null positions pair with nothing; null weights and regions are 0 and -1."""
    return blocked(_side(df, regions), scale=scale)


def binned_pairs(a: DataFrame, b: DataFrame, edges: list[float], regions: bool = False) -> DataFrame:
    """bin, n_pairs, weight (sum of products of weights) [, region_a, region_b] for the bins [edges[k], edges[k + 1]).

    Catalogs have ux, uy, uz, weight [, region]. Null positions pair with nothing; null weights and regions are 0 and -1.
    """
    left = of_catalog(a, regions)
    right = left if b is a else of_catalog(b, regions)
    out = pairs_of_blocks(left, right, edges)
    by = ["bin", "region_a", "region_b"] if regions else ["bin"]
    return out.groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("weight").alias("weight"))


def pairs_of_blocks(left: DataFrame, right: DataFrame, edges: list[float], own: bool = False) -> DataFrame:
    """bin, region_a, region_b, n_pairs, weight, in parts to be summed. own: edges are in units of the left points' own angle."""
    reach, same = F.col("widest") if own else F.lit(float(edges[-1])), left is right and not own
    return _met(left, right, reach, 0.0 if own else edges[0], lambda x, y: _binned(x, y, edges, same), "bin int, region_a int, region_b int, n_pairs long, weight double", once=same)


def of_points(df: DataFrame, by: list[str], scale: float = 0.0) -> DataFrame:
    """Blocks for counted and nearest: a catalog with ux, uy, uz [, own], of whose points these columns are kept."""
    own = ["own"] if scale else []
    made = df.select("ux", "uy", "uz", F.lit(1.0).alias("weight"), F.lit(-1).alias("region"), *own, *[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)])
    return blocked(made.dropna(subset=["ux", "uy", "uz", *own]), payload=tuple(f"_k{k}" for k in range(len(by))), scale=scale)


def _counted(left: pa.Table, right: pa.Table, edges: list[float], weighted: bool, names: list[str]) -> pa.Table:
    """For points of left that have any: their columns, points of right and their weight."""
    out, two = [], list(_opened(right))
    for one in _opened(left):
        counts, weights = np.zeros(one["n"]), np.zeros(one["n"])
        for other in two:
            for _, part, _, _, ((n0, w0), (n1, w1)), weighed in _within(one, other, edges, weighted):
                counts[part] += n1 - n0
                weights[part] += (w1 - w0) if weighed else (n1 - n0)
        some = np.flatnonzero(counts)
        rows = one["payload"].take(pa.array(some)).rename_columns(names)
        out.append(rows.append_column("n_pairs", pa.array(counts[some].astype(np.int64))).append_column("weight", pa.array(weights[some])))
    return pa.concat_tables(out)


def counted(probes: DataFrame, targets: DataFrame, by: list[str], theta_max: float | None, theta_min: float = 0.0) -> DataFrame:
    """by, n_pairs, weight: for each probe that has any, the targets at angles in [theta_min, theta_max) and the sum of their weights.

    theta_max None: each probe has a column own, its angle in degrees. Targets have ux, uy, uz [, weight].
    """
    weighted, own = "weight" in targets.columns, theta_max is None
    left = of_points(probes, by, 1.0 if own else 0.0)
    right = of_catalog(targets if weighted else targets.withColumn("weight", F.lit(1.0)))
    edges, reach = ([0.0, 1.0], F.col("widest")) if own else ([theta_min, theta_max], F.lit(theta_max))
    schema = StructType(probes.select(*by).schema.fields).add("n_pairs", LongType()).add("weight", DoubleType())
    found = _met(left, right, reach, theta_min, lambda x, y: _counted(x, y, edges, weighted, by), schema, copied=BYTES + 16 * len(by))
    return found.groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("weight").alias("weight"))


def _nearest(left: pa.Table, right: pa.Table, k: int, theta: float, names: list[str]) -> pa.Table:
    """Points of left and their nearest ones of each block of right: columns and positions of both."""
    out, two = [], list(_opened(right))
    for one in _opened(left):
        for other in two:
            for _, part, a in one["trees"]:
                for _, part_b, b in other["trees"]:
                    i, j = trees.nearest(a, b, k, math.radians(theta))
                    columns = [*one["payload"].take(pa.array(i + part.start)).columns, *other["payload"].take(pa.array(j + part_b.start)).columns]
                    columns += [pa.array(x[:, c]) for x in (a.v[i], b.v[j]) for c in range(3)]
                    out.append(pa.table(columns, names=names))
    return pa.concat_tables(out)


def nearest(left: DataFrame, right: DataFrame, fields: StructType, k: int, theta: float) -> DataFrame:
    """For points of left its k nearest of each block of right within theta degrees (its end is in), and what may be as near.

    Blocks are those of of_points. fields: types of the columns that left and right keep. Positions: _px, _py, _pz and ux, uy, uz.
    """
    schema = StructType(list(fields.fields))
    for n in ("_px", "_py", "_pz", "ux", "uy", "uz"):
        schema = schema.add(n, DoubleType())
    names = schema.names
    return _met(left, right, F.lit(theta), 0.0, lambda x, y: _nearest(x, y, k, theta, names), schema, copied=BYTES + 16 * len(fields))
