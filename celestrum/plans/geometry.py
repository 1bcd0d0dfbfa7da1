"""Queries of spherical geometry, of fields on the Hilbert curve, of codings and of the theory layer, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.functions import bounds, cells, coding, coords, geodesy, hcells, text, theory
from celestrum.operators import area_map, correlation, hfield
from celestrum.plans import more
from celestrum.plans.fixtures import catalog_sql
from celestrum.plans.registry import CUSTOMER, ORDERS, PART, SUPPLIER, XYZ, _ab, customer, orders, part, query, r, rs, supplier
from celestrum.sources import scratch, text_io


def _three(spark, d) -> DataFrame:
    """Rows of customer, supplier and part with one key: a*, b*, c*."""
    df, a, b = _ab(spark, d)
    c = part(spark, d).select("k", *[F.col(n).alias(f"c{n}") for n in XYZ])
    return df.join(c, "k")


A, B, C = (tuple(f"{p}{n}" for n in XYZ) for p in "abc")
_ABC = f"(SELECT a.k, a.ux AS aux, a.uy AS auy, a.uz AS auz, b.ux AS bux, b.uy AS buy, b.uz AS buz, c.ux AS cux, c.uy AS cuy, c.uz AS cuz, a.weight AS aw, b.weight AS bw FROM {CUSTOMER} a JOIN {SUPPLIER} b ON a.k = b.k JOIN {PART} c ON a.k = c.k)"


def _v(p) -> list[str]:
    return [f"{p}ux", f"{p}uy", f"{p}uz"] if isinstance(p, str) else list(p)


def _x(p, q) -> list[str]:
    a, b = _v(p), _v(q)
    return [f"({a[(i + 1) % 3]} * {b[(i + 2) % 3]} - {a[(i + 2) % 3]} * {b[(i + 1) % 3]})" for i in range(3)]


def _d(p, q) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(_v(p), _v(q), strict=True)) + ")"


def _n(p) -> str:
    return "sqrt(" + " + ".join(f"{x} * {x}" for x in _v(p)) + ")"


def _arc(p, q) -> str:
    return f"atan2({_n(_x(p, q))}, {_d(p, q)})"


def _det(p, q, s) -> str:
    return _d(_x(p, q), s)


def _area(p, q, s) -> str:
    return f"(2e0 * atan2({_det(p, q, s)}, 1e0 + {_d(p, q)} + {_d(q, s)} + {_d(s, p)}))"


@query("m1_triangles", f"""SELECT k, CASE WHEN {_det('a', 'b', 'c')} > 1e-15 THEN 1 WHEN {_det('a', 'b', 'c')} < -1e-15 THEN -1 ELSE 0 END AS orientation, {rs(_area('a', 'b', 'c'))} AS area, {rs(_arc(_x('a', 'b'), _x('c', 'b')))} AS angle,
  {rs(f"CASE WHEN {_det('a', 'b', 'c')} >= 0 THEN 1e0 ELSE -1e0 END * {_arc(_x('a', 'b'), _x('b', 'c'))}")} AS turn, {rs("(aux + bux + cux) / 3e0")} AS cx FROM {_ABC}""")
def _(spark, d):
    return _three(spark, d).select("k", geodesy.orientation(A, B, C).alias("orientation"), r(geodesy.signed_area(A, B, C)).alias("area"), r(geodesy.angle_at(A, B, C)).alias("angle"), r(geodesy.turn_angle(A, B, C)).alias("turn"), r(geodesy.planar_centroid(A, B, C)[0]).alias("cx"))


def _cap(h: str) -> str:
    return f"(2e0 * asin(sqrt(least(1e0, 0.5e0 * {h}))))"


_H = "(SELECT *, 0.01e0 + abs(aw) / 10000e0 AS ha, 0.01e0 + abs(bw) / 20000e0 AS hb FROM " + _ABC + ")"


@query("m5_caps", f"""SELECT k, {rs(_cap('ha'))} AS radius, {rs('2e0 * pi() * ha')} AS area, {_cap('ha')} >= {_arc('a', 'b')} + {_cap('hb')} AS holds, {_cap('ha')} + {_cap('hb')} >= {_arc('a', 'b')} AS meets, 1e0 - {_d('a', 'c')} <= ha + 1e-15 AS inside,
  {rs(f"greatest(ha, 1e0 - {_d('a', 'c')})")} AS with_point, {rs(f"greatest(ha, 1e0 - cos(least(pi(), {_arc('a', 'b')} + {_cap('hb')})))")} AS with_cap, {rs("2e0 - ha")} AS rest FROM {_H}""")
def _(spark, d):
    df = _three(spark, d).join(customer(spark, d).select("k", (0.01 + F.abs("weight") / 10000.0).alias("ha")), "k").join(supplier(spark, d).select("k", (0.01 + F.abs("weight") / 20000.0).alias("hb")), "k")
    return df.select(
        "k", r(geodesy.cap_radius("ha")).alias("radius"), r(geodesy.cap_area("ha")).alias("area"), geodesy.cap_holds(A, "ha", B, "hb").alias("holds"), geodesy.caps_meet(A, "ha", B, "hb").alias("meets"), geodesy.cap_contains(A, "ha", C).alias("inside"),
        r(geodesy.cap_with_point(A, "ha", C)).alias("with_point"), r(geodesy.cap_with_cap(A, "ha", B, "hb")).alias("with_cap"), r(geodesy.cap_complement(A, "ha")[1]).alias("rest"),
    )


_BOXES = f"""(SELECT a.k, -10e0 - a.k % 30 AS alow, 5e0 + a.k % 40 AS ahigh, a.ra AS aw, (a.ra + 20e0 + a.k % 50) % 360e0 AS ae, -40e0 + a.k % 60 AS blow, 30e0 + a.k % 20 AS bhigh, b.ra AS bw, (b.ra + 60e0) % 360e0 AS be FROM {CUSTOMER} a JOIN {SUPPLIER} b ON a.k = b.k)"""
_MOD = lambda e: f"((({e}) % 360e0 + 360e0) % 360e0)"
_WA, _WB, _FA, _FB = _MOD("ae - aw"), _MOD("be - bw"), _MOD("bw - aw"), _MOD("aw - bw")


@query("m6_boxes", f"""SELECT k, {rs(f"radians({_WA}) * (sin(radians(ahigh)) - sin(radians(alow)))")} AS area, alow <= bhigh AND blow <= ahigh AND ({_FA} <= {_WA} OR {_FB} <= {_WB}) AS meets, alow <= blow AND ahigh >= bhigh AND {_FA} + {_WB} <= {_WA} AS holds,
  least(alow, blow) AS ulow, greatest(ahigh, bhigh) AS uhigh, {rs(f"least(360e0, least(greatest({_WA}, {_FA} + {_WB}), greatest({_WB}, {_FB} + {_WA})))")} AS uwidth, greatest(-90e0, alow - 3e0) AS glow, {rs(f"{_WA} + 4e0")} AS gwidth FROM {_BOXES}""")
def _(spark, d):
    df, _, _ = _ab(spark, d)
    k = F.col("k").cast("double")
    a = geodesy.box(-10.0 - k % 30, 5.0 + k % 40, "a_ra", (F.col("a_ra") + 20.0 + k % 50) % 360.0)
    b = geodesy.box(-40.0 + k % 60, 30.0 + k % 20, "b_ra", (F.col("b_ra") + 60.0) % 360.0)
    u, g = geodesy.box_union(a, b), geodesy.box_grown(a, 3.0, 2.0)
    return df.select("k", r(geodesy.box_area(a)).alias("area"), geodesy.boxes_meet(a, b).alias("meets"), geodesy.box_holds(a, b).alias("holds"), u["lat_min"].alias("ulow"), u["lat_max"].alias("uhigh"), r(geodesy.box_width(u)).alias("uwidth"), g["lat_min"].alias("glow"), r(geodesy.box_width(g)).alias("gwidth"))


def _arc_distance(p, a, b) -> str:
    n = _x(a, b)
    return f"(CASE WHEN {_det(n, a, p)} >= 0 AND {_det(b, n, p)} >= 0 THEN abs(asin(greatest(-1e0, least(1e0, {_d(p, n)} / {_n(n)})))) ELSE least({_arc(p, a)}, {_arc(p, b)}) END)"


def _crossing(a, b, c, d) -> str:
    sign = lambda *v: f"(CASE WHEN {_det(*v)} > 1e-15 THEN 1 WHEN {_det(*v)} < -1e-15 THEN -1 ELSE 0 END)"
    return f"({sign(a, b, c)} <> 0 AND {sign(c, d, a)} <> 0 AND {sign(a, b, c)} = -{sign(a, b, d)} AND {sign(c, d, a)} = -{sign(c, d, b)} AND {sign(a, b, c)} = -{sign(c, d, a)})"


_POLE = ["0.6e0", "0e0", "0.8e0"]
_LERP = f"(sin(0.75e0 * {_arc('a', 'b')}) / sin({_arc('a', 'b')}) * aux + sin(0.25e0 * {_arc('a', 'b')}) / sin({_arc('a', 'b')}) * bux)"


@query("m10_m11_lines", f"""SELECT k, {rs(f"{_arc('a', 'b')} + {_arc('b', 'c')}")} AS length, {rs(f"least({_arc_distance(_POLE, 'a', 'b')}, {_arc_distance(_POLE, 'b', 'c')})")} AS distance, {_crossing('a', 'b', 'c', _POLE)} AS crosses, {rs(_LERP)} AS quarter, {rs(_area('a', 'b', 'c') + ' + ' + _area('a', 'c', _POLE))} AS loop_area FROM {_ABC}""")
def _(spark, d):
    pole = tuple(F.lit(v) for v in (0.6, 0.0, 0.8))
    point = lambda v: F.struct(*[coords.column(c).alias(n) for c, n in zip(v, "xyz", strict=True)])
    line = F.array(point(A), point(B), point(C))
    loop = F.array(point(A), point(B), point(C), point(pole))
    df = _three(spark, d)
    return df.select("k", r(geodesy.line_length(line)).alias("length"), r(geodesy.line_distance(line, pole)).alias("distance"), geodesy.crosses(A, B, C, pole).alias("crosses"), r(geodesy.interpolate(A, B, F.lit(0.25))[0]).alias("quarter"), r(geodesy.loop_area(loop)).alias("loop_area"))


@query("a22_m7_stored_loops", f"SELECT k, 3::INTEGER AS n, {rs(_area('a', 'b', 'c'))} AS area FROM {_ABC}")
def _(spark, d):
    """Loops as arrays of positions in a table, and back."""
    point = lambda v: F.struct(*[F.col(c).alias(n) for c, n in zip(v, "xyz", strict=True)])
    stored = scratch.written(_three(spark, d).select("k", F.array(point(A), point(B), point(C)).alias("loop")), "loops")
    return stored.select("k", F.size("loop").alias("n"), r(geodesy.loop_area(F.col("loop"))).alias("area"))


@query("m12_composed_regions", f"SELECT k FROM {ORDERS} WHERE ({more.math.cos(0.7)!r} <= ux * cos(radians(105e0)) + uy * sin(radians(105e0)) AND degrees(asin(uz)) BETWEEN -10e0 AND 20e0) OR uz >= 0.9e0")
def _(spark, d):
    shape = (bounds.Circle(200, 0, more.math.degrees(0.7)) & bounds.LatitudeBand(-10, 20)) | Cone(0.9)
    return orders(spark, d).where(shape.contains()).select("k")


class Cone(bounds.Bound):
    """A region of one's own: what is north of a plane."""

    def __init__(self, least: float) -> None:
        self.least = least
        self.area = cells.SKY_DEG2 * (1.0 - least) / 2.0

    def contains(self, vector=XYZ):
        return coords.column(vector[2]) >= self.least


@query("n1_n3_own_region", f"SELECT count(*) AS n, true AS near FROM {ORDERS} WHERE uz >= 0.9e0")
def _(spark, d):
    """A subclass of Bound selects rows, and is pixelised like any other."""
    shape = Cone(0.9)
    area = area_map.pixelize(spark, shape, 5).agg(F.sum(cells.level_area(F.col("level"))).alias("area"))
    return orders(spark, d).where(shape.contains()).agg(F.count("*").alias("n")).crossJoin(area.select((F.abs(F.col("area") - shape.area) < 0.02 * shape.area).alias("near")))


# The Hilbert curve, step by step in SQL


def hilbert_sql(source: str, level: int) -> str:
    """k, weight, p: the place along the curve, over all faces, of each row's cell."""
    choose = lambda *e: "CASE face " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(e)) + " END"
    square = lambda t: f"CASE WHEN {t} >= 0 THEN 0.5e0 * sqrt(1e0 + 3e0 * abs({t})) ELSE 1e0 - 0.5e0 * sqrt(1e0 + 3e0 * abs({t})) END"
    cell = lambda t: f"greatest(0, least(1073741823, floor(({square(t)}) * 1073741824e0)))::BIGINT"
    place = "[" + ", ".join(str(row.tolist()) for row in hcells.PLACE) + "]"
    return f"""(WITH RECURSIVE v AS (SELECT k, weight, cos(radians(ra)) * sqrt(1e0 - uz * uz) AS x, sin(radians(ra)) * sqrt(1e0 - uz * uz) AS y, uz AS z FROM {source}),
      f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM v),
      g AS (SELECT *, {choose("y / x", "-x / y", "-x / z", "z / x", "z / y", "-y / z")} AS u, {choose("z / x", "z / y", "-y / z", "y / x", "-x / y", "-x / z")} AS w FROM f),
      walk(k, weight, face, i, j, turn, place, l) AS (SELECT k, weight, face, {cell("u")}, {cell("w")}, face & 1, 0::BIGINT, 0 FROM g
        UNION ALL SELECT k, weight, face, i, j, xor(turn, {hcells.TURN.tolist()}[q + 1]), place * 4 + q, l + 1
          FROM (SELECT *, {place}[turn + 1][(((i >> (29 - l)) & 1) * 2 + ((j >> (29 - l)) & 1) + 1)::INTEGER] AS q FROM walk WHERE l < {level}))
      SELECT k, weight, face::BIGINT * {4**level} + place AS p FROM walk WHERE l = {level})"""


def _place(cell, level: int):
    return F.shiftrightunsigned(cell, 61 - 2 * level)


def _leaves(spark, d) -> DataFrame:
    return orders(spark, d).select("k", "weight", hcells.leaf_id("ra", coords.declination()).alias("leaf"))


@query("l5_hilbert_places", f"SELECT k, p FROM {hilbert_sql(CUSTOMER, 12)}")
def _(spark, d):
    c = customer(spark, d).select("k", hcells.leaf_id("ra", coords.declination()).alias("leaf"))
    return c.select("k", _place(hcells.parent("leaf", 12), 12).alias("p"))


def _every(spark, level: int) -> DataFrame:
    return spark.range(6 * 4**level).select(F.col("id").alias("p"), F.shiftleft(2 * F.col("id") + 1, 60 - 2 * level).alias("cell"))


_H4 = f"(SELECT t.p, coalesce(i, 0e0) AS intensity, coalesce(n, 0) AS n_points FROM range({6 * 4**4}) t(p) LEFT JOIN (SELECT p, sum(weight) AS i, count(*) AS n FROM {hilbert_sql(ORDERS, 4)} GROUP BY p) USING (p) WHERE t.p % 5 < 3)"
_AREA4 = "(4e0 * pi() * pow(180e0 / pi(), 2) / 6e0 / 256e0)"


def _hfield(spark, d) -> DataFrame:
    return hfield.from_points(_leaves(spark, d), _every(spark, 4).where("p % 5 < 3"), 4, F.col("weight"))


@query("l17_l21_hilbert_field", f"SELECT p, {rs('intensity', 2)} AS intensity, n_points, {rs(f'n_points / {_AREA4}')} AS density FROM {_H4}")
def _(spark, d):
    f = hfield.densities(_hfield(spark, d), 4)
    return f.select(_place("cell", 4).alias("p"), r(F.col("intensity"), 2).alias("intensity"), "n_points", r(F.col("point_density")).alias("density"))


@query("l17_hilbert_resampled", f"SELECT p // 4 AS p, count(*) / 4e0 AS share, {rs('sum(intensity)', 2)} AS intensity, sum(n_points)::BIGINT AS n_points FROM {_H4} GROUP BY ALL")
def _(spark, d):
    f = hfield.resample(_hfield(spark, d), 4, 3)
    return f.select(_place("cell", 3).alias("p"), "share", r(F.col("intensity"), 2).alias("intensity"), "n_points")


@query("l17_hilbert_over_density", f"SELECT p, {rs('intensity / (sum(intensity) OVER () / count(*) OVER ()) - 1e0')} AS intensity FROM {_H4}")
def _(spark, d):
    return hfield.over_density(_hfield(spark, d)).select(_place("cell", 4).alias("p"), r(F.col("intensity")).alias("intensity"))


@query("l25_field_algebra", f"SELECT p, {rs('intensity * 0.5e0', 4)} AS intensity, 2 * n_points AS n_points FROM {_H4}")
def _(spark, d):
    f = scratch.written(_hfield(spark, d), "field")
    return hfield.combined(f, f, -0.5).select(_place("cell", 4).alias("p"), r(F.col("intensity"), 4).alias("intensity"), "n_points")


@query("l7_m3_exact_areas", "SELECT f::INTEGER AS face, 64::BIGINT AS n, round(4e0 * pi() / 6e0, 9) + 0e0 AS area, true AS uneven FROM range(6) t(f)")
def _(spark, d):
    c = _every(spark, 3).withColumn("area", hcells.exact_area("cell"))
    return c.groupBy(F.floor(F.col("p") / 64).cast("int").alias("face")).agg(F.count("*").alias("n"), r(F.sum("area"), 9).alias("area"), (F.max("area") < 2.1 * F.min("area")).alias("uneven"))


@query("l8_points_in_cells", "SELECT p, 20::BIGINT AS n, 20::BIGINT AS inside FROM range(96) t(p)")
def _(spark, d):
    draws = _every(spark, 2).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("leaf", hcells.random_leaf("cell", 5, "p", "i"))
    at = draws.withColumn("v", hcells.center("leaf"))
    lon, lat = F.degrees(F.atan2("v.y", "v.x")), F.degrees(F.asin(coords.clamp(F.col("v.z"))))
    back = at.withColumn("again", hcells.parent(hcells.leaf_id(lon, lat), 2))
    return back.groupBy("p").agg(F.count("*").alias("n"), F.count(F.when(hcells.contains("cell", "leaf") & (F.col("again") == F.col("cell")), 1)).alias("inside"))


@query("m4_denormalized", "SELECT p FROM range(128) t(p) WHERE p // 16 % 2 = 0 UNION ALL SELECT 1000 + p FROM range(64) t(p)")
def _(spark, d):
    """Cells of level 1 divided down to level 3; finer ones stay."""
    coarse = _every(spark, 1).where("p < 8 AND p % 2 = 0").select("cell")
    fine = _every(spark, 4).where("p < 64").select("cell")
    some = hcells.denormalize(coarse.unionByName(fine), 3)
    return some.select((F.when(hcells.level_of("cell") == 3, _place("cell", 3)).otherwise(1000 + _place("cell", 4))).alias("p"))


@query("a19_a20_points_and_cells", f"SELECT k, {rs('weight')} AS weight, p, {rs('weight')} AS stored FROM {hilbert_sql(CUSTOMER, 10)}")
def _(spark, d):
    """Points as `id weight` lines and as a table of structs, and back."""
    c = customer(spark, d).select("k", "weight", hcells.leaf_id("ra", coords.declination()).alias("leaf"))
    path = scratch.folder(spark, "text")
    text_io.write_ids(c.select(F.col("leaf").alias("id"), "weight", "k"), path, ("k",))
    lines = text_io.read_ids(spark, path, ("k",))
    stored = scratch.written(c.select(F.struct(F.col("leaf").alias("id"), "weight").alias("point"), "k"), "points").select("k", F.col("point.weight").alias("stored"))
    return lines.join(stored, "k").select("k", r(F.col("weight")).alias("weight"), _place(hcells.parent("id", 10), 10).alias("p"), r(F.col("stored")).alias("stored"))


# Codings, orders, theory


_VAR = """array_to_string(list_transform(list_filter(range(9), lambda j: j = 0 OR (k >> (7 * j)) > 0), lambda j: lpad(lower(hex(((k >> (7 * j)) & 127) + CASE WHEN (k >> (7 * (j + 1))) > 0 THEN 128 ELSE 0 END)), 2, '0')), '')"""


@query("m15_coding", f"SELECT k, {_VAR} AS varint, k AS back, 2 * k AS zig, CASE WHEN k = 0 THEN 0 ELSE 2 * k - 1 END AS zag, (k::HUGEINT * 9000000000000000000)::VARCHAR AS wide, left(md5(k::VARCHAR), 16) AS print FROM {ORDERS}")
def _(spark, d):
    o = orders(spark, d).select("k")
    return o.select("k", coding.varint_hex("k").alias("varint"), coding.from_varint_hex(coding.varint_hex("k")).alias("back"), coding.zigzag("k").alias("zig"), coding.zigzag(-F.col("k")).alias("zag"), coding.wide_product("k", F.lit(9000000000000000000)).cast("string").alias("wide"), coding.fingerprint(F.col("k").cast("string")).alias("print"))


@query("m13_m14_more_text", "SELECT event_id, string_split(event_type, 'e')[1] AS head, list_sort(list_distinct(list_filter(string_split_regex(event_type, '[ei]'), lambda x: x <> ''))) AS parts, event_id % 100 AS leading, printf('%.3f', event_id / 7e0) AS number FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    number = F.concat(F.lit(" "), (F.col("event_id") % 100).cast("string"), F.lit("x9"))
    return e.select("event_id", text.split_into("event_type", "e", 2)[0].alias("head"), text.split_distinct("event_type", "ei").alias("parts"), text.leading_int(number).alias("leading"), text.format_float(F.col("event_id") / 7.0, 3).alias("number"))


@query("h7_bin_order", "SELECT bin::INTEGER AS bin, row_number() OVER (ORDER BY resolution DESC, theta_min) AS by_resolution, row_number() OVER (ORDER BY theta_min) AS by_angle FROM (VALUES (0, 0, 0.1e0), (1, 64, 0.3e0), (2, 16, 1e0), (3, 16, 3e0)) t(bin, resolution, theta_min)")
def _(spark, d):
    from pyspark.sql import Window

    t = correlation.Bins((0.1, 0.3, 1.0, 3.0, 10.0), (0, 64, 16, 16)).table(spark)  # a row a bin
    rank = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("long")
    return t.select("bin", rank(*correlation.Bins.resolution_order()).alias("by_resolution"), rank(*correlation.Bins.angle_order()).alias("by_angle"))


def _simpson(f: str, high: str) -> str:
    """Of f(t) from 0 to high."""
    return f"(list_sum(list_transform(range(65), lambda j: (CASE WHEN j = 0 OR j = 64 THEN 1e0 WHEN j % 2 = 1 THEN 4e0 ELSE 2e0 END) * {f.replace('@', f'({high} * j / 64e0)')})) * {high} / 192e0)"


_E = lambda z: f"sqrt(0.3e0 * pow(1e0 + {z}, 3) + 0.7e0)"
_GROW = lambda a: f"(sqrt(0.3e0 / pow({a}, 3) + 0.7e0) * {_simpson('pow(@ / (0.3e0 + 0.7e0 * pow(@, 3)), 1.5e0)', a)})"


@query("t1_expansion", f"SELECT k, {rs(_E('redshift'))} AS e, {rs('2997.92458e0 * ' + _simpson('(1e0 / ' + _E('@') + ')', 'redshift'), 4)} AS distance, {rs(_GROW('(1e0 / (1e0 + redshift))') + ' / ' + _GROW('1e0'))} AS growth, {rs('0.3e0 * pow(1e0 + redshift, 3) / (0.3e0 * pow(1e0 + redshift, 3) + 0.7e0)')} AS omega FROM {PART}")
def _(spark, d):
    u = theory.Expansion(0.3)
    return part(spark, d).select("k", r(u.e("redshift")).alias("e"), r(u.comoving_distance("redshift"), 4).alias("distance"), r(u.growth("redshift")).alias("growth"), r(u.omega_m_at("redshift")).alias("omega"))


@query("t3_occupation", f"SELECT k, {rs('CASE WHEN weight >= 1000e0 THEN 1e0 + pow(weight / 1200e0, 1.1e0) ELSE 0e0 END')} AS mean, {rs('CASE WHEN weight >= 1000e0 THEN 2e0 * pow(weight / 1200e0, 1.1e0) + pow(pow(weight / 1200e0, 1.1e0), 2) ELSE 0e0 END')} AS pairs FROM {PART}")
def _(spark, d):
    h = theory.PowerLawOccupation(1000.0, 1200.0, 1.1)
    return part(spark, d).select("k", r(h.mean("weight")).alias("mean"), r(h.pairs("weight")).alias("pairs"))


@query("t8_latin_hypercube", "SELECT 200::BIGINT AS n, 200::BIGINT AS a, 200::BIGINT AS b, 200::BIGINT AS c")
def _(spark, d):
    s = theory.latin_hypercube(spark, 200, ["a", "b", "c"], seed=4)
    return s.agg(F.count("*").alias("n"), *[F.countDistinct(F.floor(F.col(c) * 200)).alias(c) for c in "abc"])


@query("x8_region_file", f"SELECT 0 AS id, count(*) AS n FROM {more._pixelized_sql(bounds.Circle(30, -20, 4), 4, 7)} UNION ALL SELECT 1, count(*) FROM {more._pixelized_sql(bounds.Circle(200, 40, 2.5), 5, 7)}")
def _(spark, d):
    """Circles of a text file of regions, each pixelised."""
    path = scratch.folder(spark, "text")
    spark.createDataFrame([("0 circle 30 -20 4",), ("1 circle 200 40 2.5",), ("# a remark",)], "value string").write.text(path)
    out = None
    for number, shape in text_io.read_regions(spark, path):
        one = area_map.pixelize(spark, shape, 7).agg(F.lit(number).alias("id"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
