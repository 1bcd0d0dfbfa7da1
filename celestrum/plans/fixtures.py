"""Sky catalogs and maps derived from the tables' keys, for Spark and as SQL.

Positions are an integer hash of the key, so both engines compute the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.functions import cells

#: table -> key and the offset of its hash
KEYS = {"customer": ("c_custkey", 12345), "orders": ("o_orderkey", 54321), "supplier": ("s_suppkey", 777), "part": ("p_partkey", 4242)}


def catalog(spark, sf_dir: str, table: str, *columns: str, key: str | None = None, offset: int | None = None) -> DataFrame:
    """k, the columns (expressions), and ra, ux, uy, uz."""
    name, c = KEYS.get(table, (key, offset))
    name, c = key or name, c if offset is None else offset
    k = F.expr(f"cast({name} as bigint)")
    m1, m2 = (k * 1103515245 + c) % 2147483648, (k * 69069 + (c + 7)) % 2147483648
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(k.alias("k"), *[F.expr(e) for e in columns], m1.alias("_m1"), m2.alias("_m2"))
    rows = rows.withColumns({"ra": 360.0 * ((F.col("_m1") * F.col("_m1")) % 2147483647 / 2147483647.0), "uz": 2.0 * ((F.col("_m2") * F.col("_m2")) % 2147483647 / 2147483647.0) - 1.0})
    across = F.sqrt(1.0 - F.col("uz") * F.col("uz"))
    a = F.radians(F.col("ra") - 95.0)
    return rows.withColumns({"ux": F.cos(a) * across, "uy": F.sin(a) * across}).drop("_m1", "_m2")


def catalog_sql(table: str, *columns: str, key: str | None = None, offset: int | None = None) -> str:
    """The same as a subquery."""
    name, c = KEYS.get(table, (key, offset))
    name, c = key or name, c if offset is None else offset
    more = "".join(f", {e}" for e in columns)
    names = "".join(f", {e.split(' AS ')[-1]}" for e in columns)
    return f"""(SELECT k{names}, ra, cos(radians(ra - 95e0)) * sqrt(1e0 - uz * uz) AS ux, sin(radians(ra - 95e0)) * sqrt(1e0 - uz * uz) AS uy, uz FROM (
      SELECT k{names}, 360e0 * (((m1 * m1) % 2147483647) / 2147483647e0) AS ra, 2e0 * (((m2 * m2) % 2147483647) / 2147483647e0) - 1e0 AS uz FROM (
        SELECT ({name})::BIGINT AS k{more}, (({name})::BIGINT * 1103515245 + {c}) % 2147483648 AS m1, (({name})::BIGINT * 69069 + {c + 7}) % 2147483648 AS m2 FROM {table})))"""


ETA = "(CASE WHEN degrees(atan2(uz, uy)) - 32.5e0 > 180e0 THEN degrees(atan2(uz, uy)) - 392.5e0 WHEN degrees(atan2(uz, uy)) - 32.5e0 <= -180e0 THEN degrees(atan2(uz, uy)) + 327.5e0 ELSE degrees(atan2(uz, uy)) - 32.5e0 END)"


def x_sql(r: int) -> str:
    e = f"({ETA} - 91.25e0)"
    return f"least(floor((CASE WHEN {e} <= 0 THEN {e} + 360e0 ELSE {e} END) * ({36 * r} / 360e0)), {36 * r - 1})::BIGINT"


def y_sql(r: int) -> str:
    return f"greatest(0, least(floor((1e0 + ux) * ({13 * r} / 2e0)), {13 * r - 1}))::BIGINT"


#: A cell's centre as SQL over x, y.
def center_sql(r: int) -> str:
    lam, eta = f"asin(1e0 - (y + 0.5e0) * {2 / (13 * r)!r}e0)", f"radians((x + 0.5e0) * {360 / (36 * r)!r}e0 + 91.25e0 + 32.5e0)"
    return f"-sin({lam}) AS ux, cos({lam}) * cos({eta}) AS uy, cos({lam}) * sin({eta}) AS uz"


#: Maps: resolution and rule.
MAPS = {"m": (8, "(x + 3 * y) % 5 < 3"), "n": (4, "(2 * x + y) % 7 < 4")}


def sky_map(spark, name: str) -> DataFrame:
    r, rule = MAPS[name]
    nx = cells.NX0 * r
    rows = spark.range(nx * cells.NY0 * r).select((F.col("id") % nx).alias("x"), F.floor(F.col("id") / nx).cast("long").alias("y"))
    return rows.where(rule).select(F.lit(cells.level_of(r)).alias("level"), "x", "y", (1.0 + F.col("x") % 3).alias("weight"))


def sky_map_sql(name: str) -> str:
    r, rule = MAPS[name]
    nx = 36 * r
    return f"(SELECT {cells.level_of(r)} AS level, x, y, 1e0 + x % 3 AS weight FROM (SELECT i % {nx} AS x, i // {nx} AS y FROM range({nx * 13 * r}) t(i)) WHERE {rule})"


def fine_sql(name: str) -> str:
    """A map's cells at resolution 8: x, y, weight."""
    r, _ = MAPS[name]
    s = 8 // r
    return f"(SELECT x * {s} + a AS x, y * {s} + b AS y, weight FROM {sky_map_sql(name)}, range({s}) p(a), range({s}) q(b))"
