"""URL filters by a sort-merge range join over reversed-host keys.

A rule (host, path) fits a URL when the URL's host is the rule's host or a
subdomain of it and the URL's path starts with the rule's path. Per rule host,
the paths of the rules are prefixes, so they span nested intervals of the path
order. Rules open and close those intervals, URLs are points between them, and
one sorted sweep per host keeps the stack of open rules: the running count of
open intervals is the stack's height, and the last rule opened at that height
is its top. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celestrum.llm import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one host that one sweep takes; hosts with more are dealt over several.
ROWS_PER_SWEEP = 50_000


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; '' if null or without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; '' if null or without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """`news.example.org` -> `org.example.news`: the canonical key, in which a domain is a prefix of its subdomains."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def apply_rules(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Longest fitting rule of each row of urls (host, path, any others).

    rules: host, path, verdict. Adds `rule` (host and path; null if none fits)
    and `verdict` (the rule's, else `default`). Of rules that fit, the one with
    the longest host and path together wins; of equally long ones that with the
    longer host. A rule given twice counts once; if its verdicts differ, it
    blocks. Null hosts or paths in rules are ignored; null in urls: ''. Rows,
    repeated ones too, stay as they are; columns named rule or verdict are replaced,
    others stay, whatever their names.
    """
    urls = urls.drop("rule", "verdict")
    h, p, w = shared.free(urls.columns, "_h", "_p", "_won")
    base = urls.withColumns({h: F.coalesce("host", F.lit("")), p: F.coalesce("path", F.lit(""))})
    known = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.col("host").alias("_rh"), F.col("path").alias("_rp"))
        .agg(F.max("verdict").alias("_verdict"))  # block after allow
        .withColumn("_key", reversed_host(F.col("_rh")))
    )
    deepest = known.agg(F.max(F.size(F.split("_rh", r"\.")))).first()[0] or 0
    distinct = base.select(F.col(h).alias("_h"), F.col(p).alias("_p")).distinct()
    labels = F.split("_h", r"\.")
    points = (
        distinct.withColumn("_labels", F.reverse(labels))
        .withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(max(1, deepest))))))
        .select("_h", "_p", F.array_join(F.slice("_labels", F.lit(1), F.col("_n")), ".").alias("_key"))
        .join(known.groupBy("_key").agg(F.count("*").alias("_rules")), "_key")
    )
    # Rules go to each of a host's sweeps, so a sweep has as many URLs as rules at least: no more events than twice the URLs.
    sweeps = points.groupBy("_key").agg(F.ceil(F.count("*") / F.greatest(F.lit(ROWS_PER_SWEEP), F.first("_rules"))).cast("int").alias("_sweeps"))
    opened = (
        known.join(sweeps, "_key")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_sweeps") - 1)))
        .withColumn("_rule", F.struct((F.length("_rh") + F.length("_rp")).alias("size"), F.length("_rh").alias("host_size"), F.concat("_rh", "_rp").alias("rule"), F.col("_verdict").alias("verdict")))
    )
    path_bytes = F.encode("_rp", "UTF-8")
    none = F.lit(None).cast("string")
    no_rule = F.lit(None).cast(opened.schema["_rule"].dataType)
    events = (
        opened.select("_key", "_salt", path_bytes.alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_step"), "_rule", none.alias("_h"), none.alias("_p"))
        # 0xFF is in no UTF-8 text: the end of a prefix's interval comes after everything that starts with it.
        .unionByName(opened.select("_key", "_salt", F.concat(path_bytes, F.unhex(F.lit("FF"))).alias("_at"), F.lit(2).alias("_kind"), F.lit(-1).alias("_step"), no_rule.alias("_rule"), none.alias("_h"), none.alias("_p")))
        .unionByName(points.join(sweeps, "_key").select("_key", F.pmod(F.xxhash64("_h", "_p"), F.col("_sweeps")).cast("int").alias("_salt"), F.encode("_p", "UTF-8").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_step"), no_rule.alias("_rule"), "_h", "_p"))
        # Parts of the union may be dealt by the key alone, which the windows would take as good enough: a host's sweeps go apart here.
        .repartition("_key", "_salt")
    )
    sweep = Window.partitionBy("_key", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("_key", "_salt", "_height").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    won = (
        events.withColumn("_height", F.sum("_step").over(sweep))
        .withColumn("_top", F.last("_rule", ignorenulls=True).over(level))
        .where((F.col("_kind") == 1) & (F.col("_height") > 0))
        .groupBy(F.col("_h").alias(h), F.col("_p").alias(p))
        .agg(F.max("_top").alias(w))
    )
    return (
        base.join(won, [h, p], "left")
        .withColumns({"rule": F.col(f"{w}.rule"), "verdict": F.coalesce(F.col(f"{w}.verdict"), F.lit(default))})
        .drop(h, p, w)
    )


#: The rules of the query, in its order: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def query(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES) + " AS t(host, path, verdict)")
    return apply_rules(urls, rules)


_FITS = " OR ".join(f"(v = {k} AND (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for k, (_, h, p) in enumerate(RULES))
ORACLE = f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(v, rule, verdict) AS (VALUES {", ".join(f"({k}, '{h}{p}', '{v}')" for k, (v, h, p) in enumerate(RULES))}),
won AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON {_FITS} GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN won USING (r)
"""
