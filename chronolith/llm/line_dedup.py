"""Cross-site boilerplate lines by distinct-site sketches (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import of_keys, written

#: A line on this many sites or more is boilerplate.
MIN_SITES = 10
#: Sketches have 2^LG_K registers: a standard error of about 1.04 / sqrt(2^LG_K).
LG_K = 10
#: Estimates within so many standard errors of the threshold, and one site at least, are counted exactly.
BAND = 4.0


#: What counts as white space within a line.
_SPACE = "[ \\t\\r\\f\\x0b]+"


def _line_keys(text: str) -> Column:
    """Keys of the lines of a text column, white space folded, then trimmed; a line of white space alone has that of the empty string."""
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.xxhash64(F.trim(F.regexp_replace(x, _SPACE, " "))))


def _blank() -> Column:
    return F.xxhash64(F.lit(""))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, text_hash, site, keys): the keys of each row's lines, a number each, written once for all that reads them."""
    site = F.when(F.col(site_col).isNotNull(), F.xxhash64(site_col))
    return written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), site.alias("site"), F.array_distinct(_line_keys(text_col)).alias("keys")), "lines")


def boilerplate_lines(keyed: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (k, sites, rows) of the lines of keyed_lines that stand on min_sites sites or more.

    A line whose smallest and largest site agree has one site and needs no sketch. The
    others get a HyperLogLog sketch of their sites, merged by aggregation; sites are
    counted exactly where the estimate is near the threshold. Lines far above it keep
    the estimate. A null site is no site. rows says how many rows have the line.
    """
    lines = keyed.filter("site is not null").select("site", F.explode("keys").alias("k")).filter(F.col("k") != _blank())
    ends = lines.groupBy("k").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.count("*").alias("rows"))
    spread = written((ends.filter("lo <> hi") if min_sites > 1 else ends).select("k", "rows"), "spread")
    sketches = of_keys(lines, spread, "k", "rows").groupBy("k").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("rows"))
    sketched = written(sketches.select("k", F.hll_sketch_estimate("sketch").alias("estimate"), "rows"), "sketches")
    margin = max(1.0, BAND * 1.04 / 2 ** (LG_K / 2) * min_sites)
    near = F.col("estimate").between(min_sites - margin, min_sites + margin)
    counted = of_keys(lines, sketched.filter(near).select("k", "rows"), "k", "rows").groupBy("k", "site").agg(F.count("*").alias("n"))
    counted = counted.groupBy("k").agg(F.count("*").alias("sites"), F.sum("n").alias("rows"))
    far = sketched.filter(~near & (F.col("estimate") > min_sites)).select("k", F.col("estimate").alias("sites"), "rows")
    return far.unionByName(counted.filter(F.col("sites") >= min_sites))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """id, text without boilerplate lines, n_removed; one row per row of docs.

    Lines end at line feeds and are compared trimmed, with runs of blanks, tabs, carriage
    returns and form feeds as one space; blank lines are never removed. Null text gives
    null text and 0; very long texts are lines like any other. Rows of one id and text
    share the look-up of their lines, null ids too. A tie at min_sites is boilerplate. An
    empty table gives no rows; other columns, and their names, have no effect.
    """
    keyed = keyed_lines(docs, id_col, text_col, site_col)
    bad = written(boilerplate_lines(keyed, min_sites).select("k", "rows"), "boilerplate")
    # A row without a site isn't counted in rows, but has its lines removed.
    lines = keyed.select("id", "text_hash", F.explode("keys").alias("k"))
    hits = of_keys(lines, bad, "k", "rows").groupBy("id", "text_hash").agg(F.collect_set("k").alias("bad")).select(F.col("id").alias("hit"), F.col("text_hash").alias("hit_hash"), "bad")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.join(hits.hint("shuffle_hash"), rows["id"].eqNullSafe(hits["hit"]) & (F.xxhash64(rows["text"]) == hits["hit_hash"]), "left")
    lines = F.split("text", "\n")
    kept = F.transform(F.filter(F.arrays_zip(lines.alias("line"), _line_keys("text").alias("k")), lambda x: ~F.array_contains(F.col("bad"), x["k"])), lambda x: x["line"])
    # Only texts with a line to remove are looked at again.
    some = F.col("bad").isNotNull() & F.col("text").isNotNull()
    found = found.select("id", "text", F.when(some, kept).alias("kept"))
    removed = F.when(F.col("kept").isNotNull(), F.size(lines) - F.size("kept")).otherwise(0).cast("long")
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    return found.select(F.col("id").alias(id_col), text.alias(text_col), removed.alias("n_removed"))


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs)
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_CLEAN = f"trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))"
SQL = f"""
WITH lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, source, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM lines),
c AS (SELECT doc_id, source, x, i, {_CLEAN} AS k FROM u),
bad AS (SELECT k FROM c WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT c.doc_id, c.i, c.x, bad.k IS NOT NULL AS gone FROM c LEFT JOIN bad ON c.k = bad.k),
d AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t FROM m GROUP BY doc_id)
SELECT s.doc_id, coalesce(d.n_removed, 0) AS n_removed, CASE WHEN s.text IS NOT NULL THEN length(d.t) END AS n_chars, sha256(coalesce(d.t, '')) AS text_sha256
FROM documents s LEFT JOIN d ON s.doc_id = d.doc_id
"""
