"""Exact deduplication over an extendible-hash index on shared files (DataFrame functions only).

A text's key is a 64-bit hash. The directory maps the first bits of a key to a bucket;
it doubles, and an overfull bucket is split by one more bit, until every bucket fits.
The owner of a bucket compares the bytes of texts that share a key and chains the
different ones; an entry of a chain says which row of its text stays. Rows are decided
by looking them up: directory, bucket, key, and bytes where a chain has several texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.store import written
from .common import ascii_lower, join_counted, of_keys, small

#: Keys of a bucket; bits that a directory looks ahead of the even depth before it counts keys anew.
CAPACITY, AHEAD = 1 << 16, 8
KEY_BITS = 64
#: Texts of colliding keys that are broadcast, in bytes.
BROADCAST_BYTES = 1 << 25


def _first_bits(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def _bucket(prefix: str, depth: str, bits: int) -> Column:
    """Bucket of a prefix of so many bits: its depth, then as many of its bits."""
    return F.concat_ws(":", F.col(depth).cast("string"), F.expr(f"shiftrightunsigned({prefix}, {bits} - {depth})").cast("string"))


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(entries(entry, bucket), bits) of a directory for keys(h long), different ones.

    It starts with the number of buckets that the keys need if they fall evenly; while
    a bucket has more than `capacity` keys it is split by one more bit, up to all of a
    key's bits. An entry is a key's first `bits` bits, as many as the deepest bucket has.
    """
    total = keys.count()
    start = max(0, math.ceil(math.log2(max(total, 1) / capacity)))
    ahead = start
    while True:
        ahead = min(KEY_BITS, ahead + AHEAD)
        prefixes = written(keys.groupBy(_first_bits("h", ahead).alias("prefix")).agg(F.count("*").alias("n")), "prefixes")
        depths = prefixes.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(ahead)))).withColumn("bucket", _bucket("prefix", "depth", ahead))
        sized = depths.withColumn("keys", F.sum("n").over(W.partitionBy("bucket")))
        # A bucket is split while it is overfull: a prefix ends in the first one that fits.
        fit = (F.col("keys") <= capacity) | (F.col("depth") == KEY_BITS)
        ends = written(sized.filter(fit).groupBy("prefix").agg(F.min_by("bucket", "depth").alias("bucket"), F.min("depth").alias("depth")), "ends")
        if ends.count() == prefixes.count():
            bits = ends.agg(F.max("depth")).first()[0] or 0
            entry = F.shiftrightunsigned("prefix", ahead - bits) if bits else F.lit(0).cast("long")
            return written(ends.select(entry.alias("entry"), "bucket").distinct(), "entries"), bits


@dataclass(frozen=True)
class Index:
    """entries(entry, bucket) by the first `bits` bits of a key; chains(bucket, h, chain, long, text, keep_id, group_size).

    long says how many texts the key's chain has, rows how many rows the key has; text is
    there where they are several.
    """

    entries: DataFrame
    bits: int
    chains: DataFrame

    def bucket_of(self, keys: DataFrame) -> DataFrame:
        """keys(h, ...) with their bucket, found in the directory."""
        return keys.withColumn("entry", _first_bits("h", self.bits)).join(small(self.entries), "entry").drop("entry")


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, sha) of every row, written once: all that a look-up needs of a text whose key is its own."""
    return written(_normal(docs, id_col, text_col).select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "keys")


def build_index(docs: DataFrame, keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> Index:
    """The index of docs, whose keyed_rows are keyed.

    Only texts whose key several rows have are read again and shuffled, combined before
    the shuffle, so that a large group of copies is one row of each task. Texts of one
    key are told apart by this combination; the owner of a bucket chains what is left.
    """
    counts = written(keyed.groupBy("h").agg(F.count("*").alias("rows"), F.max("id").alias("keep_id")), "counts")
    entries, bits = build_directory(counts.select("h"), capacity)
    index = Index(entries, bits, counts)
    shared = written(counts.filter("rows > 1").select("h", "rows"), "shared")
    texts = of_keys(_normal(docs, id_col, text_col), shared, "h", "rows").groupBy("h", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = index.bucket_of(written(texts, "shared-texts")).repartition("bucket")
    by_key = W.partitionBy("bucket", "h")
    chained = owned.select("*", F.row_number().over(by_key.orderBy("norm")).alias("chain"), F.count("*").over(by_key).alias("long"), F.sum("group_size").over(by_key).alias("rows"))
    chained = chained.select("bucket", "h", "rows", "chain", "long", F.when(F.col("long") > 1, F.col("norm")).alias("text"), "keep_id", "group_size")
    alone = index.bucket_of(counts.filter("rows = 1")).select("bucket", "h", "rows", F.lit(1).alias("chain"), F.lit(1).cast("long").alias("long"), F.lit(None).cast("string").alias("text"), "keep_id", F.lit(1).cast("long").alias("group_size"))
    return Index(entries, bits, written(alone.unionByName(chained), "chains"))


def look_up(docs: DataFrame, keyed: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, keep_id, group_size) of every row: by bucket and key, and by its bytes where the key's chain has several texts."""
    chains = index.chains.withColumn("at", F.concat_ws("/", "bucket", F.col("h").cast("string")))
    several = written(chains.filter("long > 1"), "several")
    if several.isEmpty():
        rows, one = keyed, chains
    else:
        collided = small(several.select("h").distinct())
        rows, one = keyed.join(collided, "h", "left_anti"), chains.filter("long = 1")
    at = index.bucket_of(rows).select("id", "sha", F.concat_ws("/", "bucket", F.col("h").cast("string")).alias("at"))
    found = join_counted(at, one.select("at", "rows", "keep_id", "group_size"), "at", "rows").select("id", "sha", "keep_id", "group_size")
    if several.isEmpty():
        return found
    texts = index.bucket_of(_normal(docs, id_col, text_col).join(collided, "h", "left_semi"))
    same = several.select("bucket", "h", F.col("text").alias("norm"), "keep_id", "group_size")
    size = same.agg(F.sum(F.octet_length("norm"))).first()[0]
    compared = texts.join(small(same) if size <= BROADCAST_BYTES else same, ["bucket", "h", "norm"])
    return found.unionByName(compared.select("id", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group
    stays. Null text counts as empty. Null ids never stay beside others; a group of
    null ids alone has keep_id null and stays. A repeated row counts in group_size and
    shares the decision of its id. An empty table gives no rows; other columns, and
    their names, have no effect.
    """
    keyed = keyed_rows(docs, id_col, text_col)
    found = look_up(docs, keyed, build_index(docs, keyed, id_col, text_col, capacity), id_col, text_col)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; columns as before.

    Null, empty, very long and repeated rows, and null ids, fare as there; rows of one id
    and text stay or go together. An empty table stays empty.
    """
    out = exact_dedup(docs, id_col, text_col).filter(~F.col("kept"))
    dropped = written(out.select(F.col(id_col).alias("__gone"), F.col("text_sha256").alias("__gone_text")).distinct(), "dropped")
    sha = F.sha2(ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))), 256)
    return docs.join(small(dropped), docs[id_col].eqNullSafe(dropped["__gone"]) & (sha == dropped["__gone_text"]), "left_anti")


SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
