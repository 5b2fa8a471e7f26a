"""Readers and writers of trial tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import to_number
from ..operators.frames import DataError, normalize_keys, require
from ..operators.joins import assert_unique


def read_frames(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None, fmt: str = "csv") -> DataFrame:
    """Frames from CSV (bad rows fail) or Parquet, pruned to columns."""
    r = spark.read.schema(schema)
    df = r.option("header", True).option("mode", "FAILFAST").csv(path) if fmt == "csv" else r.parquet(path)
    return df.select(*columns) if columns else df


def cached(df: DataFrame, path: str, partition_by: Sequence[str] = (), refresh: bool = False) -> DataFrame:
    """df through a zstd Parquet cache at path: written if absent, then read."""
    spark = df.sparkSession
    try:
        if not refresh:
            return spark.read.parquet(path)
    except Exception as e:  # the path isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


def series_columns(columns: Sequence[str], prefix: str) -> list[str]:
    """Columns prefix0, prefix1, ... without a gap."""
    numbers = sorted(int(c[len(prefix) :]) for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit())
    if numbers != list(range(len(numbers))) or not numbers:
        raise DataError(f"columns {prefix}0, {prefix}1, ...: none, or a gap")
    return [f"{prefix}{i}" for i in numbers]


def wide_trials(df: DataFrame, prefix: str, ids: Mapping[str, Column], most: int = 3601, start: int = 0) -> DataFrame:
    """ids and trace from a column per sample; trailing and inner nulls are left out."""
    cols = series_columns(df.columns, prefix)[start : start + most]
    values = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull() & ~F.isnan(x))
    return df.select(*[c.alias(n) for n, c in ids.items()], values.alias("trace"))


def stacked_trials(df: DataFrame, key: str, time: str, value: str, metadata: Sequence[str] = ()) -> DataFrame:
    """key, time, trace and the metadata that is one value throughout a trial (else null)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"))))
    constant = [F.when(F.count_distinct(m) == 1, F.min(m)).alias(m) for m in metadata]
    g = df.groupBy(key).agg(pairs.alias("p"), *constant)
    return g.select(key, F.transform("p", lambda x: x["t"]).alias("time"), F.transform("p", lambda x: x["v"]).alias("trace"), *metadata)


def manifest_trials(spark: SparkSession, folder: str, schema: StructType | str, manifest: DataFrame, file: str = "file") -> DataFrame:
    """Rows of every CSV of a folder with their manifest's row, joined by file name."""
    rows = spark.read.schema(schema).option("header", True).csv(folder)
    rows = rows.withColumn(file, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(F.broadcast(manifest) if manifest.limit(100_001).count() <= 100_000 else manifest, file)


def json_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The trials of a JSON manifest {"trials": [...]}."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("trials").alias("t")).select("t.*")


def load_trials(df: DataFrame, prefix: str, key: str, time: str, value: str) -> DataFrame:
    """Stacked where time and value columns are there, else wide."""
    if time in df.columns and value in df.columns:
        return stacked_trials(df, key, time, value).select(key, "trace")
    return wide_trials(df, prefix, {key: F.col(key)})


def matrix_with_metadata(matrix: DataFrame, meta: DataFrame, row: str = "row") -> DataFrame:
    """Array rows with the metadata of the same ordinal."""
    return assert_unique(matrix, [row], "matrix").join(assert_unique(meta, [row], "metadata"), row)


def metadata_rows(texts: DataFrame, column: str, fields: str) -> DataFrame:
    """(row, fields) from JSON metadata.

    {"rows": [{...}]}, {"row_index_to_meta": {"0": {...}}} in the order of its indexes, a
    plain list, or lists of values in {"data": [[...]]} or {"rows": [[...]]} whose names
    "columns" or "column_order" give; a name it lacks, or a short row, is null there.
    """
    c = F.col(column)
    by_index = F.map_entries(F.from_json(c, f"struct<row_index_to_meta:map<string,struct<{fields}>>>")["row_index_to_meta"])
    indexed = F.transform(F.array_sort(F.transform(by_index, lambda e: F.struct(e["key"].cast("long").alias("i"), e["value"].alias("x")))), lambda e: e["x"])
    kinds = {n.strip(): t.strip() for n, t in (f.split(":") for f in fields.split(","))}
    table = F.from_json(c, "struct<columns:array<string>,column_order:array<string>,data:array<array<string>>,rows:array<string>>")
    order = F.coalesce(table["columns"], table["column_order"])
    data = F.coalesce(table["data"], F.transform(table["rows"], lambda r: F.from_json(r, "array<string>")))
    value = lambda r, n: F.try_element_at(r, F.nullif(F.array_position(order, n).cast("int"), F.lit(0)))
    listed = F.transform(data, lambda r: F.struct(*[value(r, n).cast(t).alias(n) for n, t in kinds.items()]))
    rows = F.coalesce(F.from_json(c, f"struct<rows:array<struct<{fields}>>>")["rows"], F.from_json(c, f"array<struct<{fields}>>"))
    use = F.when(order.isNotNull() & data.isNotNull(), listed).otherwise(F.coalesce(indexed, rows))
    return texts.select(F.posexplode(use).alias("row", "x")).select("row", "x.*")


def channels(matrix: Column, layout: str) -> Column:
    """A [time][channel] matrix, whichever way round it is stored."""
    if layout == "trial_time_channel":
        return matrix
    return F.transform(F.sequence(F.lit(0), F.size(matrix[0]) - 1), lambda t: F.transform(matrix, lambda c: c[t]))


def decode_columns(df: DataFrame, codes: Mapping[str, Mapping[str, str]], trial: str = "trial_num", label: str = "trial_label") -> DataFrame:
    """Coded columns as text, and a trial number from its column, else from the label's digits."""
    out = df
    for c, m in codes.items():
        pairs = [F.lit(x) for kv in m.items() for x in kv]
        out = out.withColumn(c, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c).cast("string")), F.col(c).cast("string")))
    digits = F.regexp_extract(F.col(label), r"(\d+)", 1).try_cast("int")
    return out.withColumn(trial, F.coalesce(to_number(F.col(trial)).cast("int"), digits) if trial in df.columns else digits)


def read_labels(df: DataFrame, text_keys: Sequence[str], int_keys: Sequence[str], label: str) -> DataFrame:
    """Labels with clean keys, one row a key; labels not whole or negative are an error."""
    require(df, [*text_keys, *int_keys, label])
    n = to_number(F.col(label))
    bad = n.isNotNull() & ((n < 0) | (n != F.floor(n)))
    value = F.when(bad, F.raise_error(F.lit("a label that isn't a whole number of 0 or more")).cast("int")).otherwise(n.cast("int"))
    keyed = normalize_keys(df, text_keys, int_keys).withColumn(label, value).filter(F.col(label).isNotNull())
    return assert_unique(keyed, [*text_keys, *int_keys], "labels")


def read_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A trial summary: keys as they are, all else numbers or null, one row a key."""
    return assert_unique(df.select(*keys, *[to_number(F.col(c)).alias(c) for c in df.columns if c not in keys]), keys, "summary")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), columns: Sequence[str] | None = None) -> str:
    """df at path as Parquet, CSV or JSON, in the order of columns."""
    w = (df.select(*columns) if columns else df).write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("header", True).csv if fmt == "csv" else w.json if fmt == "json" else w.parquet)(path)
    return path


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files at path."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
