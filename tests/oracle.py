"""Comparison of a Spark result with DuckDB's rows for the same query."""

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def shown(x) -> str:
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        return format(float(x), ".6g") if isinstance(x, float) else str(x)

    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
