"""SQL twins over documents that a test makes up."""

import duckdb
import pandas as pd


def twin(sql, rows):
    """DuckDB's rows for sql over documents of (doc_id, text, lang, source)."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "int64"}))
    return con.sql(sql).df()
