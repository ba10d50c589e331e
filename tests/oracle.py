"""Comparison of a query with its SQL, as unordered rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame) -> list[str]:
    plain = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))
