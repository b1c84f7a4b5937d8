"""Compare a Spark result with DuckDB's as sorted rows with columns in order of name."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted((tuple(r[n] for n in names) for r in table.to_pylist()), key=repr)


def check(spark_df, con, sql: str) -> None:
    got, want = spark_df.toArrow(), con.execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert got.num_rows == want.num_rows
    assert rows(got) == rows(want)
