"""Brute-force SQL comparison shared by the tests of this folder."""
import duckdb
import pyarrow as pa

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from check_oracle import digest  # noqa: E402


def same_as_sql(df, sql, **tables):
    """``tables``: pyarrow tables or Parquet paths registered under their names."""
    con = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, pa.Table):
            con.register(name, t)
        else:
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{t}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    a = digest(df.columns, [tuple(r) for r in df.collect()])[1]
    b = digest(want.columns, want.fetchall())[1]
    assert a == b
