"""Comparisons that all tests share."""

from __future__ import annotations

from pathlib import Path


def matches_oracle(spark, query, sql: str, sf_dir: str) -> None:
    """Runs a query and its SQL over the same tables and compares all rows, numbers to nine digits."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
            return float(f"{float(v):.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        if isinstance(v, dict):
            return tuple(sorted((k, plain(x)) for k, x in v.items()))
        return v

    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [names.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
