"""Compares a Spark result with the oracle's, whatever the order of rows and columns."""

from __future__ import annotations

import math
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(c, sql, df) -> str:
    described = c.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {d[0]: d[1] for d in described}
    ours = {n: KINDS.get(k, k) for n, k in df.dtypes}
    if theirs != ours:
        return f"schema: {ours} here, {theirs} there"
    a, b = rows_of(df.columns, df.collect()), rows_of(list(theirs), c.execute(sql).fetchall())
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} rows here, {len(b)} there; only here {only_a}; only there {only_b}"
    return ""
