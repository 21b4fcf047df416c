"""Holds registered queries against their SQL in an independent engine."""

import math

import duckdb

from tessera.queries.tables import NAMES


def connect(sf_dir):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def kinds(table):
    shown = {f.name: str(f.type).replace("large_", "") for f in table.schema}
    return {n: "timestamp" if k.startswith("timestamp") else k for n, k in shown.items()}


def check(spark, con, name, query, sql, sf_dir):
    got = query(spark, sf_dir).toArrow()
    want = con.execute(sql).to_arrow_table() if hasattr(con.execute("SELECT 1"), "to_arrow_table") else con.execute(sql).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert kinds(got) == kinds(want), name
    assert rows(got) == rows(want), name
    return got.num_rows
