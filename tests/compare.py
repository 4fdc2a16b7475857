"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import decimal
from collections import Counter

import duckdb

from cobaltmill.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return ("float", repr(value))
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides give the same rows, else a short account of the difference."""
    df = QUERIES[name](spark, sf_dir)
    ours = _bag(df.columns, df.collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    theirs = _bag(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if ours == theirs:
        return None
    extra, missing = list((ours - theirs).items()), list((theirs - ours).items())
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())} over {sorted(names)}; "
        f"only ours {len(extra)}: {extra[:3]}; only SQL {len(missing)}: {missing[:3]}"
    )
