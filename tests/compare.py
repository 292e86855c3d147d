"""Runs registered queries beside their SQL and says where they differ."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    return (v is not None, repr(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None if both results agree in names, types and rows."""
    got_types = {n: SPARK_TO_DUCK.get(t, t) for n, t in df.dtypes}
    want = con.sql(sql)
    want_types = {n: str(t) for n, t in zip(want.columns, want.types)}
    if got_types != want_types:
        diff = {k: (got_types.get(k), want_types.get(k)) for k in got_types | want_types if got_types.get(k) != want_types.get(k)}
        return f"schema: {diff}"
    a, b = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(want.columns, want.fetchall())
    if a != b:
        x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"rows: {len(a)} and {len(b)}\n   columns {sorted(df.columns)}\n   spark {x}\n   sql   {y}"
    return None if a else "both empty"


def main(argv: list[str]) -> None:
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf = argv[0]
    names = argv[1:] or list(queries())
    spark, con, oracle = make_session(), duck(sf), oracle_sql()
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries()[n](spark, sf)
            msg = difference(df, con, oracle[n]) if n in oracle else f"no sql; {df.collect()}"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(msg) and not str(msg).startswith("no sql")
        print(f"{'ok ' if not msg else 'BAD'} {n} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")


if __name__ == "__main__":
    main(sys.argv[1:])
