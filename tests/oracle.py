"""Run queries next to their SQL checks: python tests/oracle.py [sf] [name part ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edgeloom.plans.inputs import TABLES  # noqa: E402

DATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return f"{float(v):.6f}"
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


FAMILY = {"bigint": "int", "int": "int", "integer": "int", "hugeint": "HUGE", "double": "float", "float": "float", "string": "str", "varchar": "str", "boolean": "bool"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols, want_types = [d[0] for d in cur.description], [str(d[1]).lower() for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c, t in zip(want_cols, want_types):
        a, b = FAMILY.get(got_types[c], got_types[c]), FAMILY.get(t, t)
        if a != b:
            return f"type of {c}: {got_types[c]} != {t}"
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"rows {len(a)} vs {len(b)} cols {sorted(got_cols)}\n   spark only {only_a}\n   sql only   {only_b}"
    return None if a else "EMPTY"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from edgeloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    spark = local_session()
    sf_dir = f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    checks, bad = oracle_sql(), 0
    for name, run in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            if name in checks:
                res = compare(df, con, checks[name])
            else:
                n = df.count()
                res = f"NO SQL rows={n}"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        if res and not res.startswith("NO SQL"):
            bad += 1
        print(f"{'ok ' if res is None else '?? '} {name} {time.time() - t0:.1f}s {res or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
