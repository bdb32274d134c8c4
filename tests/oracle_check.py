"""Run catalog queries in Spark and their check statements in DuckDB and compare rows.

    python tests/oracle_check.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagelore.plans import catalog  # noqa: E402
from pagelore.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value + 0.0, 9))
    if isinstance(value, bool) or value is None:
        return value
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, key: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} (no check statement) spark={t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    note = f"rows={len(got)} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)} {note}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in cur.description:
        kind, ours = str(c[1]), types[c[0]]
        if {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}.get(kind) != ours:
            note += f" [type {c[0]}: {ours} vs {kind}]"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, note
    sa, sb = set(a), set(b)
    lines = [note, f"   duck rows={len(b)} only spark={len(sa - sb)} only duck={len(sb - sa)}"]
    lines += [f"   S {str(x)[:500]}" for x in sorted(sa - sb, key=repr)[:2]]
    lines += [f"   D {str(x)[:500]}" for x in sorted(sb - sa, key=repr)[:2]]
    return False, "\n".join(lines)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--family", default="")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    if args.family:
        catalog.FAMILIES = tuple(args.family.split(","))
    spark, con = build_session(), duck(sf_dir)
    queries, sqls = catalog.queries(), catalog.oracle_sql()
    bad = []
    for key in args.keys or queries:
        try:
            ok, note = compare(spark, con, sf_dir, key, queries[key], sqls.get(key))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print(("ok  " if ok else "BAD ") + key, note, flush=True)
        if not ok:
            bad.append(key)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
