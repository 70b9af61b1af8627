"""Run registered checks on both engines and compare rows: ``python tests/compare.py [sf] [name prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("DAYBILL_DATA", "/root/testdata")


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if value is None:
        return None
    return str(value)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple("" if x is None else "~" + x for x in r))


def compare(spark, con, name: str, folder: str) -> str:
    """An empty string when both engines agree, else a description of the difference."""
    from daybill.checks import load
    from daybill.plans.listings import Tables

    item = load()[name]
    df = item.build(Tables(spark, folder))
    rows = df.collect()
    if item.sql is None:
        return "" if rows else "no rows"
    cur = con.execute(item.sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    duck_types = {d[0]: str(d[1]).upper() for d in cur.description}
    theirs = normal(names, cur.fetchall())
    ours = normal(df.columns, rows)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    allowed = {"string": ("STRING", "VARCHAR"), "bigint": ("NUMBER", "BIGINT"), "int": ("NUMBER", "INTEGER"), "double": ("NUMBER", "DOUBLE"), "boolean": ("BOOL", "BOOLEAN")}
    odd = [f"{n}: {kinds[n]} against {duck_types[n]}" for n in kinds if kinds[n] not in allowed or duck_types[n] not in allowed[kinds[n]]]
    if odd:
        return "types " + "; ".join(odd)
    if not theirs:
        return "both empty" if not ours else f"{len(ours)} rows against none"
    if ours == theirs:
        return ""
    a, b = set(ours), set(theirs)
    return f"{len(ours)} rows against {len(theirs)}; only here {sorted(a - b, key=str)[:2]}; only there {sorted(b - a, key=str)[:2]}"


def main() -> None:
    from daybill.checks import load
    from daybill.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"{DATA}/sf{sf}"
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    names = [n for n in load() if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            outcome = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
        if outcome:
            bad += 1
        if outcome or time.time() - start > 5 or os.environ.get("VERBOSE"):
            print(f"{name:40s} {time.time() - start:6.2f}s {outcome or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
