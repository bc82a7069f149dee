"""Run registered queries beside their SQL and compare whole results.

    python tests/oracle.py sf_dir [name ...]
"""
from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return "null"
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf: str, name: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf)
    got = [tuple(row) for row in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall() if hasattr(rel, "fetchall") else con.execute(sql).fetchall()
    names, theirs = list(df.columns), list(rel.columns)
    if sorted(names) != sorted(theirs):
        return f"columns {sorted(names)} against {sorted(theirs)}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sqlkinds = dict(zip(theirs, [str(t) for t in rel.types]))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in names:
        if same.get(kinds[c], "?") != sqlkinds[c] and not kinds[c].startswith("timestamp"):
            return f"type of {c}: {kinds[c]} against {sqlkinds[c]}"
    a, b = _rows(names, got), _rows(theirs, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}"
    if not a:
        return "empty result"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from saddle.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf)
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sqls:
                problem, note = compare(spark, con, sf, name, fn, sqls[name]), "same"
            else:
                n = fn(spark, sf).count()
                problem, note = (None if n else "empty result"), f"rows {n}"
        except Exception as e:  # noqa: BLE001
            problem, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - t:6.2f}s {problem or note}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
