"""Compare registered queries with their SQL twins: `python tests/oracle.py [sf] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(x)
    return str(x)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = rows(names, res.fetchall())
    have = rows(df.columns, got)
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}; only spark {list(set(have) - set(want))[:2]}; only sql {list(set(want) - set(have))[:2]}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    return f"{len(bad)} of {len(have)} rows differ, columns {sorted(names)}: {bad[:2]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from earmark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    failed, queries, oracles = [], entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                n = fn(spark, sf_dir).count()
                problem = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {time.time() - t:6.2f}s {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
