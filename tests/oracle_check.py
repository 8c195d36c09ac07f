"""Compare registered queries with their DuckDB text: python tests/oracle_check.py SF_DIR [name-part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from docaudit.fixtures.views import DRIVER_TABLES


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set threads to 8")
    for name in DRIVER_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, [tuple(r[c] for c in columns) for r in df.collect()]


def compare(df, con, sql):
    """None when equal, else a short text."""
    columns, mine = rows_of(df)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in cur.fetchall()]

    def key(row):
        return tuple(f"{type(v).__name__}:{v}" if v is not None else "" for v in row)

    a, b = sorted(map(key, mine)), sorted(map(key, theirs))
    if a == b:
        return None
    diff = [(x, y) for x, y in zip(a, b) if x != y][:1]
    in_a, in_b = set(a), set(b)
    only_a = [x for x in a if x not in in_b][:2]
    only_b = [y for y in b if y not in in_a][:2]
    return f"rows {len(a)} vs {len(b)} {columns} spark-only {only_a} duckdb-only {only_b} {diff if not only_a and not only_b else ''}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from docaudit.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = local_session(cores="8")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                message = compare(df, con, oracles[name])
                count = ""
                if message is None:
                    count = f"{con.execute('select count(*) from (' + oracles[name] + ')').fetchone()[0]} rows"
            else:
                message, count = None, f"{df.count()} rows, no oracle"
        except Exception as exc:  # noqa: BLE001 - report and go on
            message = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += message is not None
        print(f"{'OK ' if message is None else 'BAD'} {name} {time.time() - start:.1f}s {count if message is None else message}", flush=True)
    print("bad:", bad)
