"""Run registered queries against their SQL twins and compare whole results."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return tuple(_value(x) for x in v) if isinstance(v, (list, tuple)) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted([tuple(_value(v) for v in r) for r in df.select(*names).collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_value(r[i]) for i in order) for r in result.fetchall()]
    return [names[i] for i in order], _sorted(rows)


def differences(df, con, sql) -> list[str]:
    got_names, got = spark_rows(df)
    want_names, want = sql_rows(con, sql)
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"] + [f"{got[:2]} vs {want[:2]}"]
    out = []
    for g, w in zip(got, want):
        for name, a, b in zip(got_names, g, w):
            if a != b or type(a) is not type(b):
                out.append(f"{name}: {a!r} != {b!r} in {str(g)[:300]}")
    return out


def main(argv):
    from answerloom.queries import ORACLES, QUERIES
    from answerloom.session import local_session

    sf_dir = argv[0]
    spark = local_session(8)
    con = duck(sf_dir)
    wanted = argv[1:] or list(QUERIES)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                diffs = differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])
            else:
                diffs = []
                print(f"{name}: rows only, {len(QUERIES[name](spark, sf_dir).collect())} rows")
        except Exception as error:  # noqa: BLE001
            diffs = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(diffs)
        print(f"{'DIFF' if diffs else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        for d in diffs[:3]:
            print("    ", d[:1500], f"({len(diffs)} in all)")
    print("bad:", bad)


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
