"""Run registered queries and their SQL twins side by side.

``python tests/oracle_check.py [--sf 0.01] [--times] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(tbl):
    tbl = tbl.select(sorted(tbl.column_names))
    cols = [c.to_pylist() for c in tbl.columns]
    rows = [tuple(_cell(v) for v in r) for r in zip(*cols)]
    rows.sort(key=repr)
    return rows


def _kind(t):
    return str(t).replace("large_", "").replace("element", "item").replace("l: ", "item: ")


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short reason."""
    left = fn(spark, sf_dir).toArrow()
    right = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).fetch_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} vs {sorted(right.column_names)}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} vs {right.num_rows}"
    types = [
        (c, _kind(left.schema.field(c).type), _kind(right.schema.field(c).type))
        for c in sorted(left.column_names)
        if _kind(left.schema.field(c).type) != _kind(right.schema.field(c).type)
    ]
    a, b = _rows(left), _rows(right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        names = sorted(left.column_names)
        diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ, first: {str(diff)[:600]} types {types}"
    if types:
        return f"types {types}"
    return None if left.num_rows else "no rows"


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    from catalogwatch.plans import load_all
    from catalogwatch.session import build_session

    qs, sqls = load_all()
    names = []
    for a in argv:
        names += [n for n in qs if n == a or (a.endswith("*") and n.startswith(a[:-1]))]
        if a.startswith("@"):
            names += [n for n in qs if qs[n].module.endswith("." + a[1:])]
    names = names or list(qs)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    failed = 0
    for n in names:
        start = time.time()
        try:
            if n in sqls:
                why = compare(spark, con, qs[n], sqls[n], sf_dir)
            else:
                count = qs[n](spark, sf_dir).toArrow().num_rows
                why = None if count else "no rows"
        except Exception as err:  # noqa: BLE001
            why = (str(err).split("JVM stacktrace")[0][:700] or repr(err)) + traceback.format_exc(limit=-2)[:500]
        took = time.time() - start
        if why:
            failed += 1
            print(f"\nFAIL {n} ({took:.1f}s): {why}", flush=True)
        else:
            print(f"\nok   {n} ({took:.1f}s){'' if n in sqls else ' rows only'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
