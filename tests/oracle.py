"""Compare registered queries with their SQL, the way a result check would: names, types, values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def compare(spark, name, fn, sql, sf_dir, con) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    started = time.time()
    rows = df.collect()
    spark_seconds = time.time() - started
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    sql_seconds = time.time() - started
    note = f"{len(rows)} rows, sql {sql_seconds:.1f}s, collect {spark_seconds:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    for f in df.schema.fields:
        want = KINDS.get(f.dataType.simpleString())
        if want and want != types[f.name]:
            return False, f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}"
    if len(rows) != len(expected):
        return False, f"{len(rows)} rows != {len(expected)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    got = Counter(tuple(_norm(r[c]) for c in order) for r in rows)
    exp = Counter(tuple(_norm(r[i]) for i in at) for r in expected)
    if got != exp:
        extra, lack = list((got - exp).items())[:3], list((exp - got).items())[:3]
        return False, f"{sum((got - exp).values())} rows differ {order}: {extra} | {lack}"
    return True, note


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tamis.session import local_session

    spark = local_session("oracle", cores="8")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            if name in sqls:
                ok, note = compare(spark, name, fn, sqls[name], sf_dir, con)
            else:
                ok, note = True, f"no SQL, {fn(spark, sf_dir).count()} rows, values not checked"
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
