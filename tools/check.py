"""Run registered queries and compare them with their SQL twins.

usage: python tools/check.py [sf] [name-prefix or module ...]
"""

from __future__ import annotations

import importlib.util
import math
import sys
import time

import duckdb

ROOT = __file__.rsplit("/", 2)[0]
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v) if v is not None else "~null"


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spec = importlib.util.spec_from_file_location("entry", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, oracles = entry.queries(), entry.oracle_sql()
    from helixframe.catalog import REGISTRY

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    spark = spark_session()
    bad = 0
    for name, fn in queries.items():
        module = (REGISTRY[name][0] if name in REGISTRY else fn).__module__.rsplit(".", 1)[-1]
        if wanted and not any(name == w or module == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, path)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
            continue
        took = time.time() - t0
        if name not in oracles:
            print(f"rows {name} {len(rows)} {took:.1f}s", flush=True)
            continue
        t0 = time.time()
        try:
            cur = con.execute(oracles[name])
            ocols = [d[0] for d in cur.description]
            otypes = {d[0]: str(d[1]) for d in cur.description}
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQLFAIL {name}: {str(e)[:900]}", flush=True)
            continue
        took2 = time.time() - t0
        a, b = table(cols, rows), table(ocols, orows)
        kinds = {"tinyint": "TINYINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
        types = [
            f"{f.name}:{f.dataType.simpleString()}/{otypes.get(f.name)}" for f in df.schema.fields
            if kinds.get(f.dataType.simpleString(), "?") != otypes.get(f.name) and not f.dataType.simpleString().startswith(("array", "struct", "timestamp"))
        ]
        if a == b:
            print(f"ok   {name} {len(rows)} {took:.1f}s/{took2:.1f}s {'TYPES ' + str(types) if types else ''}{' EMPTY' if not rows else ''}", flush=True)
        else:
            bad += 1
            print(f"DIFF {name} spark={len(rows)} sql={len(orows)} {a[0] if a[0] != b[0] else ''} {b[0] if a[0] != b[0] else ''}", flush=True)
            sa, sb = set(a[1]), set(b[1])
            for label, s in (("  spark", sorted(sa - sb)[:3]), ("  sql  ", sorted(sb - sa)[:3])):
                for r in s:
                    print(label, dict(zip(a[0], r)), flush=True)
    print("bad:", bad)


main()
