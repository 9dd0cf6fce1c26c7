"""Run registered queries next to their SQL on the same files: rows, columns, types and values must agree.

usage: check_oracles.py [sf_dir] [name-prefix ...]
"""

import importlib.util
import pathlib
import sys
import time
from collections import Counter

import duckdb

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPE_NAMES = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
              "timestamp": "TIMESTAMP", "date": "DATE"}


def value(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat() if hasattr(x, "hour") else x.isoformat()
    return x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def main(argv):
    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from spanloom.session import build_session

    spark = build_session(
        "check", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                    "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            rows = df.collect()
            t1 = time.time()
            note = ""
            if name in oracles:
                rel = con.sql(oracles[name])
                theirs = rel.fetchall()
                want = dict(zip(rel.columns, [str(x) for x in rel.types]))
                have = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
                        for f in df.schema.fields}
                if want != have:
                    note += f" TYPES spark={ {k: v for k, v in have.items() if want.get(k) != v} }" \
                            f" sql={ {k: v for k, v in want.items() if have.get(k) != v} }"
                a, b = bag(df.columns, rows), bag(rel.columns, theirs)
                if a != b:
                    note += f" VALUES spark-only={list((a - b).items())[:2]} sql-only={list((b - a).items())[:2]}" \
                            f" n={sum((a - b).values())}/{sum((b - a).values())}"
            kind = "sql " if name in oracles else "rows"
            state = "FAIL" if note else ("ok  " if rows else "EMPTY")
            bad += bool(note)
            print(f"{state} {kind} {name} rows={len(rows)} spark={t1 - t0:.2f}s sql={time.time() - t1:.2f}s{note[:1500]}",
                  flush=True)
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print(f"done, {bad} bad")
    spark.stop()


main(sys.argv)
