"""Runs registered queries next to their SQL in DuckDB and compares all rows.

    python tools_check.py [--sf DIR] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import math
import tempfile
import time

import duckdb

from goldseam.queries import load_all
from goldseam.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="goldseam-check-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    bad = 0
    for name, item in load_all().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = item.run(spark, args.sf)
            if args.explain:
                df.explain("formatted")
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if item.oracle is None:
                print(f"ROWS  {name:34s} {len(got):7d} rows {took:6.2f}s")
                continue
            cursor = con.execute(item.oracle)
            names = [d[0] for d in cursor.description]
            want = rows_of(names, cursor.fetchall())
            types = {d[0]: str(d[1]) for d in cursor.description}
            if sorted(names) != sorted(df.columns):
                bad += 1
                print(f"BAD   {name}: columns {sorted(df.columns)} vs {sorted(names)}")
            elif got != want:
                bad += 1
                print(f"BAD   {name}: {len(got)} vs {len(want)} rows")
                mine, theirs = set(got) - set(want), set(want) - set(got)
                print("   cols ", sorted(names))
                for row in sorted(mine)[:3]:
                    print("   spark", row)
                for row in sorted(theirs)[:3]:
                    print("   duck ", row)
            else:
                odd = [
                    f"{n}:{t}/{dict(df.dtypes)[n]}"
                    for n, t in types.items()
                    if t.upper() in ("HUGEINT", "INTEGER") and dict(df.dtypes)[n] != "int"
                    or (t.upper() == "BIGINT" and dict(df.dtypes)[n] != "bigint")
                ]
                note = f" types {odd}" if odd else ""
                print(f"OK    {name:34s} {len(got):7d} rows {took:6.2f}s{note}")
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:700]}")
    print("bad:", bad)


if __name__ == "__main__":
    main()
