"""Side-by-side run of a query on Spark and of its oracle on DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from corpusloom.tables import TABLES


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, name: str, entry, folder: str) -> dict:
    start = time.time()
    df = entry.run(spark, folder)
    spark_rows, spark_cols = rows_of(df.columns, df.collect())
    spark_s = time.time() - start
    result = {"name": name, "rows": len(spark_rows), "spark_s": round(spark_s, 2)}
    if entry.sql is None:
        return {**result, "status": "rows-only"}
    start = time.time()
    cur = con.execute(entry.oracle())
    cols = [c[0] for c in cur.description]
    duck_rows, duck_cols = rows_of(cols, cur.fetchall())
    result["duck_s"] = round(time.time() - start, 2)
    if spark_cols != duck_cols:
        return {**result, "status": f"columns {spark_cols} != {duck_cols}"}
    if len(spark_rows) != len(duck_rows):
        return {**result, "status": f"rows {len(spark_rows)} != {len(duck_rows)}"}
    for a, b in zip(spark_rows, duck_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return {**result, "status": f"values {spark_cols}: {a!r:.600} != {b!r:.600}"}
    return {**result, "status": "ok"}


def main(argv: list[str]) -> int:
    from corpusloom.plans import all_queries
    from corpusloom.session import build_session

    folder = argv[0]
    wanted = argv[1:]
    spark, con, bad = build_session("compare"), oracle_connection(folder), 0
    for name, entry in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            result = compare(spark, con, name, entry, folder)
        except Exception as exc:  # noqa: BLE001 - the report goes on with the next query
            result = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:700]}"}
        bad += result["status"] not in ("ok", "rows-only")
        if result["status"] == "ok" and not result["rows"]:
            result["status"] = "ok but empty"
        print(result, flush=True)
    print("not ok:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
