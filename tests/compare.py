"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One comparable form for the values of both engines."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differ(spark_df, con, sql: str) -> str | None:
    got = spark_df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    mine, theirs = rows(spark_df.columns, got), rows(names, want)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; e.g. {mine[:2]} / {theirs[:2]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"columns {sorted(names)}: {a} != {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from stratalith.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = get_session("compare", "8")
    spark.sparkContext.setLogLevel("OFF")
    folder = f"/root/testdata/sf{sf}"
    con, sqls, bad = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls and sf != "0.1":
                problem = differ(df, con, sqls[name])
                note = "ok" if problem is None else f"DIFF {problem[:700]}"
            else:
                df.write.mode("overwrite").format("noop").save()
                note = "ran"
        except Exception as error:  # noqa: BLE001 - a report of every query is wanted
            note = f"FAIL {type(error).__name__} {str(error)[:900]}"
        bad += note.split()[0] in ("DIFF", "FAIL")
        print(f"{name:34s} {time.time() - begin:6.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
