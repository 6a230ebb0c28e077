"""Compare every registered query with its SQL oracle; also a small command line."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(str(_norm(r[i])) for i in order) for r in rows]), [names[i] for i in order]


def compare(spark_df, con, sql) -> str:
    """Empty text when both sides agree."""
    mine, my_names = rows_of(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    cur = con.execute(sql)
    theirs, their_names = rows_of([c[0] for c in cur.description], cur.fetchall())
    if my_names != their_names:
        return f"columns differ: {my_names} / {their_names}"
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} / {len(theirs)}"
    if not mine:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first: {bad[0][0]} / {bad[0][1]} [{my_names}]"
    return ""


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tidemark.session import local_session
    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
            pairs = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
            if pairs:
                print(f"PLAN {name} {pairs}", flush=True)
            if name in oracles:
                note = compare(df, con, oracles[name])
                kind = "ok  " if not note else "FAIL"
            else:
                n = len(df.collect())
                note, kind = f"rows={n}", "rows"
        except Exception as exc:  # noqa: BLE001 - report and go on
            note, kind = f"{type(exc).__name__}: {str(exc)[:900]}", "FAIL"
        failed += kind == "FAIL"
        print(f"{kind} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
