"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple((type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in rows)


def compare(spark_df, con, sql) -> list[str]:
    """Differences between a Spark result and a DuckDB result; empty when they agree."""
    got_cols, got = rows_of(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_cols, want = rows_of(names, result.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    problems = []
    if got != want:
        extra, missing = got - want, want - got
        problems.append(f"rows {sum(got.values())} vs {sum(want.values())}; {sum(extra.values())} only in Spark")
        show = lambda c: [tuple(str(v)[:40] for _, v in row) + tuple(t for t, _ in row) for row in sorted(c, key=str)[:2]]
        problems.append(f"  cols {got_cols}\n  spark {show(extra)}\n  sql   {show(missing)}")
    if not got:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from seqtables.catalog import ORACLES, QUERIES
    from seqtables.session import local_session

    scale, wanted = argv[0], argv[1:]
    folder = f"{DATA}/sf{scale}"
    spark = local_session("8")
    con = connect(folder)
    bad = 0
    for name in QUERIES:
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        begin = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problems = compare(df, con, ORACLES[name])
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as failure:  # noqa: BLE001
            problems = [str(failure)[:1500]]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {time.time() - begin:6.1f}s {name}{'' if name in ORACLES else ' (rows)'}", flush=True)
        for problem in problems:
            print("   ", problem, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
