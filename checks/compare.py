"""Run queries and their SQL side by side: python -m checks.compare [sf_dir] [query ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES
from corpuskiln.scratch import use_local_scratch
from corpuskiln.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return frame.sort_values(list(frame.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def differences(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} != {sorted(wanted.columns)}"
    kinds = {c: (got[c].dtype.kind, wanted[c].dtype.kind) for c in got.columns}
    other = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    left, right = ordered(got), ordered(wanted)
    same = (left == right) | (left.isna() & right.isna())
    if not same.all().all():
        rows = ~same.all(axis=1)
        return f"{int(rows.sum())} rows differ: {left[rows].head(2).to_dict('records')} != {right[rows].head(2).to_dict('records')}"[:1500]
    return f"types {other}" if other and len(got) else None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = local_session(8)
    use_local_scratch(spark)
    con = database(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            middle = time.time()
            if name in ORACLE:
                problem = differences(got, con.execute(ORACLE[name]).df())
            else:
                problem = None
        except Exception as error:  # report and go on with the next query
            problem, middle, got = f"{type(error).__name__}: {str(error)[:1500]}", time.time(), []
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(got)} spark={middle - start:.1f}s sql={time.time() - middle:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(main())
