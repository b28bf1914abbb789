"""Run queries of the subpackage against their SQL: ``python -m tests.llm.check FOLDER [NAME..]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from tests.compare import differences
from tests.session import local_session
from triplens.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(files):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        df = QUERIES[name](spark, folder)
        if name not in ORACLES:
            print(name, "no oracle", df.count(), f"{time.time() - start:.1f}s")
            continue
        n, bad = differences(df, con, ORACLES[name])
        failed += bool(bad)
        print(name, "differs" if bad else "same", n, f"{time.time() - start:.1f}s", *bad[:3], sep="\n  " if bad else "  ")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
