"""Run queries of the catalog against their oracles: ``python -m tests.check_oracles FOLDER [NAME..]``."""

from __future__ import annotations

import sys
import time

from oracles import ORACLES
from tests.compare import connect, differences
from tests.session import local_session
from triplens.plans.catalog import QUERIES


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            n, bad = differences(QUERIES[name](spark, folder), con, ORACLES[name])
        except Exception as e:  # noqa: BLE001
            n, bad = 0, [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(bad)
        state = "differs" if bad else "same"
        print(f"{name:32} {state:8} rows={n} {time.time() - start:.1f}s", *bad[:2], sep="\n   " if bad else "  ")
    print(f"{len(names) - failed} of {len(names)} the same; without oracle: {sorted(set(QUERIES) - set(ORACLES))}")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
