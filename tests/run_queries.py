"""Run registered queries against DuckDB: ``python tests/run_queries.py <sf_dir> [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as e  # noqa: E402
from tests.compare import differences, duck  # noqa: E402
from tests.conftest import make_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark, con = make_session(), duck(sf_dir)
    queries, sql = e.queries(), e.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            found = differences(df, con, sql[name]) if name in sql else []
            note = "" if name in sql else f"(rows only: {df.count()})"
        except Exception as ex:  # noqa: BLE001
            found, note = [f"{type(ex).__name__}: {str(ex)[:1500]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {note} {' | '.join(found)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
