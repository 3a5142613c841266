"""Run queries against their SQL from the command line: run_catalog.py SF_DIR [name...]"""

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from corpus_spark.session import local_session  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")})
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = differences(df, con, sqls[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += problem is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
