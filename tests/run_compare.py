"""Compare all registered queries with their SQL: ``python tests/run_compare.py [folder]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import SECONDS, connect, differences  # noqa: E402

from soundrows.queries import ORACLES, QUERIES  # noqa: E402
from soundrows.session import build_session  # noqa: E402


def main(folder="/root/testdata/sf0.01", *names):
    spark = build_session("compare", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name, function in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = differences(spark, connection, name, function, ORACLES[name], folder)
            else:
                problem = None
                print(f"     {name}: {function(spark, folder).count()} rows, no SQL")
        except Exception as error:
            problem = f"{name}: {type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print("ok  " if problem is None else "BAD ", f"{time.time() - start:6.2f}s", f"spark {SECONDS.get(name, 0):6.2f}s",
              name if problem is None else problem, flush=True)
    print(f"{bad} bad of {len(names or QUERIES)}")


if __name__ == "__main__":
    main(*sys.argv[1:])
