"""Run every (or the named) query against its SQL: run_oracle.py FOLDER [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from locale_lake.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, sql = contract.queries(), contract.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            if name in sql:
                verdict = compare(queries[name](spark, folder), connection, sql[name]) or "ok"
            else:
                verdict = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as error:  # report and go on
            verdict = f"ERROR {str(error)[:1500]}"
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict[:1800]}", flush=True)
