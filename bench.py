"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the best time counts.
Every run plans anew and computes its whole result.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

NAMES = [
    "flagship", "scan_full", "point_lookup", "range_scan", "indexed_eq", "covering_agg", "index_intersection", "index_union_or", "filter_range",
    "join_inner", "join_left", "join_cross", "join_multi", "semi_exists", "group_multi", "group_bare_column", "count_distinct", "order_multi",
    "topk", "topk_per_group", "win_row_number", "distinct_multi", "union_all", "union", "intersect", "cte", "correlated_scalar", "dml_insert_select",
]

def timed(run) -> float:
    best = float("inf")
    for i in range(RUNS + 1):
        start = time.perf_counter()
        run()
        if i:
            best = min(best, time.perf_counter() - start)
    return round(best, 4)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from lakeweave.database import Database
    from lakeweave.queries import QUERIES
    from lakeweave.session import build_session

    shared = tempfile.mkdtemp(prefix="lakeweave-bench-")
    spark = build_session("bench", f"local[{CPUS}]", CPUS, {"spark.checkpoint.dir": shared, "spark.driver.memory": "8g", "spark.sql.warehouse.dir": f"{shared}/warehouse"})
    found: dict[str, float] = {}
    for name in NAMES:
        found[name] = timed(lambda name=name: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    db = Database(spark, f"{shared}/db")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    at = iter(range(0, 1 << 40, 10_000))

    def insert() -> None:
        low = next(at)
        db.execute(f"INSERT INTO t SELECT value, 'row ' || value FROM generate_series({low}, {low + 9_999})")

    found["insert_10k_rows"] = timed(insert)
    sf = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
