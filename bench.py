"""Time the headline queries and the load steps; print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Every query is
run to completion without collecting its rows, three times, and counts with
its median. A warm-up run of each is left out.
"""

import json
import os
import statistics
import tempfile
import time

from tendergrid import catalog, session
from tendergrid.operators import transform
from tendergrid.plans import marts
from tendergrid.sources import lake, order_tables, pages

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "kpi",
    "stats_overview",
    "top_contractors",
    "by_locality",
    "modalities",
    "entity_list",
    "supplier_list",
    "yearly_totals",
    "contracts_page",
    "filter_combined",
    "lookup_contract",
    "recent_contracts_all",
    "entity_top_suppliers",
    "risk_contracts",
    "mart_entidades",
    "mart_proveedores",
    "mart_temporal",
    "mart_modalidades",
    "bronze_to_silver",
    "merge_silver",
    "latest_versions",
    "quality_rules",
]


def drain(rows):
    rows.write.format("noop").mode("overwrite").save()


def timed(action):
    action()
    seconds = []
    for _ in range(RUNS):
        started = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - started)
    return round(statistics.median(seconds), 3)


def main():
    spark = session.local_session(cores=CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {
        name: timed(lambda name=name: drain(catalog.QUERIES[name](spark, FOLDER)))
        for name in HEADLINE
    }

    # The steps of a full load over stored data, the way they follow each other.
    scratch = tempfile.TemporaryDirectory(prefix="tendergrid-bench-")
    landing, root = (f"{scratch.name}/{n}" for n in ("raw", "lake"))
    files = pages.write_pages(order_tables.page_rows(spark, FOLDER), landing, page_rows=10_000)
    steps = {
        "load_pages_to_silver": lambda: lake.silver_write(
            transform.bronze_to_silver(pages.read_pages(spark, landing, files)), root, replace=True
        ),
        "load_silver_to_gold": lambda: lake.gold_write_full(lake.silver_scan(spark, root), root),
        "load_build_marts": lambda: marts.build_marts(lake.gold_scan(spark, root), root),
    }
    times |= {name: timed(step) for name, step in steps.items()}
    rows = sum(lake.year_counts(spark, root).values())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "contracts": rows,
                "rows_per_second": {name: round(rows / times[name]) for name in steps},
            }
        )
    )


if __name__ == "__main__":
    main()
