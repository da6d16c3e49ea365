"""Time the review steps over all series: one JSON line on stdout.

The input tables, navigation catalog and code requests among them, are derived
from the test data and written once ("derive").  All steps run over all series and
all releases, but for review_one_series: one release of one series through the
whole review, over tables partitioned by year and month, as the published page
request does.
Each step then runs from Parquet to its last row (a write to the noop sink),
building on the stages before it, which are stored the way a full-size review
stores them.  Every step runs twice in the same session; "queries" has the
second run, "first_run" the first one, which includes compiling the plan.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from checks.registry import QUERIES, SERIES_PROBE
from checks.tables import StoredTables
from estilens.plans.review import ReviewTables, for_each_table, of_series, review
from estilens.session import local_session

# Steps in the order of the published page request, then the rest of a review.
STEPS = (
    "series_history", "estimate_info", "estimate_comparison", "flag_summary", "sign_summary",
    "pm_coverage", "sample_summary", "sample_detail", "ui_rollup", "review_shortlist",
    "history_store", "sample_history", "history_rollup", "month_segments", "what_if_reflag",
    "small_domain_model", "third_gen_model", "series_navigation", "closest_code",
)
# The stage each of these steps leaves behind for the steps after it.
LEAVES = {"estimate_info": "info", "sample_summary": "summary", "sample_detail": "detail",
          "ui_rollup": "units", "history_store": "history_rows", "sample_history": "past"}


def one_series(tables: StoredTables):
    """The review of one series and release over tables split by month."""
    months = {}
    for name in ("estimates", "sample"):
        path = f"{tables.stored_dir}/by_month_{name}"
        rows = getattr(tables, name)
        rows.write.partitionBy("year", "month").parquet(path)
        months[name] = tables.spark.read.schema(rows.schema).parquet(path)
    whole = ReviewTables(months["estimates"], months["sample"], tables.structure, tables.small_domain, tables.third_gen)
    asked = of_series(whole, *SERIES_PROBE.values())

    def run():
        page = review(asked, [("2001", "06", "2")], stage=True)
        for_each_table(page, lambda _, rows: rows.write.format("noop").mode("overwrite").save())
    return run


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"))
    tables = StoredTables(spark, sf_dir, tempfile.mkdtemp(prefix="estilens-bench-"))
    spark.sparkContext.setCheckpointDir(f"{tables.stored_dir}/shared")
    derive = timed(lambda: [tables.store(name) for name in ("sample", "estimates", "structure", "release_vintages", "wide_catalog", "code_requests")])
    first: dict[str, float] = {}
    again: dict[str, float] = {}
    for name in [n for n in names if n in QUERIES] or ([] if names else STEPS):
        def run():
            QUERIES[name](tables).write.format("noop").mode("overwrite").save()
        first[name] = timed(run)
        again[name] = timed(run)
        if name in LEAVES:
            tables.store(LEAVES[name])
    if not names or "review_one_series" in names:
        run = one_series(tables)
        first["review_one_series"], again["review_one_series"] = timed(run), timed(run)
    print(json.dumps({
        "metric": "review_all_series_total",
        "value": round(sum(again.values()), 3),
        "unit": "sec",
        "queries": again,
        "first_run": first,
        "derive": derive,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "releases": tables.periods.count(),
        "rows": {name: getattr(tables, name).count() for name in ("sample", "estimates", "wide_catalog", *(LEAVES[s] for s in names or LEAVES if s in LEAVES))},
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
