"""The complete review, for all series of the requested releases or for one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from estilens.keys import AREA_SERIES, PERIOD, VIEW
from estilens.operators import catalog, detail, estimates, models, periods, sample, whatif
from estilens.operators import history as sample_histories
from estilens.plans.stages import run_root, staged


@dataclass(frozen=True)
class ReviewTables:
    """Inputs of a review.  Estimates and sample may hold any number of months.

    With a vintage column (archive years and "current") each release is read from
    its own vintages.  Models then have one too, "archive" or "current".
    """

    estimates: DataFrame
    matched_sample: DataFrame
    structure: DataFrame
    small_domain: DataFrame | None = None
    third_gen: DataFrame | None = None


def of_series(tables: ReviewTables, state: str, area: str, series: str) -> ReviewTables:
    """The same inputs for one series; the filters reach every scan."""
    wanted = dict(zip(AREA_SERIES, (state, area, series)))

    def pick(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else catalog.select_rows(rows, wanted)

    return ReviewTables(*[pick(getattr(tables, f)) for f in tables.__dataclass_fields__])


def review(tables: ReviewTables, releases: list[tuple[str, str, str]], k: int = 31, link_base: str = "",
           stage: bool = False, jobs: int = 3) -> dict[str, DataFrame]:
    """Every table of the review page for the given (year, month, closing) releases.

    Histories have one part per release and end with it.  With stage, the tables
    that several others build on (estimate info, series history, sample summary, report
    detail and unit rollup) are written once to a folder of this run below the shared
    one, instead of being computed again for each of them, those that do not need each
    other at the same time; that is the setting for full-size runs and for pages.
    """
    spark = tables.estimates.sparkSession
    root = run_root(spark) if stage else None

    def keep(rows: DataFrame, name: str) -> DataFrame:
        return staged(rows, name, root) if stage else rows

    requested = release_table(spark, releases)
    all_estimates, matched, model_of = tables.estimates, tables.matched_sample, None
    if "vintage" in all_estimates.columns:
        needed = periods.vintages_needed(requested, all_estimates.select("vintage").distinct())
        periods.require_held(needed)
        held = matched.select("vintage").distinct().withColumn("in_sample", F.lit(True))
        periods.require_held(needed.join(held, "vintage", "left").withColumn("held", F.coalesce("in_sample", F.lit(False))))
        requested = periods.viewed(needed)
        all_estimates, matched = periods.as_read(all_estimates, needed), periods.as_read(matched, needed)
        model_of = needed

    recent = periods.near_months(all_estimates, releases, year_ago=True)
    weighted = sample.weighted_sample(matched)
    recent_sample = periods.near_months(weighted, releases)
    needed_sample = periods.on_periods(recent_sample, periods.detail_sources(requested))
    info, reports, history = together([
        lambda: keep(estimates.review_estimates(recent, tables.structure, requested), "info"),
        lambda: keep(detail.sample_detail(recent_sample, requested, link_base), "detail"),
        lambda: keep(estimates.series_history(all_estimates, releases=requested), "history"),
    ], jobs)
    published = sample.published_values(info)
    summary, units = together([
        lambda: keep(periods.on_periods(sample.sample_summary(needed_sample, published), requested), "summary"),
        lambda: keep(detail.ui_rollup(reports, link_base), "units"),
    ], jobs)
    past = sample_histories.sample_history(weighted, reports)

    def models_of(rows: DataFrame) -> DataFrame:
        return rows if model_of is None else models.of_vintage(rows, model_of)

    result = {
        "series_info": estimates.series_info(info, link_base),
        "estimate_comparison": estimates.estimate_comparison(info),
        "sample_summary": summary,
        "sample_link": sample.sample_link(summary),
        "sample_detail": detail.review_flags(reports),
        "sample_detail_by_ui": detail.review_shortlist(units, k),
        "estimate_inputs": whatif.estimate_inputs(summary, info),
        "series_history": history,
        "line_split": estimates.line_split(history),
        "history_matrix": estimates.history_matrix(history),
        "sample_history": past,
    }
    if tables.small_domain is not None:
        result["small_domain_model"] = models.small_domain_model(models_of(tables.small_domain), info)
    if tables.third_gen is not None:
        result["third_gen_model"] = models.third_gen_model(models_of(tables.third_gen), info)
    return {name: rows.drop(VIEW) for name, rows in result.items()}


# The columns that hold the release, as results name them.
_RELEASE_COLUMNS = (("sel_year", "sel_month", "sel_closing"), ("cur_year", "cur_month", "cur_closing"), PERIOD)
_MANIFEST = "_manifest"


def _release_columns(rows: DataFrame) -> tuple[str, ...]:
    return next(columns for columns in _RELEASE_COLUMNS if set(columns) <= set(rows.columns))


def write_review(result: dict[str, DataFrame], root: str, releases: list[tuple[str, str, str]]) -> str:
    """Write every table of a review below root and return the name of the run.

    A run writes folders of its own (<table>/run=<name>, split by release), and at the
    end one file in the manifest that says which releases it holds.  Readers follow
    the manifest, so a run that dies changes nothing for them, can be repeated, and a
    later run of a release replaces exactly that release in all tables at once.
    """
    run = uuid.uuid4().hex

    def write(name: str, rows: DataFrame) -> None:
        # With a letter in front, so that readers take it for text.
        release = F.concat_ws("_", F.lit("r"), *[F.col(c) for c in _release_columns(rows)])
        # Few files per release; a large release is split over several tasks.
        rows.withColumn("release", release).hint("rebalance", "release").write.partitionBy("release").parquet(f"{root}/{name}/run={run}")

    for_each_table(result, write)
    spark = next(iter(result.values())).sparkSession
    schemas = F.create_map(*[F.lit(x) for name, rows in result.items() for x in (name, rows.schema.json())])
    written = release_table(spark, releases).withColumns({"run": F.lit(run), "written": F.current_timestamp(), "schemas": schemas})
    written.coalesce(1).write.mode("append").parquet(f"{root}/{_MANIFEST}")
    return run


def current_runs(spark: SparkSession, root: str, table: str) -> list[tuple[str, str, list[str]]]:
    """(run, schema, releases) for the runs that hold a table, by the manifest: of
    several runs of a release the last one counts."""
    rows = spark.read.parquet(f"{root}/{_MANIFEST}")
    last = rows.groupBy(*PERIOD).agg(F.max_by(F.struct("run", F.col("schemas")[table].alias("schema")), F.struct("written", "run")).alias("m"))
    release = F.concat_ws("_", F.lit("r"), *PERIOD)
    held = last.filter("m.schema IS NOT NULL").groupBy("m.run", "m.schema").agg(F.sort_array(F.collect_list(release)).alias("releases"))
    return [tuple(r) for r in held.orderBy("run").collect()]  # a row per run, a name per release


def read_review(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the written review: every release from its last complete run.

    Runs and releases are chosen by constants, so other partitions are not read.
    """
    parts = []
    for run, schema, releases in current_runs(spark, root, name):
        stored = StructType([*StructType.fromJson(json.loads(schema)).fields, StructField("release", StringType())])
        rows = spark.read.schema(stored).parquet(f"{root}/{name}/run={run}")
        parts.append(rows.filter(F.col("release").isin(*releases)).drop("release"))
    if not parts:
        raise ValueError(f"no complete run holds {name}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def together(actions: list[Callable], jobs: int) -> list:
    """The results of some actions, of which so many run at a time.

    Each runs in a thread of its own, so that its jobs are planned and scheduled beside
    those of the others; under a fair scheduler (spark.scheduler.mode) they share the
    executors.
    """
    with ThreadPoolExecutor(max(jobs, 1)) as pool:
        return [f.result() for f in [pool.submit(action) for action in actions]]


def for_each_table(result: dict[str, DataFrame], action: Callable[[str, DataFrame], object], jobs: int = 8) -> dict:
    """What an action gives for every table of a review, several of them at a time."""
    names = list(result)
    return dict(zip(names, together([partial(action, name, result[name]) for name in names], jobs)))


def release_table(spark: SparkSession, releases: list[tuple[str, str, str]]) -> DataFrame:
    """The releases as a small table for the operators."""
    return spark.createDataFrame(releases, ", ".join(f"{c} string" for c in PERIOD))
