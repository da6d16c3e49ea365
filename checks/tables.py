"""Review tables built by Spark from the TPC-H-like test tables (FIXTURES.md)."""

from __future__ import annotations

import tempfile
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estilens.functions import months as M
from estilens.keys import AREA_SERIES, PART, PERIOD, SELECTION, SERIES, UNIT_GROUP, VIEW
from estilens.operators import estimates as E
from estilens.operators import periods as P
from estilens.operators.catalog import series_structure
from estilens.operators.detail import sample_detail, ui_rollup
from estilens.operators.history import (
    history_slots, history_store, history_subjects, newest_closings, periods_read, shown_months, unfold_history,
)
from estilens.operators.sample import published_values, sample_summary, weighted_sample
from estilens.plans.stages import run_root, staged

BENCHMARK_YEAR = "2000"
# The last year of the test tables.
LAST_YEAR = "2001"


def _pick(value, *results):
    """results[value % n], with a null for None."""
    out = F.lit(None).cast("string")
    for number, result in enumerate(results):
        if result is not None:
            out = F.when(value % len(results) == number, result).otherwise(out)
    return out


class DerivedTables:
    """Every property is a DataFrame over all rows of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def root(self) -> str:
        """A folder of this run for tables that queries write, below the shared one.

        A local session that names no shared folder gets a temporary one.
        """
        context = self.spark.sparkContext
        if not (self.spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) and context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="estilens-"))
        return run_root(self.spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        """A table that several steps read, written once where there is a shared folder."""
        try:
            root = self.root
        except ValueError:
            return rows
        return staged(rows, name, root)

    @cached_property
    def sample(self) -> DataFrame:
        """The reports, added up once: every later step reads them from there."""
        return self.written(self._reports(), "sample")

    def _reports(self) -> DataFrame:
        c = F.col
        closing = F.when((c("l_linenumber") == 7) & (F.year("l_shipdate") < 2000), 4).otherwise((c("l_linenumber") - 1) % 3 + 1)

        def flag_place(returnflag):
            """Where a return flag stands among the two that matter: numbers keep the order of the texts and add up by hash."""
            return F.when(returnflag < "A", 0).when(returnflag == "A", 1).when(returnflag < "R", 2).when(returnflag == "R", 3).when(returnflag > "R", 4)

        lines = self.read("lineitem")
        spread = self.parts(lines, 400_000)
        lines = lines.join(self.read("supplier"), c("l_suppkey") == c("s_suppkey")).select(
            c("s_nationkey").alias("nation"), c("l_linestatus").alias("status"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
            closing.alias("closing"), c("l_suppkey").alias("supp"), flag_place(c("l_returnflag")).alias("place"), "l_quantity",
            F.floor(c("l_extendedprice") / 2000).alias("price"), "l_tax", "l_discount", "l_partkey",
        )
        # A report has few lines: they move as they are, by numbers, in parts that follow their count.
        g = lines.repartition(spread, "supp", "year", "month").groupBy("nation", "status", "year", "month", "closing", "supp").agg(
            F.max("place").alias("rf_max"), F.min("place").alias("rf_min"),
            F.count(F.lit(1)).alias("lines"),
            F.sum("l_quantity").cast("bigint").alias("pm_value"),
            F.sum("price").alias("cm_value"),
            (1 + F.max("l_tax")).alias("sample_weight"),
            (1 - F.max("l_discount") / 2).alias("diff_resp_rate"),
            F.min("l_discount").alias("cont_tot_dwnwght"),
            F.max("l_discount").alias("original_cont_tot_dwnwght"),
            F.max("l_partkey").alias("part_max"), F.min("l_partkey").alias("part_min"),
        )

        def flag(place):
            unused = F.when(c("lines") > 1, "U").otherwise("X")
            return F.when(place == 3, "T").when(place == 1, "A").otherwise(unused)

        state = F.lpad(c("nation").cast("string"), 2, "0")
        texts = {"year": c("year").cast("string"), "month": F.lpad(c("month").cast("string"), 2, "0"), "estimate_type_code": c("closing").cast("string")}
        return g.withColumns(texts).select(
            state.alias("state_fips_code"),
            F.when(c("nation") % 3 == 0, (40000 + c("nation")).cast("string"))
            .otherwise("00000").alias("area_fips_code"),
            F.when(c("status") == "F", "10000000").otherwise("90911000").alias("series_code"),
            F.lit("01").alias("data_type_code"),
            "year", "month", "estimate_type_code",
            M.benchmark_year(c("year"), c("estimate_type_code")).alias("bmrk_year"),
            F.lpad(c("supp").cast("string"), 7, "0").alias("report_id"),
            state.alias("rept_sfc"),
            F.lpad((c("supp") % 2).cast("string"), 10, "0").alias("selected_ui_number"),
            F.lpad((c("supp") % 2).cast("string"), 3, "0").alias("report_with"),
            F.concat((20 + c("part_max") % 5).cast("string"),
                     F.lpad((c("part_max") % 100).cast("string"), 4, "0")).alias("naics_code"),
            (1 + c("supp") % 8).cast("string").alias("selection_size"),
            c("lines").cast("string").alias("version"),
            "sample_weight", "diff_resp_rate", "cont_tot_dwnwght", "original_cont_tot_dwnwght",
            "pm_value", "cm_value",
            flag(c("rf_max")).alias("a_typ_flag"), flag(c("rf_min")).alias("original_a_typ_flag"),
            _pick(c("part_min"), "21", "22", None).alias("pm_comment_1"),
            _pick(c("part_min"), "21", None).alias("pm_comment_2"),
            _pick(c("part_max"), "93", None, "11").alias("cm_comment_1"),
            _pick(c("part_max"), "93", "12", None, None).alias("cm_comment_2"),
        )

    def parts(self, rows: DataFrame, held: int) -> int:
        """How many parts of about so many rows a table read from files makes: what a task holds doesn't grow with the table."""
        return rows.count() // held + 8

    @cached_property
    def months(self) -> DataFrame:
        """The series, periods and benchmark years of the reports, found once: calendars, vintages and newest closings follow from them."""
        return self.written(self.sample.select(*SERIES, *PERIOD, "bmrk_year").distinct(), "months")

    @cached_property
    def weighted(self) -> DataFrame:
        return weighted_sample(self.sample)

    @cached_property
    def estimates(self) -> DataFrame:
        c = F.col
        g = self.sample.groupBy(*AREA_SERIES, *PERIOD, "bmrk_year").agg(
            F.sum("cm_value").alias("c"), F.sum("pm_value").alias("p"), F.count(F.lit(1)).alias("n")
        )
        none = F.lit(None).cast("double")
        nation = c("state_fips_code").cast("int")

        def values(datatype, factor, base, lower, upper, link, adjusted, nse):
            pub = (c("c") * factor).cast("double")
            return F.struct(
                F.lit(datatype).alias("data_type_code"),
                pub.alias("published_estimate_value"),
                (pub - c("n")).alias("recalc_estimate_value"),
                (pub - 2 * c("n") - base).alias("original_estimate_value"),
                lower.alias("lower_tolerance"), upper.alias("upper_tolerance"),
                link.alias("estimate_link_relative"),
                adjusted.alias("sample_adjustment"), nse.alias("non_sample_adjustment"),
            )

        january = F.when(c("month") == "01", 5.0).otherwise(0.0)
        ae = values("01", 10, 3, F.lit(0.8), F.lit(1.2), c("c") / c("p"), c("n") + 0.5, january)
        ess = values("85", 9, 0, none, none, none, c("n").cast("double"), F.lit(0.0))
        kinds = F.when(c("estimate_type_code") == "4", F.array(ae)).otherwise(F.array(ae, ess))
        n = c("n").cast("string")
        comment = _pick(
            c("n"),
            F.concat(F.lit("OT, Amt: "), (c("n") * 100).cast("string"), F.lit(", Type: OTMC  {MS}  removing")),
            F.concat(F.lit("RW, Amt: "), n, F.lit(", adj Y1 weight to unweighted sample coverage of 0.126337 {SR} , This NAICS")),
            F.concat(F.lit("Manual, Amt: -"), n, F.lit(" Adjusted to Y1 link {SM}")),
            None,
        )
        return g.withColumn("v", F.explode(kinds)).select(
            *AREA_SERIES, *PERIOD, "bmrk_year", "v.*", "c", "p", "n",
            _pick(nation, "S", "G", "Q", "D").alias("estimation_type_code"),
            (c("n") * 3.0).alias("birth_death_factor"),
            comment.alias("analyst_comment"),
            _pick(c("n"), "jane.doe@example.org", "ces_sa", None).alias("state_verified_by"),
            _pick(c("p"), "sam-lee@example.org", "CES_SA@example.org").alias("ro_verified_by"),
        )

    @cached_property
    def series_rows(self) -> DataFrame:
        """The unfiltered structure table: one row per series and benchmark year."""
        nation = F.col("state_fips_code").cast("int")
        return self.estimates.select(*SERIES, F.col("bmrk_year").alias("year")).distinct().select(
            *SERIES, "year",
            _pick(nation, "B", "I").alias("series_type_code"),
            _pick(nation, "S", "G", "Q", "D").alias("estimation_type_code"),
            _pick(nation, "Y", "Y", "Y", "N", "Y").alias("is_published"),
            _pick(nation, "1", "0", "2").alias("ws_flag"),
        )

    @cached_property
    def salist(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.read("nation").select(
            F.lpad(n.cast("string"), 2, "0").alias("stid"), F.col("n_name").alias("state"),
            F.when(n % 3 == 0, (40000 + n).cast("string")).otherwise("00000").alias("msa"),
            F.concat(F.col("n_name"), F.lit(" area")).alias("area"),
        )

    @cached_property
    def titles(self) -> DataFrame:
        return (
            self.estimates.filter(F.col("series_code").startswith("1")).select("series_code").distinct()
            .select("series_code", F.concat(F.lit("Series "), F.col("series_code")).alias("series_name"))
        )

    @cached_property
    def structure(self) -> DataFrame:
        return series_structure(self.series_rows, self.salist, self.titles, BENCHMARK_YEAR)

    @cached_property
    def periods(self) -> DataFrame:
        """Every release with closing 1 to 3."""
        return self.months.select(*PERIOD).filter(F.col("estimate_type_code") != "4").distinct()

    def _vintaged(self, rows: DataFrame) -> DataFrame:
        """Each benchmark year is an archive, the last one the current files."""
        return rows.withColumn("vintage", F.when(F.col("bmrk_year") == LAST_YEAR, P.CURRENT).otherwise(F.col("bmrk_year")))

    @cached_property
    def vintaged_estimates(self) -> DataFrame:
        return self._vintaged(self.estimates)

    @cached_property
    def restated_estimates(self) -> DataFrame:
        """All-employee rows stand in two vintages, with another value in the newer one."""
        rows = self.vintaged_estimates.filter((F.col("data_type_code") == "01") & (F.col("vintage") != P.CURRENT))
        later = rows.withColumn("bmrk_year", (F.col("bmrk_year").cast("bigint") + 1).cast("string")).drop("vintage")
        restated = {"published_estimate_value": F.col("published_estimate_value") + 1000, "upper_tolerance": F.col("upper_tolerance") + 0.5}
        return self.vintaged_estimates.unionByName(self._vintaged(later).withColumns(restated))

    def _in_two_vintages(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows by their vintage, and those of archives once more in the vintage after it."""
        rows = self._vintaged(rows)
        later = rows.filter(F.col("vintage") != P.CURRENT).drop("vintage")
        return rows, self._vintaged(later.withColumn("bmrk_year", (F.col("bmrk_year").cast("bigint") + 1).cast("string")))

    @cached_property
    def restated_sample(self) -> DataFrame:
        """Reports stand in two vintages, with another employment in the newer one."""
        rows, later = self._in_two_vintages(self.sample)
        return rows.unionByName(later.withColumn("cm_value", 2 * F.col("cm_value") + 1000))

    @cached_property
    def vintaged_months(self) -> DataFrame:
        return self._vintaged(self.months)

    @cached_property
    def restated_months(self) -> DataFrame:
        """The series and periods of restated_sample."""
        rows, later = self._in_two_vintages(self.months)
        return rows.unionByName(later)

    @cached_property
    def viewed_estimates(self) -> DataFrame:
        return P.as_read(self.restated_estimates, self.release_vintages)

    @cached_property
    def viewed_taken(self) -> DataFrame:
        return self.written(P.taken_periods(P.held_periods(self.restated_months), self.release_vintages), "taken")

    @cached_property
    def viewed_weighted(self) -> DataFrame:
        return P.as_read(weighted_sample(self.restated_sample), self.release_vintages, taken=self.viewed_taken)

    @cached_property
    def viewed_newest(self) -> DataFrame:
        return self.written(newest_closings(P.as_read(self.restated_months, self.release_vintages, taken=self.viewed_taken)), "newest")

    @cached_property
    def viewed_detail(self) -> DataFrame:
        return sample_detail(self.viewed_weighted, P.viewed(self.release_vintages), parts=self.parts(self.sample, 100_000))

    @cached_property
    def viewed_info(self) -> DataFrame:
        return E.review_estimates(self.viewed_estimates, self.structure, P.viewed(self.release_vintages))

    @cached_property
    def release_vintages(self) -> DataFrame:
        """A few rows per release; written, so that Spark knows how few before it plans a join with them."""
        return self.written(P.vintages_needed(self.periods, self.vintaged_months.select("vintage")), "vintages")

    @cached_property
    def panel(self) -> DataFrame:
        raw = E.adjustment_decomposition(E.inherit_tolerance(self.estimates))
        return E.period_panel(raw, self.structure, P.release_requests(self.periods))

    @cached_property
    def info(self) -> DataFrame:
        return E.review_estimates(self.estimates, self.structure, self.periods)

    @cached_property
    def detail(self) -> DataFrame:
        return sample_detail(self.weighted)

    @cached_property
    def units(self) -> DataFrame:
        return ui_rollup(self.detail)

    @cached_property
    def stored_detail(self) -> DataFrame:
        """Detail for queries that read it several times: reports look back once.  Without links, which none of them shows."""
        return self.written(self.detail.drop("history_url", "ui_url", "report_url"), "detail")

    @cached_property
    def stored_units(self) -> DataFrame:
        """Units as far as the order of a shortlist depends on them."""
        return self.written(self.units.select(*SELECTION, *UNIT_GROUP, "report", "wotm", "origflag"), "units")

    @cached_property
    def summary(self) -> DataFrame:
        return sample_summary(self.weighted, published_values(self.info))

    @cached_property
    def vintaged_weighted(self) -> DataFrame:
        return self._vintaged(self.weighted)

    @cached_property
    def history_rows(self) -> DataFrame:
        """The rows that sample histories consist of, stored once."""
        return history_store(self.vintaged_weighted, self.release_vintages, self.months_shown(self.vintaged_months))

    def months_shown(self, months: DataFrame) -> DataFrame:
        return self.written(shown_months(months, self.release_vintages), "shown")

    @cached_property
    def past(self) -> DataFrame:
        """History of all reports, looked at from each release in its vintages."""
        return unfold_history(self.history_rows, self.subjects(self.vintaged_weighted, self.vintaged_months), parts=self.history_parts)

    @cached_property
    def viewed_past(self) -> DataFrame:
        """The same with the view of each release and the part they are dealt out to, by series."""
        subjects = self.subjects(self.vintaged_weighted, self.vintaged_months)
        slots = self.written(history_slots(subjects, self.history_parts), "slots")
        return unfold_history(self.history_rows, subjects, keep_view=True, parts=self.history_parts, slots=slots)

    @cached_property
    def history_parts(self) -> int:
        """One for every 50,000 reports, since what a report unfolds to follows the calendar."""
        return self.parts(self.sample, 50_000)

    def subjects(self, weighted: DataFrame, months: DataFrame) -> DataFrame:
        return history_subjects(weighted, self.release_vintages, self.written(periods_read(months, self.release_vintages), "read"))

    @cached_property
    def small_domain(self) -> DataFrame:
        c, p, n = F.col("c"), F.col("p"), F.col("n")
        return self.estimates.filter(F.col("data_type_code") == "01").select(
            *SERIES, *PERIOD,
            (n / (n + 1)).alias("weight_y1"), (n / (n + 2)).alias("weight_y2"), (n / (n + 3)).alias("weight_y4"),
            (c / p).alias("link_y1"), ((c + n) / p).alias("link_y2"), ((c + 2 * n) / p).alias("link_y4"),
            n.cast("double").alias("bdf_y1"),
        )

    @cached_property
    def model_versions(self) -> DataFrame:
        """The small domain model as it is, and as the one archive has it."""
        rows = self.small_domain
        archive = rows.withColumn("weight_y1", F.col("weight_y1") + 1)
        return rows.withColumn("vintage", F.lit(P.CURRENT)).unionByName(archive.withColumn("vintage", F.lit("archive")))

    @cached_property
    def third_gen(self) -> DataFrame:
        c, p, n = F.col("c"), F.col("p"), F.col("n")
        return self.estimates.select(
            *SERIES, *PERIOD,
            (n / 10).alias("beta"), (c / (p + 1)).alias("y2_m"), (p * 10).cast("double").alias("pm_est"),
            (c / p).alias("y1"), ((c + n) / p).alias("y1_st_adj"), ((c - n) / p).alias("syn"),
            (c / (p + n)).alias("y_hat"),
            (n / (n + 1)).alias("orig_w1"), (n / (n + 2)).alias("orig_w2"), (n / (n + 3)).alias("orig_w3"),
        )

    @cached_property
    def wide_catalog(self) -> DataFrame:
        """A catalog with many areas per state and many series per area."""
        c = F.col
        rows = (
            self.read("lineitem").join(self.read("supplier"), c("l_suppkey") == c("s_suppkey"))
            .join(self.read("part"), c("l_partkey") == c("p_partkey"))
        )
        brand = F.lpad(F.regexp_replace("p_brand", "[^0-9]", ""), 3, "0")
        return rows.select(
            F.lpad(c("s_nationkey").cast("string"), 2, "0").alias("state"),
            F.lpad((c("p_size") * 100).cast("string"), 5, "0").alias("area"),
            F.concat((10 + c("l_partkey") % 35).cast("string"), brand, F.lit("000")).alias("series"),
            F.when(c("p_type") < "M", "B").otherwise("I").alias("seriestype"),
            F.when(c("l_linestatus") == "F", "Y").otherwise("N").alias("toplev"),
            F.when(c("l_returnflag") == "R", "85").otherwise("01").alias("datatype"),
            F.when(c("l_returnflag") == "A", "Y").otherwise("N").alias("oot"),
        ).distinct()

    @cached_property
    def code_requests(self) -> DataFrame:
        """Codes asked for in each area: part keys as text, many of them not offered."""
        c = F.col
        return (
            self.read("lineitem").join(self.read("supplier"), c("l_suppkey") == c("s_suppkey"))
            .join(self.read("part"), c("l_partkey") == c("p_partkey"))
            .select(F.lpad(c("s_nationkey").cast("string"), 2, "0").alias("state"),
                    F.lpad((c("p_size") * 100).cast("string"), 5, "0").alias("area"),
                    F.concat((c("l_orderkey") % 50).cast("string"), (c("l_partkey") % 7).cast("string")).alias("code"))
        )

    @cached_property
    def report_lines(self) -> DataFrame:
        """The teaching sample: reports (parts) under parents (suppliers)."""
        c = F.col
        return self.read("lineitem").select(
            c("l_returnflag").alias("sample_group"),
            F.concat(F.lit("SX"), F.lpad(c("l_suppkey").cast("string"), 6, "0")).alias("parent_report"),
            F.concat(F.lit("CH"), F.lpad(c("l_partkey").cast("string"), 8, "0")).alias("report"),
            F.floor(c("l_extendedprice") / 1000).alias("cm"),
            c("l_quantity").cast("bigint").alias("pm"),
            (F.floor(c("l_extendedprice") / 1000) - c("l_quantity").cast("bigint")).alias("otm"),
        )

    @cached_property
    def two_lines(self) -> DataFrame:
        c = F.col
        return (
            self.read("orders")
            .groupBy(c("o_orderpriority").alias("data_series"),
                     F.year("o_orderdate").cast("bigint").alias("year"),
                     F.month("o_orderdate").cast("bigint").alias("month"))
            .agg(F.sum(F.floor("o_totalprice")).alias("estimate"),
                 F.sum(F.floor(c("o_totalprice") * 0.5)).alias("benchmark"))
        )


class StoredTables(DerivedTables):
    """The same tables with the given ones read back from Parquet, as a
    deployment holds its inputs and the stages it has already written."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored_dir: str):
        super().__init__(spark, sf_dir)
        self.stored_dir = stored_dir

    @classmethod
    def write(cls, spark: SparkSession, sf_dir: str, stored_dir: str) -> "StoredTables":
        tables = cls(spark, sf_dir, stored_dir)
        for name in ("sample", "estimates"):
            tables.store(name)
        return tables

    def store(self, name: str) -> None:
        """Write a table; from now on it is read from there."""
        path = f"{self.stored_dir}/{name}"
        getattr(self, name).write.parquet(path)
        self.__dict__ = {"spark": self.spark, "sf_dir": self.sf_dir, "stored_dir": self.stored_dir,
                         **{k: v for k, v in self.__dict__.items() if k in self._stored_names()},
                         name: self.spark.read.parquet(path)}

    def _stored_names(self) -> set[str]:
        return {p.name for p in Path(self.stored_dir).iterdir()}
