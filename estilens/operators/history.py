"""Sample history of the reports and units under review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estilens.functions import months as M
from estilens.functions.sizes import size_bracket
from estilens.keys import PART, PERIOD, SERIES, VIEW, keyed
from estilens.operators import periods as P
from estilens.operators.detail import report_columns

# The release a history is looked at from.
CURRENT = ("cur_year", "cur_month", "cur_closing")


def _subjects(reports: DataFrame) -> DataFrame:
    """What a history is looked up for: report rows of a release, with their flags there."""
    c = F.col
    return reports.select(
        *keyed(reports, *SERIES), c("year").alias("cur_year"), c("month").alias("cur_month"),
        c("estimate_type_code").alias("cur_closing"), "report", c("is_knr").alias("cm_knr"), c("flag").alias("cm_flag"),
    )


def _history_columns() -> list[Column]:
    codes = F.array_join(F.array_compact(F.array("cm_comment_1", "cm_comment_2")), ",")
    return [F.col("version"), *[value.alias(name) for name, value in report_columns().items()], codes.alias("cmcc")]


def newest_closings(weighted: DataFrame) -> DataFrame:
    """The newest closing of each series and month, where it is not the last one.  It has no reports."""
    return (
        weighted.groupBy(*keyed(weighted, *SERIES), "year", "month").agg(F.max("estimate_type_code").alias("estimate_type_code"))
        .filter(F.col("estimate_type_code").isin("1", "2", "3"))
    )


def sample_history(weighted: DataFrame, detail: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """All months of the reports in detail up to their release, at each month's newest closing.

    A report is followed within the view of its release.  Nothing comes from after the release.  The newest closing
    counts closing 4, so months that have reached it drop out.  It comes from an
    aggregate that combines on the map side (one row per series and month) and a
    semi join, which Spark can split where one month is large; no window holds a
    month's reports.  newest is that aggregate (newest_closings), if it is stored: Spark
    then knows its size and need not move the sample to it.
    """
    keys = keyed(weighted, *SERIES)
    month = [*keys, "year", "month"]
    newest = newest_closings(weighted) if newest is None else newest
    c = F.col
    released = M.release_code(c("year"), c("month"), c("estimate_type_code"))
    return (
        weighted.join(newest, [*month, "estimate_type_code"], "left_semi")
        .select(*month, *_history_columns(), released.alias("released"))
        .join(_subjects(detail), [*keys, "report"])
        .filter(c("released") <= M.release_code(c("cur_year"), c("cur_month"), c("cur_closing")))
        .drop("released", *keyed(weighted))
    )


def shown_months(weighted: DataFrame, needed: DataFrame) -> DataFrame:
    """The series and periods that histories show and the views that show them: those in which
    their closing is the newest of its month (a vintage is in three at most).  The table has no reports."""
    keys = [*SERIES, *PERIOD]
    months = weighted.select("vintage", *keys).distinct()
    newest = F.max("estimate_type_code").over(Window.partitionBy(VIEW, *SERIES, "year", "month"))
    return (
        P.as_read(months, needed, keep_vintage=True).withColumn("newest", newest)
        .filter((F.col("estimate_type_code") == F.col("newest")) & (F.col("newest") < "4"))
        .groupBy("vintage", *keys).agg(F.sort_array(F.collect_set(VIEW)).alias("views"))
    )


def history_store(weighted: DataFrame, needed: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """The rows that histories consist of, each stored once whatever the number of releases.

    weighted has a vintage column, needed says which vintages releases read.  A row has
    the views in which its closing is the newest of its month and valid_from, the release
    from which on histories show it.  Views and newest closings are found on the table of
    series and periods (shown_months, which may be given as a stored table: Spark then
    knows its size); the sample itself is read once more, is not multiplied, and meets
    that table once.
    """
    keys = [*SERIES, *PERIOD]
    shown = shown_months(weighted, needed) if shown is None else shown
    released = M.release_code(F.col("year"), F.col("month"), F.col("estimate_type_code"))
    return weighted.join(shown, ["vintage", *keys]).select(
        *SERIES, "year", "month", *_history_columns(), "views", released.alias("valid_from"))


def periods_read(weighted: DataFrame, needed: DataFrame) -> DataFrame:
    """The vintage each release's own reports are read from."""
    views = needed.select(VIEW, "rank", "vintage", *PERIOD)
    # A period that both vintages of its view hold is read from the newer one.
    held = P.held_periods(weighted).join(views, ["vintage", *PERIOD])
    return held.groupBy(VIEW, *PERIOD).agg(F.min_by("vintage", "rank").alias("vintage"))


def history_subjects(weighted: DataFrame, needed: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """The reports of every release, in the release's vintages: what sample_detail would
    show of them, without looking back.  read is periods_read, if it is stored."""
    first = periods_read(weighted, needed) if read is None else read
    columns = report_columns()
    rows = weighted.join(first, ["vintage", *PERIOD]).select(
        VIEW, *SERIES, *PERIOD, *[columns[c].alias(c) for c in ("report", "is_knr", "flag", "pm", "cm")])
    return rows.filter(size_bracket(F.col("pm")).isNotNull() & size_bracket(F.col("cm")).isNotNull())


def _slot(parts: int) -> Column:
    return F.pmod(F.xxhash64(VIEW, *SERIES), F.lit(parts)).alias("slot")


def history_slots(reports: DataFrame, parts: int) -> DataFrame:
    """How to deal histories out in parts of about as many reports each, the reports of a series in as few as hold them.

    A view and series has a slot, one of as many as there are parts; a row here says how many
    reports the slot has and how many the slots before.  The table has no reports and at most parts rows.
    """
    counts = reports.groupBy(_slot(parts)).agg(F.count(F.lit(1)).alias("held"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        "slot", "held", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(ends).alias("total"))


def _in_parts(rows: DataFrame, slots: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out by their slot and, inside it, by report.  Rows of slots without reports have no history."""
    place = F.col("before") + F.pmod(F.xxhash64("report"), F.col("held"))
    part = F.floor(place * parts / F.col("total")).cast("int")
    met = rows.withColumn("slot", _slot(parts)).join(F.broadcast(slots), "slot")  # at most parts rows
    return met.withColumn(PART, part).drop(*slots.columns).repartitionById(parts, F.col(PART))


def unfold_history(
    store: DataFrame, reports: DataFrame, keep_view: bool = False, parts: int | None = None, slots: DataFrame | None = None,
) -> DataFrame:
    """The history of each report row (of sample_detail or history_subjects, with its
    view) out of the stored rows: those of its view that are valid at its release.

    The join deals out both sides by view, series and report.  With keep_view histories
    carry the view, and steps that go on by report (history_rollup and month_segments of
    "detail") move no unfolded row.  They sort what a part unfolds to, many times what it
    reads: parts says how many to make, if not as many as Spark would by what it reads.
    With slots (history_slots of the reports and parts) a part has the reports of few
    series, so that units add up there before they move; kept rows carry their part too.
    """
    found_by = [VIEW, *SERIES, "report"]
    by = ["report", VIEW, *SERIES]  # reports differ soonest, which makes the sort of the join cheap
    # A number for the release, since the join compares every two rows it matches.
    subjects = _subjects(reports).withColumn("at", M.release_code(F.col("cur_year"), F.col("cur_month"), F.col("cur_closing")))
    rows = store.withColumn(VIEW, F.explode("views")).drop("views")
    if slots is not None:
        subjects, rows, by = _in_parts(subjects, slots, parts), _in_parts(rows, slots, parts), [*by, PART]
    elif parts is not None:
        subjects, rows = subjects.repartition(parts, *by), rows.repartition(parts, *by)
    out = rows.join(subjects, by).filter(F.col("valid_from") <= F.col("at")).drop("valid_from", "at")
    out = out.select(*found_by, *[c for c in out.columns if c not in found_by])
    return out if keep_view else out.drop(VIEW, PART)


def history_colour(flag: Column, downweight: Column) -> Column:
    return (
        F.when(flag == "X", "black")
        .when(flag == "A", "red")
        .when(downweight.between(0.3, 0.4), "orange")
        .otherwise("blue")
    )


def _history_keys(row_type: str) -> list[str]:
    """What one history page is about: a unit under a flag, or one report."""
    subject = ["cm_flag", "cm_knr"] if row_type == "summary" else ["report"]
    return [*SERIES, *CURRENT, "reptstate", "ui", *subject]


def history_rollup(history: DataFrame, row_type: str) -> DataFrame:
    """History added up by month for unit rows ("summary") or single reports.

    Sums are exact decimals.  Text fields and the colour are those of the first report.  The
    reports behind a row are in history_members, one row each, so a unit may
    have any number of them.  A view stays with its rows.  Where rows are dealt out by
    series, units add up in their part first and then move once, by their history.

    Texts make Spark sort what it adds up; a hash before the keys decides most comparisons.
    """
    subject = keyed(history, *_history_keys(row_type))
    keys = [*subject, "is_knr", "year", "month"]
    sums = {
        name: F.sum(F.col(name).cast("decimal(38,3)")).cast("decimal(38,3)")
        for name in ("pm", "cm", "otm", "wotm")
    }
    texts = ("reptw", "naics", "version", "selsize", "origflag", "flag", "cmcc", "weight", "origdwght", "dwght")
    first = F.min(F.struct(F.col("report").alias("first_report"),
                           *[F.col(t).cast("string").alias(t) for t in texts],
                           history_colour(F.col("flag"), F.col("dwght")).alias("colour")))
    added = history.groupBy(F.xxhash64(*keys).alias("spread"), *keys).agg(
        first.alias("f"),
        *[value.alias(name) for name, value in sums.items()],
        F.count(F.lit(1)).alias("report_rows"),
    )
    if row_type == "summary" and PART in keys:
        subject, keys = ([c for c in columns if c != PART] for columns in (subject, keys))
        added = added.repartition(*subject).groupBy(F.xxhash64(*keys).alias("spread"), *keys).agg(
            F.min("f").alias("f"), *[F.sum(name).alias(name) for name in sums], F.sum("report_rows").alias("report_rows"))
    return added.select(*keys, "f.*", *sums, "report_rows")


def history_members(history: DataFrame, row_type: str) -> DataFrame:
    """The reports behind each history row and their colour."""
    keys = [*_history_keys(row_type), "is_knr", "year", "month"]
    extra = [c for c in ("report",) if c not in keys]
    return history.select(*keys, *extra, history_colour(F.col("flag"), F.col("dwght")).alias("colour"))


def month_segments(rollup: DataFrame, row_type: str) -> DataFrame:
    """Line segments from prior month to month, on an axis without gaps.

    Every month between the first and last point of a history gets a row;
    months no segment touches have null points.  Rows with a missing or zero
    end are no segment.  A month's point brings the empty months up to the next
    row's prior month with it, so points are computed once; the window holds one
    history's rows, before each is split into its two ends.
    """
    keys = keyed(rollup, *_history_keys(row_type))
    pm, cm = F.col("pm").cast("double"), F.col("cm").cast("double")
    index = M.month_index(F.col("year").try_cast("bigint"), F.col("month").try_cast("bigint"))
    none = F.lit(None).cast("bigint")
    ends = F.explode(F.array(
        F.struct((F.col("at") - 1).alias("axis"), pm.alias("value"), F.lit("pm").alias("end"), none.alias("following")),
        F.struct(F.col("at").alias("axis"), cm.alias("value"), F.lit("cm").alias("end"), (F.col("next") - 1).alias("following")),
    ))
    label = F.concat(M.month_name(F.col("month")), F.lit("'"), M.short_year(F.col("year")))
    following = F.lead("at").over(Window.partitionBy(F.xxhash64(*keys), *keys).orderBy("at", "is_knr"))
    points = (
        rollup.filter(F.col("month").try_cast("int").between(1, 12) & (pm != 0) & (cm != 0))
        .withColumns({"at": index, "segment": label})
        .select(*keys, "is_knr", "segment", "colour", "pm", "cm", "at")
        .withColumn("next", following)
        .select(*keys, "is_knr", "segment", "colour", ends.alias("e"))
        .select(*keys, "is_knr", "segment", "colour", *[F.col(f"e.{c}").alias(c) for c in ("axis", "value", "end", "following")])
    )
    own = F.col("place") == F.col("axis")
    places = F.when(F.col("following") > F.col("axis") + 1, F.sequence("axis", F.col("following") - 1)).otherwise(F.array("axis"))
    month, year = M.index_month(F.col("place")), M.index_year(F.col("place"))
    return points.withColumn("place", F.explode(places)).select(
        *keys, year.alias("axis_year"), month.alias("axis_month"),
        F.concat(M.month_name(month), F.lit(" "), year).alias("axis_label"),
        *[F.when(own, F.col(c)).alias(n) for c, n in (
            ("segment", "segment"), ("is_knr", "is_knr"), ("end", "segment_end"), ("value", "value"), ("colour", "colour"))],
    )
