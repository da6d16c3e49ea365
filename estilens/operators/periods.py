"""Release periods: rules, calendar, requests and data vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estilens.functions import months as M
from estilens.keys import PERIOD, REQUEST, VIEW, keyed

# Fixed value: months whose re-estimates straddle two benchmark years.
TWO_VINTAGE_MONTHS = ("10", "11", "12")
CURRENT = "current"


def reference_periods(periods: DataFrame) -> DataFrame:
    """For each release: prior month, year ago, benchmark year, prior closing."""
    year, month, closing = (F.col(c) for c in PERIOD)
    pm_year, pm_month, pm_closing = M.prior_month_release(year, month, closing)
    ya_year, ya_month, ya_closing = M.year_ago_release(year, month, closing)
    return periods.select(
        *keyed(periods, *PERIOD),
        pm_year.alias("pm_y"),
        pm_month.alias("pm"),
        pm_closing.alias("pm_closing"),
        ya_year.alias("p12m_y"),
        ya_month.alias("p12m"),
        ya_closing.alias("p12m_closing"),
        M.benchmark_year(year, closing).alias("bmrkyr"),
        M.earlier_closing(month, closing).alias("prior_closing"),
        M.earlier_benchmark_year(year, closing).alias("prior_closing_bmrkyr"),
    ).distinct()


def release_requests(periods: DataFrame, with_prior_closing: bool = True) -> DataFrame:
    """Estimate rows each requested release needs, one row per role.

    Roles are cm (the release itself, at the asked closing and at the closing
    before it), pm (the month before) and p12m (the year before).  The prior
    month and year ago always follow the asked closing.
    """
    p = reference_periods(periods)
    closings = [F.col("estimate_type_code")]
    if with_prior_closing:
        closings.append(F.col("prior_closing"))
    asked = p.withColumn("this_closing", F.explode(F.array_compact(F.array(*closings))))

    def role(name, year, month, closing):
        return F.struct(
            F.lit(name).alias("role"),
            F.col(year).alias("row_year"),
            F.col(month).alias("row_month"),
            F.col(closing).alias("row_closing"),
        )

    roles = F.explode(F.array(
        role("cm", "year", "month", "this_closing"),
        role("pm", "pm_y", "pm", "pm_closing"),
        role("p12m", "p12m_y", "p12m", "p12m_closing"),
    ))
    return asked.select(
        *keyed(asked),
        F.col("year").alias("sel_year"),
        F.col("month").alias("sel_month"),
        F.col("estimate_type_code").alias("sel_closing"),
        "this_closing",
        "p12m_y",
        roles.alias("r"),
    ).select(*keyed(asked, *REQUEST), "p12m_y", "r.*")


def detail_sources(periods: DataFrame) -> DataFrame:
    """Sample periods behind the report detail of the requested releases."""
    p = reference_periods(periods)

    def source(year, month, closing):
        return F.struct(*[F.col(c).alias(k) for c, k in zip((year, month, closing), PERIOD)])

    return (
        p.select(*keyed(p), F.explode(F.array(
            source(*PERIOD),
            source("pm_y", "pm", "pm_closing"),
            source("year", "month", "prior_closing"),
        )).alias("s"))
        .select(*keyed(p), "s.*")
        .filter(F.col("estimate_type_code").isNotNull())
        .distinct()
    )


def on_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Keep the rows of the given periods.

    Where both have views, rows are kept in the views of their periods.  Spark
    sends the period table to every executor if its measured size allows (as for
    a calendar), which also prunes year and month partitions at run time.
    """
    keys = [c for c in keyed(rows, *PERIOD) if c in periods.columns]
    return rows.join(periods.select(*keys).distinct(), keys, "left_semi")


def near_months(rows: DataFrame, releases: list[tuple[str, str, str]], year_ago: bool = False) -> DataFrame:
    """Keep the months that the listed releases look at: their own, the one
    before and, if asked, the same month a year earlier.

    The condition is made of constants, so Spark drops other year and month
    partitions while planning, before any join runs.
    """
    months: dict[str, set[str]] = {}
    for year, month, _ in releases:
        index = int(year) * 12 + int(month) - 1
        for near in (index, index - 1, *([index - 12] if year_ago else [])):
            months.setdefault(str(near // 12), set()).add(f"{near % 12 + 1:02d}")
    wanted = F.lit(False)
    for year, named in sorted(months.items()):
        wanted |= (F.col("year") == year) & F.col("month").isin(*sorted(named))
    return rows.filter(wanted)


def latest_release(model: DataFrame, probe: dict[str, str]) -> DataFrame:
    """Newest (year, month, closing) of the probe series.

    The year must be the newest in the whole table, so a probe series that
    stopped earlier yields no row.  One pass, one partial aggregate.
    """
    is_probe = F.lit(True)
    for column, value in probe.items():
        is_probe &= F.col(column) == value
    newest = F.max(F.when(is_probe, F.struct(*PERIOD)))
    return (
        model.agg(F.max("year").alias("last_year"), newest.alias("r"))
        .filter(F.col("r.year") == F.col("last_year"))
        .select("r.year", "r.month", F.col("r.estimate_type_code").alias("closing"))
    )


def release_list(estimates: DataFrame, probe: dict[str, str]) -> DataFrame:
    """Distinct releases of one probe series, newest first."""
    rows = estimates.filter(F.col("estimate_type_code").isin("1", "2", "3"))
    for column, value in probe.items():
        rows = rows.filter(F.col(column) == value)
    columns = ("bmrk_year", *PERIOD)
    return rows.select(*columns).distinct().orderBy(*[F.desc_nulls_first(c) for c in columns])


def release_calendar(latest: DataFrame, start_year: int) -> DataFrame:
    """Every valid (year, month, closing) up to the latest release.

    latest is the one-row result of latest_release.  Each row also names the
    months before and after it, the newest closing of its own month, and the
    month's menu label.
    """
    top = latest.select(
        F.col("year").cast("int").alias("max_year"),
        F.col("month").cast("int").alias("max_month"),
        F.col("closing").cast("int").alias("max_closing"),
    )
    rows = (
        top.filter(F.col("max_year") > start_year)
        .withColumn("y", F.explode(F.sequence(F.lit(start_year + 1), "max_year")))
        .withColumn("last", F.when(F.col("y") == F.col("max_year"), F.col("max_month")).otherwise(12))
        .withColumn("m", F.explode(F.sequence(F.lit(1), "last")))
    )
    newest = (
        F.when((F.col("y") == F.col("max_year")) & (F.col("m") == F.col("max_month")), F.col("max_closing"))
        .when((F.col("m") >= 10) & ((F.col("max_closing") == 3) | (F.col("max_month") < 10)), 3)
        .otherwise(2)
    )
    index = F.col("y").cast("bigint") * 12 + F.col("m") - 1
    first = F.lit((start_year + 1) * 12)
    final = F.col("max_year").cast("bigint") * 12 + F.col("max_month") - 1
    before, after = index - 1, index + 1
    # December has no closing 2, so the newest one may fall back to 1.
    default = F.when((F.col("m") == 12) & (F.col("newest") == 2), 1).otherwise(F.col("newest"))
    month = F.lpad(F.col("m").cast("string"), 2, "0")
    return (
        rows.withColumn("newest", newest)
        .withColumn("c", F.explode(F.sequence(F.lit(1), "newest")))
        .filter(~((F.col("m") == 12) & (F.col("c") == 2)))
        .select(
            F.col("y").cast("string").alias("year"),
            month.alias("month"),
            F.col("c").cast("string").alias("closing"),
            F.concat(month, F.lit("-"), M.month_name(month)).alias("month_label"),
            default.cast("string").alias("default_closing"),
            F.when(before >= first, M.index_year(before)).alias("prev_year"),
            F.when(before >= first, M.index_month(before)).alias("prev_month"),
            F.when(after <= final, M.index_year(after)).alias("next_year"),
            F.when(after <= final, M.index_month(after)).alias("next_month"),
        )
    )


def vintages_needed(periods: DataFrame, available: DataFrame) -> DataFrame:
    """Vintages each release is read from, one row each: its benchmark year's
    archive when there is one, else the current files, plus the archive before it
    for re-estimates of October to December.

    available has one column, vintage, with one row per stored vintage.  view names
    the release's vintages together, rank orders them from the newest, and held
    says whether the vintage is stored.
    """
    p = reference_periods(periods.select(*PERIOD))
    straddles = F.col("month").isin(*TWO_VINTAGE_MONTHS) & (F.col("estimate_type_code") == "3")
    stored = available.select(F.col("vintage").alias("archive")).distinct()
    main = F.coalesce("archive", F.lit(CURRENT))
    names = F.array_compact(F.array(main, F.when(straddles, M.years_before(F.col("bmrkyr")))))
    wanted = p.join(stored, F.col("bmrkyr") == F.col("archive"), "left").select(
        *PERIOD, F.array_join(names, "+").alias(VIEW), F.posexplode(names).alias("rank", "vintage")
    )
    return wanted.join(stored, F.col("vintage") == F.col("archive"), "left").select(
        *PERIOD, VIEW, "rank", "vintage", F.col("archive").isNotNull().alias("held")
    )


def require_held(needed: DataFrame) -> None:
    """Fail if a release needs a vintage that is not stored."""
    missing = needed.filter(~F.col("held")).select("vintage").distinct().orderBy("vintage").limit(20).collect()
    if missing:
        raise ValueError(f"vintages not stored: {', '.join(r['vintage'] for r in missing)}")


def viewed(needed: DataFrame) -> DataFrame:
    """The releases with their views."""
    return needed.select(*PERIOD, VIEW).distinct()


def held_periods(facts: DataFrame) -> DataFrame:
    """The periods that each vintage holds: a table to write beside an archive."""
    return facts.select("vintage", *PERIOD).distinct()


def taken_periods(held: DataFrame, needed: DataFrame) -> DataFrame:
    """What a view does not read from its older vintage, since the newer one holds it (held: see held_periods)."""
    views = needed.select(VIEW, "rank", "vintage").distinct()
    two = views.filter("rank > 0").select(VIEW, F.col("rank").alias("older"))
    newer = views.filter("rank = 0").join(two, VIEW).select(VIEW, "vintage", F.col("older").alias("rank"))
    return held.join(newer, "vintage").select(VIEW, "rank", *PERIOD)


def as_read(facts: DataFrame, needed: DataFrame, held: DataFrame | None = None, keep_vintage: bool = False,
            taken: DataFrame | None = None) -> DataFrame:
    """Facts as the releases read them: a row for each view its vintage belongs to.

    facts carries a vintage column (a partition column on disk, so vintages that
    no release needs are pruned).  In a view of two vintages a month and closing
    that both hold is taken from the newer one.  The tables of views and of the
    periods that vintages hold follow the calendar.  With held (held_periods, kept
    beside the facts) the facts are read once; without it their keys are read before.
    With taken (taken_periods, stored) Spark knows the size of what the facts meet and
    need not move them.
    """
    views = needed.select(VIEW, "rank", "vintage").distinct()
    rows = facts.join(views, "vintage")
    if taken is None:
        taken = taken_periods(held_periods(facts) if held is None else held, needed)
    return rows.join(taken, [VIEW, "rank", *PERIOD], "left_anti").drop("rank", *([] if keep_vintage else ["vintage"]))


def _highest_closing(year: Column, month: Column, newest: Column) -> Column:
    """The last closing a month has, given the newest release (year, month, closing)."""
    return (
        F.when((year == newest["year"]) & (month == newest["month"]), newest["closing"])
        .when((month >= "10") & ((newest["closing"] == "3") | (newest["month"] < "10")), "3")
        .otherwise("2")
    )


def _offered_closing(closing: Column, highest: Column, month: Column) -> Column:
    """The closing if the month has it, else its last one; December has no closing 2."""
    skipped = month == "12"
    has = closing.isin("1", "2", "3") & (closing <= highest) & ~(skipped & (closing == "2"))
    return F.when(has, closing).when(skipped & (highest == "2"), "1").otherwise(highest)


def resolve_release(requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """The release shown for each requested year, month and closing, all of them text.

    A month of six digits carries its year.  A month of the newest year that has not
    come yet is the newest month.  An unknown year becomes the newest one; an unknown
    month becomes the newest month there, and December in other years; an unknown
    closing becomes the last one the month has.
    """
    newest = calendar.agg(F.max(F.struct("year", "month", "closing")).alias("n")).select("n").scalar()
    first = calendar.agg(F.min("year").alias("y")).select("y").scalar()
    long = F.length("month") > 2
    asked_year = F.when(long, F.substring("month", 1, 4)).otherwise(F.col("year"))
    asked_month = F.when(long, F.right("month", F.lit(2))).otherwise(F.col("month"))
    rows = requests.select(
        F.col("year").alias("asked_year"), F.col("month").alias("asked_month"), F.col("closing").alias("asked_closing"),
        asked_year.alias("y"), asked_month.alias("m"),
    ).withColumn("m", F.when((F.col("m") > newest["month"]) & (F.col("y") == newest["year"]), newest["month"]).otherwise(F.col("m")))
    known_year = F.col("y").rlike("^[0-9]{4}$") & F.col("y").between(first, newest["year"])
    rows = rows.withColumn("year", F.when(known_year, F.col("y")).otherwise(newest["year"]))
    known_month = F.col("m").rlike("^(0[1-9]|1[0-2])$")
    in_newest = F.when(F.col("year") == newest["year"], newest["month"]).otherwise("12")
    rows = rows.withColumn("month", F.when(known_month, F.col("m")).otherwise(in_newest))
    highest = _highest_closing(F.col("year"), F.col("month"), newest)
    return rows.select(
        "asked_year", "asked_month", "asked_closing", "year", "month",
        _offered_closing(F.col("asked_closing"), highest, F.col("month")).alias("closing"),
    )


def month_choices(latest: DataFrame) -> DataFrame:
    """The twelve months offered for the newest year, newest first; those of the year
    before carry their year in the value."""
    back = F.explode(F.sequence(F.lit(0), F.lit(11)))
    rows = latest.select(M.month_index(F.col("year"), F.col("month")).alias("newest"), "year", back.alias("position"))
    at = F.col("newest") - F.col("position")
    month, year = M.index_month(at), M.index_year(at)
    value = F.when(year == F.col("year"), month).otherwise(F.concat(year, month))
    return rows.select(F.col("position").cast("bigint").alias("position"), value.alias("value"),
                       F.concat(month, F.lit("-"), M.month_name(month)).alias("label"))


def closing_steps(calendar: DataFrame) -> DataFrame:
    """Previous and next closing, and the month and closing to take in the previous
    and next month and year, for each release of the calendar.

    In the newest year a step ends at the newest month.  A calendar holds a few
    hundred rows; its window is keyed by month.
    """
    newest = calendar.agg(F.max(F.struct("year", "month", "closing")).alias("n")).select("n").scalar()
    first = calendar.agg(F.min("year").alias("y")).select("y").scalar()
    by_closing = Window.partitionBy("year", "month").orderBy(F.col("closing").cast("int"))

    def month_newest(side):
        return calendar.select(
            F.col("year").alias(f"{side}_year"), F.col("month").alias(f"{side}_month"),
            F.col("default_closing").alias(f"{side}_month_closing")).distinct()

    steps = calendar.select(
        "year", "month", "closing",
        *[F.col(f"{side}_{part}") for side in ("prev", "next") for part in ("year", "month")],
        F.lag("closing").over(by_closing).alias("prev_closing"),
        F.lead("closing").over(by_closing).alias("next_closing"),
    )
    for side in ("prev", "next"):
        steps = steps.join(month_newest(side), [f"{side}_year", f"{side}_month"], "left")
    steps = steps.drop("prev_year", "prev_month", "next_year", "next_month")
    for side, distance in (("prev", -1), ("next", 1)):
        year = (F.col("year").cast("bigint") + distance).cast("string")
        there = year.between(first, newest["year"])
        later = (year == newest["year"]) & (F.col("month") > newest["month"])
        closing = _offered_closing(F.col("closing"), _highest_closing(year, F.col("month"), newest), F.col("month"))
        steps = steps.withColumns({
            f"{side}_year": F.when(there, year),
            f"{side}_year_month": F.when(there, F.when(later, newest["month"]).otherwise(F.col("month"))),
            f"{side}_year_closing": F.when(there, closing),
        })
    return steps.select(
        "year", "month", "closing", "prev_closing", "next_closing", "prev_month_closing", "next_month_closing",
        *[f"{side}_year{part}" for side in ("prev", "next") for part in ("", "_month", "_closing")],
    )
