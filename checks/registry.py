"""Every review operator as a query over the derived tables, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from checks import sql as S
from checks.tables import LAST_YEAR, DerivedTables
from estilens.functions import codes as C
from estilens.functions.sizes import SIZE_BRACKETS, size_bracket, size_gap
from estilens.keys import PART, PERIOD, SELECTION, SERIES, UNIT_GROUP, VIEW
from estilens.operators import basic, catalog, detail, estimates, history, intervals, models, navigation, periods, ranks, sample, whatif
from estilens.plans.review import read_review, write_review
from estilens.sources import readers

QUERIES: dict[str, Callable[[DerivedTables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SERIES_PROBE = {"state_fips_code": "12", "area_fips_code": "40012", "series_code": "10000000"}


def query(oracle: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = S.query(oracle)
        return build
    return register


# --- periods -----------------------------------------------------------------

_PROBE = "state_fips_code = '12' AND area_fips_code = '40012' AND series_code = '10000000'"
_LATEST = f"""SELECT year, month, estimate_type_code AS closing FROM fx_estimates
  WHERE {_PROBE} AND year = (SELECT max(year) FROM fx_estimates) ORDER BY ALL DESC LIMIT 1"""


@query(_LATEST)
def latest_release(t):
    return periods.latest_release(t.estimates, SERIES_PROBE)


@query(f"""SELECT DISTINCT bmrk_year, {S.PER} FROM fx_estimates
  WHERE {_PROBE} AND data_type_code = '01' AND estimate_type_code IN ('1', '2', '3')""")
def release_list(t):
    return periods.release_list(t.estimates, {**SERIES_PROBE, "data_type_code": "01"})


@query("SELECT * FROM reference_periods")
def reference_periods(t):
    return periods.reference_periods(t.periods)


_CALENDAR = f"""
  SELECT y::VARCHAR AS year, lpad(m::VARCHAR, 2, '0') AS month, c::VARCHAR AS closing,
    lpad(m::VARCHAR, 2, '0') || '-' || {S.MONTH_NAME.format('m')} AS month_label,
    CASE WHEN m = 12 AND newest = 2 THEN 1 ELSE newest END::VARCHAR AS default_closing,
    CASE WHEN m > 1 THEN y::VARCHAR WHEN y > 1996 THEN (y - 1)::VARCHAR END AS prev_year,
    CASE WHEN m > 1 THEN lpad((m - 1)::VARCHAR, 2, '0') WHEN y > 1996 THEN '12' END AS prev_month,
    CASE WHEN y = my AND m = mm THEN NULL WHEN m = 12 THEN (y + 1)::VARCHAR ELSE y::VARCHAR END AS next_year,
    CASE WHEN y = my AND m = mm THEN NULL WHEN m = 12 THEN '01' ELSE lpad((m + 1)::VARCHAR, 2, '0') END AS next_month
  FROM (SELECT *, CASE WHEN y = my AND m = mm THEN mc WHEN m >= 10 AND (mc = 3 OR mm < 10) THEN 3 ELSE 2 END AS newest
    FROM (SELECT year::INT AS my, month::INT AS mm, closing::INT AS mc FROM ({_LATEST}))
    JOIN range(1996, 2100) r(y) ON y <= my JOIN range(1, 13) s(m) ON y < my OR m <= mm)
  JOIN range(1, 4) k(c) ON c <= newest AND NOT (m = 12 AND c = 2)"""


@query(_CALENDAR)
def release_calendar(t):
    return periods.release_calendar(latest_release(t), 1995)


_TOP = "top AS (SELECT my, mm, mc FROM (SELECT year AS my, month AS mm, closing AS mc FROM cal) ORDER BY my DESC, mm DESC, mc DESC LIMIT 1)"


def _offered(closing: str, year: str, month: str) -> str:
    """A closing if the month has it, else its last one."""
    rangec = f"CASE WHEN {year} = my AND {month} = mm THEN mc WHEN {month} IN ('10', '11', '12') AND (mc = '3' OR mm < '10') THEN '3' ELSE '2' END"
    options = f"list_filter(['3', '2', '1'], lambda o: o <= {rangec} AND NOT (o = '2' AND {month} = '12'))"
    return f"CASE WHEN list_contains({options}, {closing}) THEN {closing} ELSE {options}[1] END"


@query(f"""
  WITH cal AS ({_CALENDAR.strip()}), {_TOP},
    ym AS (SELECT year, month, max(default_closing) AS d FROM cal GROUP BY ALL),
    years AS (SELECT DISTINCT year FROM cal)
  SELECT c.year, c.month, c.closing,
    (SELECT max(closing) FROM cal x WHERE x.year = c.year AND x.month = c.month AND x.closing < c.closing) AS prev_closing,
    (SELECT min(closing) FROM cal x WHERE x.year = c.year AND x.month = c.month AND x.closing > c.closing) AS next_closing,
    pm.d AS prev_month_closing, nm.d AS next_month_closing,
    p.year AS prev_year, CASE WHEN p.year = my AND c.month > mm THEN mm WHEN p.year IS NOT NULL THEN c.month END AS prev_year_month,
    CASE WHEN p.year IS NOT NULL THEN {_offered('c.closing', 'p.year', 'c.month')} END AS prev_year_closing,
    n.year AS next_year, CASE WHEN n.year = my AND c.month > mm THEN mm WHEN n.year IS NOT NULL THEN c.month END AS next_year_month,
    CASE WHEN n.year IS NOT NULL THEN {_offered('c.closing', 'n.year', 'c.month')} END AS next_year_closing
  FROM cal c CROSS JOIN top LEFT JOIN years p ON p.year::INT = c.year::INT - 1 LEFT JOIN years n ON n.year::INT = c.year::INT + 1
    LEFT JOIN ym pm ON pm.year = c.prev_year AND pm.month = c.prev_month
    LEFT JOIN ym nm ON nm.year = c.next_year AND nm.month = c.next_month""")
def closing_steps(t):
    return periods.closing_steps(release_calendar(t))


_ASKED_DATES = """SELECT DISTINCT CASE o_orderkey % 7 WHEN 0 THEN '1990' WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE year(o_orderdate)::VARCHAR END AS year,
    CASE o_orderkey % 11 WHEN 0 THEN '13' WHEN 1 THEN NULL WHEN 2 THEN year(o_orderdate)::VARCHAR || lpad(month(o_orderdate)::VARCHAR, 2, '0')
      WHEN 3 THEN '' ELSE lpad(month(o_orderdate)::VARCHAR, 2, '0') END AS month,
    CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE (o_orderkey % 5)::VARCHAR END AS closing FROM orders"""


@query(f"""
  WITH cal AS ({_CALENDAR.strip()}), {_TOP}, asked AS ({_ASKED_DATES}), a AS (
    SELECT *, CASE WHEN length(month) > 2 THEN left(month, 4) ELSE year END AS y, CASE WHEN length(month) > 2 THEN right(month, 2) ELSE month END AS m FROM asked),
  b AS (SELECT * REPLACE (CASE WHEN m > mm AND y = my THEN mm ELSE m END AS m) FROM a CROSS JOIN top),
  c AS (SELECT *, CASE WHEN y IN (SELECT year FROM cal) THEN y ELSE my END AS ry FROM b),
  d AS (SELECT *, CASE WHEN m IN (SELECT month FROM cal) THEN m WHEN ry = my THEN mm ELSE '12' END AS rm FROM c)
  SELECT year AS asked_year, month AS asked_month, closing AS asked_closing, ry AS year, rm AS month, {_offered('closing', 'ry', 'rm')} AS closing FROM d""")
def resolve_release(t):
    c, date = F.col, F.col("o_orderdate")
    year, month = F.year(date).cast("string"), F.lpad(F.month(date).cast("string"), 2, "0")
    key = c("o_orderkey")
    asked = t.read("orders").select(
        F.when(key % 7 == 0, "1990").when(key % 7 == 1, F.lit(None)).when(key % 7 == 2, "x").otherwise(year).alias("year"),
        F.when(key % 11 == 0, "13").when(key % 11 == 1, F.lit(None)).when(key % 11 == 2, F.concat(year, month))
        .when(key % 11 == 3, "").otherwise(month).alias("month"),
        F.when(key % 5 < 4, (key % 5).cast("string")).alias("closing"),
    ).distinct()
    return periods.resolve_release(asked, release_calendar(t))


@query(f"""
  WITH l AS ({_LATEST}) SELECT k AS position, CASE WHEN k < month::INT THEN lpad(m::VARCHAR, 2, '0') ELSE (year::INT - 1)::VARCHAR || lpad(m::VARCHAR, 2, '0') END AS value,
    lpad(m::VARCHAR, 2, '0') || '-' || {S.MONTH_NAME.format('m')} AS label
  FROM (SELECT *, (month::INT - 1 - k + 12) % 12 + 1 AS m FROM l CROSS JOIN range(0, 12) r(k))""")
def month_choices(t):
    return periods.month_choices(latest_release(t))


@query(f"SELECT {S.PER}, view, rank, vintage, held FROM release_vintages")
def release_vintages(t):
    return t.release_vintages.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
  WITH facts AS (
    SELECT vintage, {S.K4}, {S.PER}, published_estimate_value FROM vintaged UNION ALL
    SELECT CASE WHEN bmrk_year = '2000' THEN 'current' ELSE (bmrk_year::INT + 1)::VARCHAR END,
      {S.K4}, {S.PER}, published_estimate_value + 1000 FROM vintaged WHERE data_type_code = '01' AND vintage <> 'current'),
  views AS (SELECT DISTINCT view, rank, vintage FROM release_vintages),
  newer AS (SELECT DISTINCT view, {S.PER} FROM facts JOIN views USING (vintage) WHERE rank = 0)
  SELECT view, {S.K4}, {S.PER}, published_estimate_value FROM facts JOIN views USING (vintage)
  WHERE rank = 0 OR (view, {S.PER}) NOT IN (FROM newer)""")
def vintage(t):
    """Estimates of every release's vintages, where most rows stand in two."""
    return periods.as_read(t.restated_estimates, t.release_vintages).select("view", *SERIES, *PERIOD, "published_estimate_value")


# --- catalog -----------------------------------------------------------------

@query("""
  SELECT *, CASE WHEN name IS NULL OR name = '' THEN code ELSE code || '-' || name END AS label FROM (
    SELECT 'state' AS dimension, stid AS code, state AS name FROM salist
    UNION SELECT 'area', msa, area FROM salist UNION SELECT 'series', series_code, series_name FROM titles)""")
def dimension_labels(t):
    return catalog.dimension_labels(t.salist, t.titles)


@query("SELECT * FROM structure")
def series_structure(t):
    return t.structure


@query(f"""SELECT {S.SEL}, false AS in_tolerance FROM fx_estimates WHERE data_type_code = '01'
  AND (estimate_link_relative < lower_tolerance OR estimate_link_relative > upper_tolerance)""")
def oot_series(t):
    return catalog.oot_series(t.estimates)


_CATALOG = f"""
  SELECT state_fips_code AS state, area_fips_code AS area, series_code AS series, series_type_code AS seriestype,
    CASE WHEN EXISTS (FROM structure k WHERE {S.on('k', 's', S.KS)} AND series_type_code = 'B'
      AND (data_type_code = '85' OR series_code LIKE '90%')) THEN 'Y' ELSE 'N' END AS toplev, data_type_code AS datatype,
    CASE WHEN EXISTS (FROM fx_estimates e WHERE {S.on('e', 's', S.KS)} AND e.data_type_code = '01' AND e.month = '06'
      AND e.year = '2000' AND e.estimate_type_code = '1' AND NOT (e.estimate_link_relative BETWEEN lower_tolerance AND upper_tolerance))
      THEN 'Y' ELSE 'N' END AS oot
  FROM structure s WHERE estimation_type_code <> 'D'"""


@query(_CATALOG)
def filter_catalog(t):
    asked = t.estimates.filter((F.col("year") == "2000") & (F.col("month") == "06") & (F.col("estimate_type_code") == "1"))
    return catalog.filter_catalog(t.structure, catalog.oot_series(asked))


@query("""
  WITH c AS (SELECT * FROM wide_catalog WHERE toplev = 'Y')
  SELECT 'state' AS level, '' AS state, '' AS area, '' AS series, state AS value FROM c
  UNION SELECT 'area', state, '', '', area FROM c UNION SELECT 'series', state, area, '', series FROM c
  UNION SELECT 'datatype', state, area, series, datatype FROM c""")
def catalog_options(t):
    return catalog.catalog_options(t.wide_catalog, top_only=True)


def _options(where: str) -> str:
    return f"""
  WITH c AS (SELECT * FROM wide_catalog WHERE {where})
  SELECT 'state' AS level, '' AS state, '' AS area, '' AS series, state AS value FROM c
  UNION SELECT 'area', state, '', '', area FROM c UNION SELECT 'series', state, area, '', series FROM c
  UNION SELECT 'datatype', state, area, series, datatype FROM c"""


@query(_options("true"))
def catalog_options_all(t):
    return catalog.catalog_options(t.wide_catalog)


@query(_options("oot = 'Y'"))
def catalog_options_oot(t):
    return catalog.catalog_options(t.wide_catalog, oot_only=True)


@query("""
  SELECT state, area, series, area || coalesce('-' || a.name, '') AS area_label,
    substr(series, 1, 2) || '-' || substr(series, 3) || coalesce('-' || max(seriestype) || '-' || s.name, '') AS series_label
  FROM wide_catalog LEFT JOIN (SELECT DISTINCT msa AS area, area AS name FROM salist WHERE msa <> '00000') a USING (area)
    LEFT JOIN (SELECT series_code AS series, series_name AS name FROM titles) s USING (series)
  GROUP BY state, area, series, a.name, s.name""")
def option_labels(t):
    return catalog.option_labels(t.wide_catalog, catalog.dimension_labels(t.salist, t.titles))


# --- navigation --------------------------------------------------------------

@query("""
  WITH s AS (SELECT state, area, series, max(datatype) AS datatype FROM wide_catalog GROUP BY ALL), n AS (
    SELECT state, area, series,
      lag({'area': area, 'series': series, 'datatype': datatype}) OVER a AS pa,
      lead({'area': area, 'series': series, 'datatype': datatype}) OVER a AS na,
      lag({'area': area, 'series': series, 'datatype': datatype}) OVER w AS ps,
      lead({'area': area, 'series': series, 'datatype': datatype}) OVER w AS ns
    FROM s WINDOW a AS (PARTITION BY state, series ORDER BY area), w AS (PARTITION BY state ORDER BY area, series))
  SELECT state, area, series, pa.area AS prev_area, pa.datatype AS prev_area_datatype,
    na.area AS next_area, na.datatype AS next_area_datatype, ps.area AS prev_series_area, ps.series AS prev_series,
    ps.datatype AS prev_series_datatype, ns.area AS next_series_area, ns.series AS next_series, ns.datatype AS next_series_datatype
  FROM n""")
def series_navigation(t):
    return navigation.series_navigation(t.wide_catalog)


_REQUESTED = """SELECT DISTINCT lpad(s_nationkey::VARCHAR, 2, '0') AS state, lpad((p_size * 100)::VARCHAR, 5, '0') AS area,
    (l_orderkey % 50)::VARCHAR || (l_partkey % 7)::VARCHAR AS code
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""


@query(f"""
  WITH r AS ({_REQUESTED}), o AS (SELECT DISTINCT state, area, series AS option FROM wide_catalog), m AS (
    SELECT state, area, code, option, n FROM r JOIN o USING (state, area) JOIN range(0, 9) k(n)
      ON n <= length(code) AND (n <> 1) AND (starts_with(option, left(code, n))
        OR (n = 2 AND left(code, 2) IN ('31', '32', '41', '42', '43') AND starts_with(option, left(code, 1)))))
  SELECT state, area, code, first(option ORDER BY n DESC, option) AS chosen FROM m GROUP BY state, area, code""")
def closest_code(t):
    options = t.wide_catalog.select("state", "area", F.col("series").alias("option"))
    return navigation.closest_code(t.code_requests, options, ["state", "area"])


@query(f"""
  WITH r AS (SELECT DISTINCT state, area, left(code, 2) AS code FROM ({_REQUESTED})),
    o AS (SELECT DISTINCT state, area, left(series, 2) AS option FROM wide_catalog)
  SELECT r.state, r.area, code,
    coalesce(max(option) FILTER (option = code), max(option), '') AS chosen
  FROM r LEFT JOIN o ON r.state = o.state AND r.area = o.area GROUP BY ALL""")
def highest_or_requested(t):
    options = t.wide_catalog.select("state", "area", F.substring("series", 1, 2).alias("option"))
    asked = t.code_requests.withColumn("code", F.substring("code", 1, 2))
    return navigation.highest_or_requested(asked, options, ["state", "area"])


# --- estimates ---------------------------------------------------------------

_PARTS = "estimate_adjustment, nse, sample_treatment, ratio_adjustment"


@query(f"SELECT {S.SEL}, {_PARTS} FROM adjusted")
def adjustment_decomposition(t):
    return estimates.adjustment_decomposition(t.estimates).select(*SELECTION, *_PARTS.split(", "))


_PARSED = "analyst_comment, adjtype, adjamt, adjsubtype, adjreason, est_adj"


@query(f"SELECT {S.SEL}, {_PARSED} FROM parsed")
def parse_adjustment_comments(t):
    return estimates.parse_adjustment_comments(t.estimates).select(*SELECTION, *_PARSED.split(", "))


@query("SELECT * FROM history")
def series_history(t):
    return estimates.series_history(t.estimates)


@query(f"SELECT {S.SEL}, upper_tolerance, lower_tolerance FROM tolerated")
def inherit_tolerance(t):
    return estimates.inherit_tolerance(t.estimates).select(*SELECTION, "upper_tolerance", "lower_tolerance")


_PANEL = (f"{S.SEL}, series_type_code, {S.REQ}, role, published_estimate_value, original_estimate_value, "
          "recalc_estimate_value, upper_tolerance, lower_tolerance, analyst_comment, ws_flag")


def _columns(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


@query(f"SELECT {_PANEL} FROM panel")
def period_panel(t):
    return t.panel.select(*_columns(_PANEL))


@query(f"SELECT {_PANEL}, backfilled FROM backfilled")
def backfill_ess(t):
    return estimates.backfill_ess(t.panel).select(*_columns(_PANEL), "backfilled")


_METRICS = (f"{S.SEL}, series_type_code, {S.REQ}, cm, pm, py, otm_change, oty_change, "
            "orig_otm_change, orig_oty_change, recalc_otm_change, recalc_oty_change")


@query(f"SELECT {_METRICS} FROM metrics")
def change_metrics(t):
    panel = estimates.backfill_ess(t.panel)
    return estimates.change_metrics(panel, estimates.year_ago_values(t.estimates)).select(*_columns(_METRICS))


_INFO = _METRICS + ", pm_comment, hi_tolerance, lo_tolerance, oot, estimate_adjustment, sample_treatment"


@query(f"SELECT {_INFO} FROM info")
def estimate_info(t):
    return t.info.select(*_columns(_INFO))


@query("SELECT * FROM comparison")
def estimate_comparison(t):
    return estimates.estimate_comparison(t.info).drop("crossed")


@query(f"""SELECT {S.K4}, sel_year, sel_month, sel_closing, prior_rows, own_rows FROM (
  SELECT {S.K4}, sel_year, sel_month, sel_closing, count(*) FILTER (this_closing <> sel_closing) AS prior_rows,
    count(*) FILTER (this_closing = sel_closing) AS own_rows FROM info GROUP BY ALL)""")
def stack_closings(t):
    other = F.col("this_closing") != F.col("sel_closing")
    return t.info.groupBy(*SERIES, "sel_year", "sel_month", "sel_closing").agg(
        F.count(F.when(other, 1)).alias("prior_rows"), F.count(F.when(~other, 1)).alias("own_rows"))


@query(f"""
  SELECT * EXCLUDE (p), CASE version WHEN 'hi-tol' THEN coalesce(p, 0) > coalesce(est, 0)
    WHEN 'lo-tol' THEN coalesce(p, 0) < coalesce(est, 0) ELSE false END AS crossed
  FROM (SELECT *, max(est) FILTER (version = 'pub') OVER (PARTITION BY {S.K4}, series_type_code, sel_year, sel_month, sel_closing) AS p
    FROM comparison)""")
def tolerance_crossing(t):
    return estimates.estimate_comparison(t.info)


@query(f"""
  SELECT {S.K4}, {S.REQ}, state_fips_code || '-' || area_fips_code || '-' || series_code || '-'
      || CASE data_type_code WHEN '01' THEN 'AE' WHEN '85' THEN 'ESS' END || '-' || sel_year || '-' || sel_month || '-'
      || CASE sel_closing WHEN '1' THEN 'P' WHEN '2' THEN 'F' ELSE 'R' END AS series,
    series_type_code AS stc, estimation_type_code AS estimator, birth_death_factor AS bdf, ws_flag AS ws,
    CASE state_verified_by WHEN 'jane.doe@example.org' THEN 'Jane' WHEN 'ces_sa' THEN '*Auto' END AS junior,
    CASE ro_verified_by WHEN 'sam-lee@example.org' THEN 'Sam-Lee' ELSE '*Auto' END AS senior,
    CASE estimate_type_code WHEN '1' THEN 'P' WHEN '2' THEN 'F' WHEN '3' THEN 'R' ELSE '' END AS pfr,
    sample_treatment AS sample_adj, estimate_adjustment AS est_adj, analyst_comment AS adj_comment, nse, ratio_adjustment AS ratio_adj,
    '?q=' || state_fips_code || ';' || CASE sel_closing WHEN '3' THEN sel_year ELSE (sel_year::INT - 1)::VARCHAR END || ';'
      || area_fips_code || ';' || series_code || ';' || sel_year || ';' || sel_month || ';' || sel_closing || ';'
      || data_type_code || ';0''' AS link
  FROM info""")
def series_info(t):
    return estimates.series_info(t.info)


@query(f"""
  WITH h AS (SELECT *, row_number() OVER (PARTITION BY {S.KS} ORDER BY year, month) AS i FROM history),
  f AS (SELECT {S.KS}, min(i) AS first_estimate FROM h WHERE closing <> '4' AND rvalue IS NOT NULL GROUP BY ALL)
  SELECT {S.KS}, year, month, {S.MONTH_NAME.format('month')} || ' ' || year AS label,
    CASE closing WHEN '4' THEN rvalue END AS benchmark,
    CASE WHEN closing <> '4' OR i = first_estimate - 1 THEN rvalue END AS estimate, lotol, hitol
  FROM h LEFT JOIN f USING ({S.KS})""")
def line_split(t):
    return estimates.line_split(estimates.series_history(t.estimates))


_MATRIX = f"""
  SELECT * EXCLUDE (keep, i, number, b), CASE WHEN rowtitle IN ('Orig Est', 'Pub Est') AND number <> 0 THEN number - b END AS change
  FROM (SELECT *, bool_or(coalesce(value, '') NOT IN ('0', '0.0')) OVER (PARTITION BY {S.KS}, rowtitle) AS keep,
      lag(number) OVER (PARTITION BY {S.KS}, rowtitle ORDER BY year, month) AS b
    FROM (SELECT *, coalesce(try_cast(value AS BIGINT), 0) AS number FROM (
      SELECT {S.KS}, unnest(['Orig Est', 'Sample Adj', 'NSE', 'Est Adj', 'Ratio Adj', 'Pub Est']) AS rowtitle, year, month,
        {S.MONTH_NAME.format('month')} || '-' || right(year, 2) AS label,
        unnest([orig_est::VARCHAR, sample_adj::VARCHAR, nse::VARCHAR, est_adj, ratio_adj::VARCHAR, rvalue::VARCHAR]) AS value, i
      FROM (SELECT *, row_number() OVER (PARTITION BY {S.KS} ORDER BY year DESC, month DESC) AS i FROM history)
      WHERE i <= 18)))
  WHERE keep"""


@query(_MATRIX)
def history_matrix(t):
    return estimates.history_matrix(estimates.series_history(t.estimates))


_LABELS = estimates.history_labels(int(LAST_YEAR))


def _column(label: str) -> str:
    return label.replace("-", "_").lower()


@query(f"""SELECT {S.KS}, rowtitle, {', '.join(f'max(value) FILTER (label = {m!r}) AS "{_column(m)}"' for m in _LABELS)}
  FROM ({_MATRIX}) GROUP BY {S.KS}, rowtitle""")
def history_table(t):
    table = estimates.history_table(estimates.history_matrix(estimates.series_history(t.estimates)), _LABELS)
    return table.withColumnsRenamed({m: _column(m) for m in _LABELS})


_CELLS = ", ".join(f"max(value) FILTER (back = {k}) AS m{k:02d}" for k in range(1, 19))


@query(f"""
  WITH m AS (
    SELECT *, bool_or(coalesce(value, '') NOT IN ('0', '0.0')) OVER (PARTITION BY {S.KS}, sel_year, sel_month, sel_closing, rowtitle) AS keep FROM (
      SELECT {S.KS}, sel_year, sel_month, sel_closing, unnest(['Orig Est', 'Sample Adj', 'NSE', 'Est Adj', 'Ratio Adj', 'Pub Est']) AS rowtitle,
        {S.MONTH_NAME.format('month')} || '-' || right(year, 2) AS label, back,
        unnest([orig_est::VARCHAR, sample_adj::VARCHAR, nse::VARCHAR, est_adj, ratio_adj::VARCHAR, rvalue::VARCHAR]) AS value
      FROM (SELECT *, row_number() OVER (PARTITION BY {S.KS}, sel_year, sel_month, sel_closing ORDER BY year DESC, month DESC) AS back FROM release_history)
      WHERE back <= 18))
  SELECT {S.KS}, sel_year, sel_month, sel_closing, rowtitle, string_agg(label, ',' ORDER BY back) AS month_labels, {_CELLS}
  FROM m WHERE keep GROUP BY {S.KS}, sel_year, sel_month, sel_closing, rowtitle""")
def history_by_position(t):
    """The history table of every release, each with its own months as columns."""
    return estimates.history_by_position(estimates.series_history(t.estimates, releases=t.periods))


@query("SELECT * FROM release_history")
def release_history(t):
    """The history of each series as each release shows it."""
    return estimates.series_history(t.estimates, releases=t.periods)


# --- releases of several vintages that hold other values for the same months -------

def restated(columns: str, table: str, release: str = "sel_year, sel_month, sel_closing"):
    def register(build):
        QUERIES[build.__name__] = build
        ORACLES[build.__name__] = S.restated(columns, table, release)
        return build
    return register


@restated("*", "release_history")
def restated_history(t):
    """Each release's history by its own vintages."""
    return estimates.series_history(t.viewed_estimates, releases=periods.viewed(t.release_vintages))


@restated(f"{S.SEL}, upper_tolerance, lower_tolerance", "tolerated", S.PER)
def restated_tolerance(t):
    rows = periods.on_periods(estimates.inherit_tolerance(t.viewed_estimates), periods.viewed(t.release_vintages))
    return rows.select(*SELECTION, "upper_tolerance", "lower_tolerance")


@restated(_PANEL, "panel")
def restated_panel(t):
    raw = estimates.adjustment_decomposition(estimates.inherit_tolerance(t.viewed_estimates))
    requests = periods.release_requests(periods.viewed(t.release_vintages))
    return estimates.period_panel(raw, t.structure, requests).select(*_columns(_PANEL))


@restated(_INFO, "info")
def restated_info(t):
    return t.viewed_info.select(*_columns(_INFO))


@restated("*", "comparison")
def restated_comparison(t):
    return estimates.estimate_comparison(t.viewed_info).drop("crossed", VIEW)


@restated("*", "detail", S.PER)
def restated_detail(t):
    return t.viewed_detail.drop(VIEW)


@restated("*", "sample_history", "cur_year, cur_month, cur_closing")
def restated_sample_history(t):
    return history.sample_history(t.viewed_weighted, t.viewed_detail, t.viewed_newest)


@query(f"""
  SELECT {S.K4}, {S.PER}, n / (n + 1) + CASE WHEN main = 'current' THEN 0 ELSE 1 END AS weight_y1
  FROM fx_estimates JOIN (SELECT {S.PER}, vintage AS main FROM release_vintages WHERE rank = 0) USING ({S.PER}) WHERE data_type_code = '01'""")
def model_vintages(t):
    """Model rows of each release, from the archive or the current table."""
    return models.of_vintage(t.model_versions, t.release_vintages).select(*SERIES, *PERIOD, "weight_y1")


def vintage_partitions(t):
    """The same estimates from one scan of a table with a folder per vintage, its periods kept beside it."""
    path = f"{t.root}/restated_estimates"
    t.restated_estimates.write.mode("overwrite").partitionBy("vintage").parquet(path)
    periods.held_periods(t.restated_estimates).write.mode("overwrite").parquet(f"{path}_periods")
    facts = readers.read_vintage_partitions(t.spark, path, t.restated_estimates.schema)
    held = t.spark.read.parquet(f"{path}_periods")
    return periods.as_read(facts, t.release_vintages, held).select("view", *SERIES, *PERIOD, "published_estimate_value")


QUERIES["vintage_partitions"], ORACLES["vintage_partitions"] = vintage_partitions, ORACLES["vintage"]


# --- sample ------------------------------------------------------------------

_WEIGHTED = f"{S.SEL}, report_id, a_typ_flag, cont_tot_dwnwght, wgt, wpm, wcm, wotm"


@query(f"SELECT {_WEIGHTED} FROM wotm")
def weighted_sample(t):
    return t.weighted.select(*_columns(_WEIGHTED))


@query("SELECT * FROM flags")
def flag_summary(t):
    return sample.flag_summary(t.weighted)


@query("SELECT * FROM signs")
def sign_summary(t):
    return sample.sign_summary(t.weighted)


@query("SELECT * FROM sums")
def sample_total(t):
    return sample.sample_total(sample.flag_summary(t.weighted))


@query("SELECT * FROM covered")
def coverage(t):
    total = sample.sample_total(sample.flag_summary(t.weighted))
    return sample.coverage(total, sample.published_values(t.info))


@query("SELECT * FROM pm_covered")
def pm_coverage(t):
    return sample.pm_coverage(t.weighted, sample.published_values(t.info))


@query("SELECT * FROM summary")
def sample_summary(t):
    return t.summary


@query("SELECT * FROM summary")
def review_sink(t):
    """The summaries of all releases, written by the sink and read back."""
    root, releases = f"{t.root}/review", [tuple(r) for r in t.periods.select(*PERIOD).collect()]
    write_review({"sample_summary": t.summary}, root, releases)
    return read_review(t.spark, root, "sample_summary")


@query(f"""SELECT {S.SEL}, round_even(trunc(wcm) / nullif(trunc(wpm), 0), 4) AS link FROM (
  SELECT *, row_number() OVER (PARTITION BY {S.SEL} ORDER BY row_order) AS i FROM summary) WHERE i = 1""")
def sample_link(t):
    return sample.sample_link(t.summary)


# --- detail ------------------------------------------------------------------

@query("SELECT * FROM detail")
def sample_detail(t):
    return t.detail


@query(f"""SELECT {S.SEL}, report_id, {S.size('pm_value')} AS pm_size, {S.size('cm_value')} AS cm_size,
  greatest(greatest({S.size('pm_value')}, {S.size('cm_value')}) - selection_size::BIGINT, 0) AS szgap FROM fx_sample""")
def size_gaps(t):
    pm, cm = size_bracket(F.col("pm_value")), size_bracket(F.col("cm_value"))
    return t.sample.select(*SELECTION, "report_id", pm.alias("pm_size"), cm.alias("cm_size"),
                           size_gap(pm, cm, F.col("selection_size")).alias("szgap"))


# Squares of part sizes: brackets that overlap, and gaps where a size is left out.
_BRACKETS = """SELECT DISTINCT p_size AS size, (p_size * p_size)::BIGINT AS low, (p_size * p_size + 3 * p_size)::BIGINT AS high
  FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0"""


def _brackets(t):
    size = F.col("p_size").cast("bigint")
    return t.read("part").filter((size % 5 != 0) & (size % 7 != 0)).select(
        size.alias("size"), (size * size).alias("low"), (size * size + 3 * size).alias("high")).distinct()


@query(f"""
  WITH b AS ({_BRACKETS})
  SELECT {S.SEL}, report_id, pm_value, size::BIGINT AS size, low, high FROM fx_sample LEFT JOIN b ON pm_value BETWEEN low AND high""")
def bracket_join(t):
    """Every bracket of a report's employment, from a table of brackets."""
    return intervals.in_intervals(t.sample.select(*SELECTION, "report_id", "pm_value"), "pm_value", _brackets(t), "low", "high", "left")


@query(f"""
  WITH b AS ({_BRACKETS}), s AS (
    SELECT {S.SEL}, report_id, selection_size::BIGINT AS selsize, (SELECT max(size) FROM b WHERE pm_value BETWEEN low AND high)::BIGINT AS pm_size,
      (SELECT max(size) FROM b WHERE cm_value BETWEEN low AND high)::BIGINT AS cm_size FROM fx_sample)
  SELECT {S.SEL}, report_id, pm_size, cm_size, greatest(greatest(pm_size, cm_size) - selsize, 0) AS szgap FROM s""")
def size_gaps_by_table(t):
    rows = t.sample.select(*SELECTION, "report_id", F.col("pm_value").alias("pm"), F.col("cm_value").alias("cm"), F.col("selection_size").alias("selsize"))
    return intervals.sizes_by_table(rows, _brackets(t)).drop("pm", "cm", "selsize")


@query(f"""SELECT {S.SEL}, report_id, {S.size('pm_value')} AS pm_size, {S.size('cm_value')} AS cm_size,
  greatest(greatest({S.size('pm_value')}, {S.size('cm_value')}) - selection_size::BIGINT, 0) AS szgap FROM fx_sample""")
def size_gaps_literal(t):
    """The usual brackets as a literal table."""
    rows = t.sample.select(*SELECTION, "report_id", F.col("pm_value").alias("pm"), F.col("cm_value").alias("cm"), F.col("selection_size").alias("selsize"))
    brackets = t.spark.createDataFrame(SIZE_BRACKETS, "size bigint, low bigint, high bigint")
    return intervals.sizes_by_table(rows, brackets).drop("pm", "cm", "selsize")


_PLACE = f"""row_number() OVER (PARTITION BY {S.SEL} ORDER BY flag NULLS FIRST, abs(wotm) DESC NULLS FIRST, reptstate NULLS FIRST,
  ui NULLS FIRST, report NULLS FIRST, is_knr) AS row_index"""


@query(f"SELECT {S.SEL}, report, flag, {_PLACE} FROM detail")
def detail_order(t):
    """The place of each report in the display order of its selection."""
    return detail.numbered(t.detail, t.root).select(*SELECTION, "report", "flag", "row_index")


@query(f"SELECT {S.SEL}, {', '.join(UNIT_GROUP)}, {_PLACE} FROM rollup")
def rollup_order(t):
    return detail.numbered(t.units, t.root).select(*SELECTION, *UNIT_GROUP, "row_index")


@query(f"""
  SELECT {S.SEL}, {', '.join(UNIT_GROUP)}, {_PLACE} FROM (
    SELECT *, {_PLACE.replace('row_index', 'i')} FROM rollup) WHERE i <= 3 OR flag = 'X' OR flag <> origflag""")
def shortlist_order(t):
    shortlist = t.written(detail.review_shortlist(t.stored_units, k=3), "shortlist")  # dealing out by ranges reads it twice
    return detail.numbered(shortlist, t.root).select(*SELECTION, *UNIT_GROUP, "row_index")


@query("SELECT * FROM rollup")
def ui_rollup(t):
    return t.units


@query(f"""
  SELECT * EXCLUDE (i) FROM (SELECT *, count(*) OVER (PARTITION BY {S.SEL}) AS total_rows,
    row_number() OVER (PARTITION BY {S.SEL} ORDER BY flag NULLS FIRST, abs(wotm) DESC NULLS FIRST,
      reptstate NULLS FIRST, ui NULLS FIRST, report NULLS FIRST, is_knr) AS i FROM rollup)
  WHERE i <= 3 OR flag = 'X' OR flag <> origflag""")
def review_shortlist(t):
    return detail.review_shortlist(t.units, k=3)


@query(f"""
  SELECT * EXCLUDE (i) FROM (SELECT *, count(*) OVER (PARTITION BY {S.SEL}) AS total_rows,
    row_number() OVER (PARTITION BY {S.SEL} ORDER BY flag NULLS FIRST, abs(wotm) DESC NULLS FIRST,
      reptstate NULLS FIRST, ui NULLS FIRST, report NULLS FIRST, is_knr) AS i FROM rollup)
  WHERE i <= 31 OR flag = 'X' OR flag <> origflag""")
def review_shortlist_default(t):
    return detail.review_shortlist(t.units)


@query(f"SELECT * FROM detail SEMI JOIN (SELECT * FROM rollup WHERE is_summed) USING ({S.SEL}, {', '.join(UNIT_GROUP)})")
def group_detail(t):
    return detail.group_detail(t.detail, t.units.filter("is_summed"))


_MARKS = "flag_changed, allowed_flags, dwght_changed, pm_flag_differs, prior_flag_differs, direction"


@query(f"""
  SELECT {S.SEL}, report, flag IS DISTINCT FROM origflag AS flag_changed,
    CASE WHEN flag IN ('A', 'T') THEN 'A,T,X' ELSE flag END AS allowed_flags,
    dwght IS DISTINCT FROM origdwght AND origdwght IS DISTINCT FROM 0 AND flag IS NOT DISTINCT FROM origflag
      AND flag IS NOT DISTINCT FROM 'T' AS dwght_changed,
    pm_flag IS DISTINCT FROM flag AS pm_flag_differs, prior_flag IS DISTINCT FROM flag AS prior_flag_differs,
    CASE WHEN trunc(wotm) > 0 THEN 'up' WHEN trunc(wotm) < 0 THEN 'down' ELSE '' END AS direction FROM detail""")
def review_flags(t):
    return detail.review_flags(t.detail).select(*SELECTION, "report", *_columns(_MARKS))


@query(f"""
  SELECT {S.SEL}, flag, n::VARCHAR AS count FROM (
    SELECT {S.SEL}, a_typ_flag AS flag, count(*) AS n, bool_or(a_typ_flag = 'U') OVER (PARTITION BY {S.SEL}) AS other
    FROM fx_sample GROUP BY {S.SEL}, a_typ_flag) WHERE NOT other""")
def flag_counts(t):
    """Counts written as text and read back; text with any other flag is refused."""
    per_flag = t.sample.groupBy(*SELECTION, "a_typ_flag").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws(": ", "a_typ_flag", F.col("n").cast("string"))
    text = per_flag.groupBy(*SELECTION).agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("text"))
    return text.select(*SELECTION, F.explode(C.flag_counts(F.col("text"))).alias("b")).select(*SELECTION, "b.*")


# --- sample history ----------------------------------------------------------

@query("SELECT * FROM sample_history")
def sample_history(t):
    return t.past


@query(f"""
  SELECT {S.SEL.replace('estimate_type_code', 'estimate_type_code AS closing')}, report, string_agg(view, ';' ORDER BY view) AS views
  FROM viewed_reports WHERE estimate_type_code = newest AND newest <> '4' GROUP BY {S.SEL}, report""")
def history_store(t):
    """What histories are made of, each row once: the views that show it."""
    return t.history_rows.select(*SERIES, "year", "month", F.right("valid_from", F.lit(1)).alias("closing"), "report", F.array_join("views", ";").alias("views"))


@restated("*", "sample_history", "cur_year, cur_month, cur_closing")
def restated_sample_history_stored(t):
    weighted = sample.weighted_sample(t.restated_sample)
    store = history.history_store(weighted, t.release_vintages, t.months_shown(t.restated_months))
    return history.unfold_history(store, t.subjects(weighted, t.restated_months), parts=t.history_parts)


def _plain(rows):
    return rows.withColumns({c: F.col(c).cast("double") for c in ("pm", "cm", "otm", "wotm")})


@query("SELECT * FROM history_summary")
def history_rollup(t):
    return _plain(history.history_rollup(t.viewed_past, "summary")).drop(VIEW, PART)


@query("SELECT * FROM history_detail")
def history_rollup_reports(t):
    return _plain(history.history_rollup(t.viewed_past, "detail")).drop(VIEW, PART)


@query(f"""SELECT {S.history_keys('summary')}, is_knr, year, month, report,
  CASE WHEN flag = 'X' THEN 'black' WHEN flag = 'A' THEN 'red' WHEN dwght BETWEEN 0.3 AND 0.4 THEN 'orange' ELSE 'blue' END AS colour
  FROM sample_history""")
def history_members(t):
    return history.history_members(t.past, "summary")


@query("SELECT * FROM segments_summary")
def month_segments(t):
    return history.month_segments(history.history_rollup(t.viewed_past, "summary"), "summary").drop(VIEW, PART)


@query("SELECT * FROM segments_detail")
def month_segments_reports(t):
    return history.month_segments(history.history_rollup(t.viewed_past, "detail"), "detail").drop(VIEW, PART)


# --- what-if -----------------------------------------------------------------

@query("SELECT * FROM inputs")
def estimate_inputs(t):
    return whatif.estimate_inputs(t.summary, t.info)


_MOVES = ", ".join(
    f"sum(CASE WHEN origflag = '{f}' THEN {v} ELSE 0 END - CASE WHEN flag = '{f}' THEN {v} ELSE 0 END)::DOUBLE AS d_{n}"
    for n, f, v in (("apm", "A", "pm"), ("acm", "A", "cm"), ("twpm", "T", "wpm"), ("twcm", "T", "wcm")))


@query(f"""
  WITH d AS (SELECT {S.SEL}, {_MOVES}, count(*) AS n FROM detail WHERE flag <> origflag GROUP BY {S.SEL}), j AS (
    SELECT i.*, coalesce(n, 0) AS changed_reports,
      {', '.join(f'i.{x} + coalesce(d_{x}, 0) AS n_{x}' for x in ('apm', 'acm', 'twpm', 'twcm'))}
    FROM inputs i LEFT JOIN d USING ({S.SEL})), k AS (
    SELECT *, CASE WHEN n_twpm = 0 THEN 1 ELSE n_twcm / n_twpm END AS lnk,
      CASE WHEN coalesce(pm, 0) = 0 THEN 1 ELSE pm END::DOUBLE AS pm1, CASE WHEN coalesce(py, 0) = 0 THEN 1 ELSE py END::DOUBLE AS py1 FROM j), e AS (
    SELECT *, floor((coalesce(pm, 0) - n_apm) * lnk + 0.5) + n_acm + bdf AS est FROM k)
  SELECT {S.SEL}, n_apm AS apm, n_acm AS acm, n_twpm AS twpm, n_twcm AS twcm, changed_reports, lnk::DOUBLE AS link,
    est AS n_recalc_cm, est - pm1 AS n_recalc_otm, est - py1 AS n_recalc_oty,
    (est - pm1) / pm1 * 100 AS n_recalc_otm_pct, (est - py1) / py1 * 100 AS n_recalc_oty_pct FROM e""")
def what_if_reflag(t):
    """Every changed flag is proposed to go back to the original one."""
    rows = t.stored_detail
    changes = rows.filter(F.col("flag") != F.col("origflag")).select(
        *SELECTION, *detail.REPORT_KEY, F.col("origflag").alias("new_flag"))
    return whatif.what_if_reflag(rows, changes, estimate_inputs(t))


@query(f"""
  WITH d AS (SELECT {S.SEL}, {', '.join(f"-sum(CASE WHEN flag = '{f}' THEN {v} ELSE 0 END)::DOUBLE AS d_{n}"
      for n, f, v in (("apm", "A", "pm"), ("acm", "A", "cm"), ("twpm", "T", "wpm"), ("twcm", "T", "wcm")))}, count(*) AS n
    FROM detail SEMI JOIN (SELECT * FROM rollup WHERE is_summed) USING ({S.SEL}, {', '.join(UNIT_GROUP)}) GROUP BY {S.SEL})
  SELECT {S.SEL}, {', '.join(f'i.{x} + coalesce(d_{x}, 0) AS {x}' for x in ('apm', 'acm', 'twpm', 'twcm'))}, coalesce(n, 0) AS changed_reports
  FROM inputs i LEFT JOIN d USING ({S.SEL})""")
def what_if_units(t):
    """All reports of every unit row with several reports are proposed to be unused."""
    rows = t.stored_detail
    units = detail.ui_rollup(rows).filter("is_summed").select(*SELECTION, *UNIT_GROUP, F.lit("X").alias("new_flag"))
    changes = whatif.unit_changes(rows, units)
    return whatif.what_if_reflag(rows, changes, estimate_inputs(t)).select(*SELECTION, *whatif.TOTALS, "changed_reports")


# --- models ------------------------------------------------------------------

_ASKED = "SELECT * FROM info WHERE this_closing = sel_closing"


@query(f"""
  WITH links AS (SELECT {S.KS}, {S.PER}, n / (n + 1) AS weight_y1, n / (n + 2) AS weight_y2, n / (n + 3) AS weight_y4,
      c / p AS link_y1, (c + n) / p AS link_y2, (c + 2 * n) / p AS link_y4 FROM fx_estimates WHERE data_type_code = '01'),
  a AS (SELECT *, CASE WHEN series_code LIKE '9%' THEN substr(series_code, 4, 1) ELSE '5' END AS own,
      CASE estimation_type_code WHEN 'S' THEN contains(replace(lower(coalesce(analyst_comment, 'None')), ' ', ''), 'adjustedtoy1link')
        ELSE NOT contains(lower(coalesce(analyst_comment, 'None')), 'y2') END AS y1
    FROM ({_ASKED}) WHERE estimation_type_code IN ('S', 'Q'))
  SELECT {S.SEL}, estimation_type_code AS model_kind, e.estimator,
    CASE WHEN e.estimator = 'y4' THEN weight_y4 WHEN own = '5' THEN CASE e.estimator WHEN 'y1' THEN weight_y1 ELSE weight_y2 END
      WHEN y1 = (e.estimator = 'y1') THEN 1.0 ELSE 0.0 END AS weight,
    CASE e.estimator WHEN 'y1' THEN link_y1 WHEN 'y2' THEN link_y2 ELSE link_y4 END AS link,
    {S.cut("CASE e.estimator WHEN 'y1' THEN link_y1 WHEN 'y2' THEN link_y2 ELSE link_y4 END * pm")} AS estimate,
    {S.cut("CASE e.estimator WHEN 'y1' THEN link_y1 WHEN 'y2' THEN link_y2 ELSE link_y4 END * pm - pm")} AS otm
  FROM a JOIN links USING ({S.KS}, {S.PER})
  JOIN (VALUES ('y1'), ('y2'), ('y4')) e(estimator) ON e.estimator <> 'y4' OR (own = '5' AND area_fips_code <> '00000')""")
def small_domain_model(t):
    return models.small_domain_model(t.small_domain, t.info)


def _g3(name, link, weight):
    est = S.rnd(f"({link}) * (p * 10)::DOUBLE")
    return f"""SELECT {S.SEL}, '{name}' AS model, {link} AS link, {weight}::DOUBLE AS weight, {S.cut(est)} AS est,
      {S.cut(f'{est} - p * 10')} AS otm, n / 10 AS beta, c / (p + 1) AS y2_m FROM g"""


@query(f"""
  WITH g AS (SELECT * FROM fx_estimates SEMI JOIN (SELECT {S.SEL} FROM ({_ASKED}) WHERE estimation_type_code = 'G') USING ({S.SEL}))
  {_g3('Y1 (Sample)', 'c / p', 'n / (n + 1)')} UNION ALL {_g3('State Adj', '(c + n) / p', 'n / (n + 2)')}
  UNION ALL {_g3('Synth', '(c - n) / p', 'n / (n + 3)')} UNION ALL {_g3('Gen 3', 'c / (p + n)', '1')}""")
def third_gen_model(t):
    return models.third_gen_model(t.third_gen, t.info)


# --- teaching tables ---------------------------------------------------------

@query("""SELECT sample_group, parent_report, count(*) AS report_count, sum(pm)::BIGINT AS pm, sum(cm)::BIGINT AS cm,
  sum(otm)::BIGINT AS otm, count(*) > 1 AS expandable FROM report_lines GROUP BY sample_group, parent_report""")
def parent_rollup(t):
    return basic.parent_rollup(t.report_lines)


@query("SELECT *, parent_report || '-' || report AS id FROM report_lines")
def parent_detail(t):
    return basic.parent_detail(t.report_lines)


@query(f"""SELECT o_orderpriority AS data_series, year(o_orderdate) AS year, month(o_orderdate) AS month,
  {S.MONTH_NAME.format('month(o_orderdate)')} || ' ' || year(o_orderdate) AS label,
  sum(floor(o_totalprice)::BIGINT)::BIGINT AS estimate, sum(floor(o_totalprice * 0.5)::BIGINT)::BIGINT AS benchmark
  FROM orders GROUP BY ALL""")
def two_line_series(t):
    return basic.two_line_series(t.two_lines)


@query("""SELECT l_returnflag || l_linestatus AS option, min(l_orderkey * 100 + l_linenumber) AS first_seen
  FROM lineitem GROUP BY ALL""")
def options_first_seen(t):
    rows = t.read("lineitem").withColumn("group", F.concat("l_returnflag", "l_linestatus"))
    return basic.options_first_seen(rows, "group", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


_ORDERS = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"


def _orders_csv(t, line):
    """The orders as CSV files, in the order of their keys, in a folder of this run."""
    path = f"{t.root}/orders_csv"
    rows = t.read("orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey")
    rows.select(line).write.mode("overwrite").text(path)
    return path


def _csv_line():
    """Every 17th line lacks a field, every 19th has one too many, every 23rd a word for a number."""
    key = F.col("o_orderkey")
    price = F.when(key % 23 == 0, "much").otherwise(F.col("o_totalprice").cast("string"))
    fields = [key.cast("string"), F.col("o_custkey").cast("string"), price, F.when(key % 17 != 0, F.col("o_orderpriority")), F.when(key % 19 == 0, "more")]
    return F.concat_ws(",", *fields).alias("line")


_BROKEN = "(o_orderkey % 23 = 0 OR (o_orderkey % 17 = 0) <> (o_orderkey % 19 = 0))"


@query(f"""SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS o_totalprice, CASE WHEN o_orderkey % 17 = 0 THEN 'more' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE NOT {_BROKEN}""")
def csv_rows(t):
    """Lines of a CSV that fit its schema; a line that lacks a field and has one too many does."""
    schema = _parse_datatype_string(_ORDERS)
    return readers.ingest_csv(t.spark, _orders_csv(t, _csv_line()), schema, header=False, root=t.root).rows


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'number' WHEN o_orderkey % 17 = 0 THEN 'few' ELSE 'many' END AS why FROM orders WHERE {_BROKEN}""")
def csv_rejects(t):
    schema = _parse_datatype_string(_ORDERS)
    rejects = readers.ingest_csv(t.spark, _orders_csv(t, _csv_line()), schema, header=False, root=t.root).rejects
    fields = F.split("record", ",")
    why = F.when(F.array_contains(fields, "much"), "number").when(F.size(fields) < 4, "few").otherwise("many")
    return rejects.select(fields[0].cast("bigint").alias("o_orderkey"), why.alias("why"))


@query("SELECT (o_custkey % 500)::VARCHAR AS code, max(o_orderpriority) AS name FROM orders GROUP BY 1")
def csv_lookup(t):
    """A lookup from a CSV file that names most codes many times."""
    path = f"{t.root}/lookup_csv"
    rows = t.read("orders").select((F.col("o_custkey") % 500).cast("string").alias("code"), F.col("o_orderpriority").alias("name"))
    rows.write.mode("overwrite").csv(path, header=True)
    return readers.read_lookup(t.spark, path, rows.schema, "code", "name")


@query("""SELECT option, row_number() OVER (ORDER BY first_key) AS place FROM (
  SELECT o_orderpriority || '/' || (o_custkey % 10) AS option, min(o_orderkey) AS first_key FROM orders GROUP BY ALL)""")
def options_in_file_order(t):
    """Options of CSV files in the order in which the files have them."""
    option = F.concat(F.col("o_orderpriority"), F.lit("/"), (F.col("o_custkey") % 10).cast("string"))
    rows = t.spark.read.schema("option string").csv(_orders_csv(t, option.alias("line")))
    options = basic.options_first_seen(readers.with_file_place(rows), "option", F.col("file_place"))
    return ranks.with_rank(options, [F.col("first_seen")], name="place", root=t.root).select("option", "place")


@query("""WITH o AS (SELECT l_returnflag || l_linestatus AS option, min(l_orderkey * 100 + l_linenumber) AS first_seen FROM lineitem GROUP BY ALL)
  SELECT coalesce(max(option) FILTER (option = 'NF'), arg_min(option, first_seen)) AS option FROM o""")
def requested_or_first(t):
    return basic.requested_or_first(options_first_seen(t), "NF")
