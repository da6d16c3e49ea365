"""DuckDB oracles: the same results in plain SQL over the same test tables.

The SQL is written from the definitions (self joins, unions, distinct counts)
rather than from the Spark plans, so that the two sides check each other.
"""

from __future__ import annotations

KS = "state_fips_code, area_fips_code, series_code"
K4 = f"{KS}, data_type_code"
PER = "year, month, estimate_type_code"
SEL = f"{K4}, {PER}"
REQ = "sel_year, sel_month, sel_closing, this_closing"


def on(left: str, right: str, columns: str) -> str:
    return " AND ".join(f"{left}.{c.strip()} = {right}.{c.strip()}" for c in columns.split(","))


def of(alias: str, columns: str) -> str:
    return ", ".join(f"{alias}.{c.strip()}" for c in columns.split(","))


def rnd(x: str) -> str:
    """Half-even rounding without negative zero."""
    return f"(CASE WHEN round_even({x}, 0) = 0 THEN 0.0::DOUBLE ELSE round_even({x}, 0)::DOUBLE END)"


def rnd_long(x: str) -> str:
    return f"round_even({x}, 0)::BIGINT"


def cut(x: str) -> str:
    return f"trunc({x})::BIGINT"


def total(x: str) -> str:
    """Exact sum of doubles, rounded half to even."""
    return f"coalesce(round_even(sum(({x})::DECIMAL(38,7)), 0), 0)::DOUBLE"


PM_CLOSING = ("CASE WHEN month = '01' THEN '3' WHEN estimate_type_code = '3' AND month = '12' THEN '3' "
              "WHEN estimate_type_code = '3' THEN '4' ELSE '2' END")
PM_YEAR = "CASE WHEN month = '01' THEN (year::INT - 1)::VARCHAR ELSE year END"
PM_MONTH = "CASE WHEN month = '01' THEN '12' ELSE lpad((month::INT - 1)::VARCHAR, 2, '0') END"
BMRK = "CASE WHEN estimate_type_code = '3' THEN year ELSE (year::INT - 1)::VARCHAR END"
MONTH_NAME = ("['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][{0}::INT]")

_FLAG = "CASE {0}(l_returnflag) WHEN 'R' THEN 'T' WHEN 'A' THEN 'A' ELSE CASE WHEN count(*) > 1 THEN 'U' ELSE 'X' END END"

COMMENT_PATTERN = (r"(Manual|OT|EM|RW|R1), Amt: (-?\d+)(?:,\s+(Type:|adj Y1 weight to) (\w+))?"
                   r".+\{(SI|MS|SR|SM|MR)\}")


def part(number: int) -> str:
    return f"nullif(regexp_extract(analyst_comment, '{COMMENT_PATTERN}', {number}), '')"


def size(x: str) -> str:
    return (f"(CASE WHEN {x} BETWEEN 0 AND 9 THEN 1 WHEN {x} BETWEEN 10 AND 19 THEN 2 WHEN {x} BETWEEN 20 AND 49 THEN 3 "
            f"WHEN {x} BETWEEN 50 AND 99 THEN 4 WHEN {x} BETWEEN 100 AND 249 THEN 5 WHEN {x} BETWEEN 250 AND 499 THEN 6 "
            f"WHEN {x} BETWEEN 500 AND 999 THEN 7 WHEN {x} BETWEEN 1000 AND 999999999999 THEN 8 END)::BIGINT")


CTES: dict[str, str] = {}

CTES["fx_sample"] = f"""
  SELECT lpad(s_nationkey::VARCHAR, 2, '0') AS state_fips_code,
    CASE WHEN s_nationkey % 3 = 0 THEN (40000 + s_nationkey)::VARCHAR ELSE '00000' END AS area_fips_code,
    CASE WHEN l_linestatus = 'F' THEN '10000000' ELSE '90911000' END AS series_code,
    '01' AS data_type_code, year, month, estimate_type_code, {BMRK} AS bmrk_year,
    lpad(l_suppkey::VARCHAR, 7, '0') AS report_id, lpad(s_nationkey::VARCHAR, 2, '0') AS rept_sfc,
    lpad((l_suppkey % 2)::VARCHAR, 10, '0') AS selected_ui_number,
    lpad((l_suppkey % 2)::VARCHAR, 3, '0') AS report_with,
    (20 + max(l_partkey) % 5)::VARCHAR || lpad((max(l_partkey) % 100)::VARCHAR, 4, '0') AS naics_code,
    (1 + l_suppkey % 8)::VARCHAR AS selection_size, count(*)::VARCHAR AS version,
    1 + max(l_tax) AS sample_weight, 1 - max(l_discount) / 2 AS diff_resp_rate,
    min(l_discount) AS cont_tot_dwnwght, max(l_discount) AS original_cont_tot_dwnwght,
    sum(l_quantity)::BIGINT AS pm_value, sum(floor(l_extendedprice / 2000)::BIGINT)::BIGINT AS cm_value,
    {_FLAG.format('max')} AS a_typ_flag, {_FLAG.format('min')} AS original_a_typ_flag,
    CASE min(l_partkey) % 3 WHEN 0 THEN '21' WHEN 1 THEN '22' END AS pm_comment_1,
    CASE min(l_partkey) % 2 WHEN 0 THEN '21' END AS pm_comment_2,
    CASE max(l_partkey) % 3 WHEN 0 THEN '93' WHEN 2 THEN '11' END AS cm_comment_1,
    CASE max(l_partkey) % 4 WHEN 0 THEN '93' WHEN 1 THEN '12' END AS cm_comment_2
  FROM (SELECT *, year(l_shipdate)::VARCHAR AS year, lpad(month(l_shipdate)::VARCHAR, 2, '0') AS month,
      CASE WHEN l_linenumber = 7 AND year(l_shipdate) < 2000 THEN '4'
           ELSE ((l_linenumber - 1) % 3 + 1)::VARCHAR END AS estimate_type_code
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
  GROUP BY s_nationkey, l_linestatus, year, month, estimate_type_code, l_suppkey"""

CTES["weighted"] = """
  SELECT * EXCLUDE (w), w AS wgt,
    CASE a_typ_flag WHEN 'T' THEN pm_value * w WHEN 'A' THEN pm_value ELSE 0 END::DOUBLE AS wpm,
    CASE a_typ_flag WHEN 'T' THEN cm_value * w WHEN 'A' THEN cm_value ELSE 0 END::DOUBLE AS wcm
  FROM (SELECT *, sample_weight * diff_resp_rate * cont_tot_dwnwght AS w
    FROM (SELECT * REPLACE (CASE WHEN cont_tot_dwnwght = 0 THEN 1.0 ELSE cont_tot_dwnwght END::DOUBLE AS cont_tot_dwnwght)
      FROM fx_sample))"""

CTES["wotm"] = f"SELECT *, {rnd('wcm - wpm')} AS wotm FROM weighted"

_NATION = "state_fips_code::INT"
CTES["fx_estimates"] = f"""
  SELECT {KS}, {PER}, bmrk_year, dt AS data_type_code,
    (c * f)::DOUBLE AS published_estimate_value, (c * f - n)::DOUBLE AS recalc_estimate_value,
    (c * f - 2 * n - CASE dt WHEN '01' THEN 3 ELSE 0 END)::DOUBLE AS original_estimate_value,
    CASE dt WHEN '01' THEN 0.8::DOUBLE END AS lower_tolerance, CASE dt WHEN '01' THEN 1.2::DOUBLE END AS upper_tolerance,
    CASE dt WHEN '01' THEN c::DOUBLE / p END AS estimate_link_relative,
    CASE dt WHEN '01' THEN n + 0.5 ELSE n END::DOUBLE AS sample_adjustment,
    CASE WHEN dt = '01' AND month = '01' THEN 5.0 ELSE 0.0 END::DOUBLE AS non_sample_adjustment,
    c, p, n, ['S', 'G', 'Q', 'D'][{_NATION} % 4 + 1] AS estimation_type_code,
    (n * 3)::DOUBLE AS birth_death_factor,
    CASE n % 4 WHEN 0 THEN 'OT, Amt: ' || n * 100 || ', Type: OTMC  {{MS}}  removing'
      WHEN 1 THEN 'RW, Amt: ' || n || ', adj Y1 weight to unweighted sample coverage of 0.126337 {{SR}} , This NAICS'
      WHEN 2 THEN 'Manual, Amt: -' || n || ' Adjusted to Y1 link {{SM}}' END AS analyst_comment,
    CASE n % 3 WHEN 0 THEN 'jane.doe@example.org' WHEN 1 THEN 'ces_sa' END AS state_verified_by,
    CASE p % 2 WHEN 0 THEN 'sam-lee@example.org' ELSE 'CES_SA@example.org' END AS ro_verified_by
  FROM (SELECT {KS}, {PER}, bmrk_year, sum(cm_value)::BIGINT AS c, sum(pm_value)::BIGINT AS p, count(*) AS n
      FROM fx_sample GROUP BY ALL)
  JOIN (VALUES ('01', 10), ('85', 9)) AS k(dt, f) ON dt = '01' OR estimate_type_code <> '4'"""

CTES["series_rows"] = f"""
  SELECT DISTINCT {K4}, bmrk_year AS year,
    ['B', 'I'][{_NATION} % 2 + 1] AS series_type_code, ['S', 'G', 'Q', 'D'][{_NATION} % 4 + 1] AS estimation_type_code,
    ['Y', 'Y', 'Y', 'N', 'Y'][{_NATION} % 5 + 1] AS is_published, ['1', '0', '2'][{_NATION} % 3 + 1] AS ws_flag
  FROM fx_estimates"""

CTES["salist"] = """
  SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS stid, n_name AS state,
    CASE WHEN n_nationkey % 3 = 0 THEN (40000 + n_nationkey)::VARCHAR ELSE '00000' END AS msa, n_name || ' area' AS area
  FROM nation"""

CTES["titles"] = """
  SELECT DISTINCT series_code, 'Series ' || series_code AS series_name FROM fx_estimates WHERE series_code LIKE '1%'"""

CTES["structure"] = f"""
  SELECT DISTINCT {of('s', K4)}, series_type_code, estimation_type_code, year, is_published,
    a.state AS state_name, a.area AS area_name, series_name,
    CASE ws_flag WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' ELSE ws_flag END AS ws_flag
  FROM series_rows s JOIN salist a ON s.state_fips_code = a.stid AND s.area_fips_code = a.msa
    LEFT JOIN titles t ON s.series_code = t.series_code
  WHERE year = '2000' AND data_type_code IN ('01', '85') AND series_type_code IN ('B', 'I', 'C')
    AND (is_published = 'Y' OR (data_type_code = '01' AND series_type_code = 'B'))"""

CTES["periods"] = f"SELECT DISTINCT {PER} FROM fx_estimates WHERE estimate_type_code <> '4'"

CTES["reference_periods"] = f"""
  SELECT {PER}, {PM_YEAR} AS pm_y, {PM_MONTH} AS pm, {PM_CLOSING} AS pm_closing,
    (year::INT - 1)::VARCHAR AS p12m_y, month AS p12m,
    CASE WHEN estimate_type_code = '3' OR month < '10' THEN '4' ELSE '3' END AS p12m_closing, {BMRK} AS bmrkyr,
    CASE WHEN estimate_type_code = '3' AND month = '12' THEN '1' WHEN estimate_type_code = '3' THEN '2'
      WHEN estimate_type_code = '2' THEN '1' END AS prior_closing,
    CASE estimate_type_code WHEN '3' THEN (year::INT - 1)::VARCHAR WHEN '2' THEN (year::INT - 1)::VARCHAR END AS prior_closing_bmrkyr
  FROM periods"""

CTES["requests"] = """
  SELECT year AS sel_year, month AS sel_month, estimate_type_code AS sel_closing, t AS this_closing, p12m_y,
    pm_y, pm, pm_closing, p12m, p12m_closing
  FROM (SELECT *, estimate_type_code AS t FROM reference_periods
    UNION ALL SELECT *, prior_closing FROM reference_periods WHERE prior_closing IS NOT NULL)"""

_TREATMENT = "recalc_estimate_value - original_estimate_value - sample_adjustment - non_sample_adjustment"
CTES["adjusted"] = f"""
  SELECT *, {rnd_long('sample_adjustment')} AS estimate_adjustment, {rnd_long('non_sample_adjustment')} AS nse,
    {rnd_long(_TREATMENT)} AS sample_treatment,
    {rnd_long('published_estimate_value - recalc_estimate_value')} AS ratio_adjustment
  FROM fx_estimates"""

CTES["tolerated"] = f"""
  SELECT e.* REPLACE (CASE WHEN e.data_type_code = '85' THEN a.upper_tolerance ELSE e.upper_tolerance END AS upper_tolerance,
      CASE WHEN e.data_type_code = '85' THEN a.lower_tolerance ELSE e.lower_tolerance END AS lower_tolerance)
  FROM adjusted e LEFT JOIN (SELECT * FROM fx_estimates WHERE data_type_code = '01') a ON {on('e', 'a', KS + ',' + PER)}"""

def _role(name: str, year: str, month: str, closing: str) -> str:
    return f"""SELECT t.*, s.series_type_code, s.ws_flag, {of('r', REQ)}, r.p12m_y, '{name}' AS role
  FROM tolerated t JOIN (SELECT DISTINCT {K4}, series_type_code, ws_flag FROM structure) s ON {on('t', 's', K4)}
  JOIN requests r ON t.year = r.{year} AND t.month = r.{month} AND t.estimate_type_code = r.{closing}"""


CTES["panel"] = " UNION ALL ".join((
    _role("cm", "sel_year", "sel_month", "this_closing"), _role("pm", "pm_y", "pm", "pm_closing"),
    _role("p12m", "p12m_y", "p12m", "p12m_closing")))

_NULLED = """CASE WHEN role = 'cm' THEN original_estimate_value END AS original_estimate_value,
    CASE WHEN role = 'cm' THEN recalc_estimate_value END AS recalc_estimate_value"""
CTES["backfilled"] = f"""
  SELECT * EXCLUDE (b), max(b) = 1 AS backfilled FROM (
    SELECT * REPLACE ({_NULLED}), 0 AS b FROM panel
    UNION ALL BY NAME
    SELECT * REPLACE ({_NULLED}, '85' AS data_type_code), 1 AS b FROM panel
    WHERE data_type_code = '01' AND role <> 'cm')
  GROUP BY ALL"""

CTES["year_ago"] = f"""
  SELECT {KS}, year, month, {cut('published_estimate_value')}::DOUBLE AS py FROM (
    SELECT *, max(estimate_type_code) OVER (PARTITION BY {KS}, year, month) AS newest FROM fx_estimates)
  WHERE data_type_code = '01' AND estimate_type_code = newest"""

CTES["metrics"] = f"""
  SELECT m.*, y.py, cm - py AS oty_change, cm - pm AS otm_change,
    original_estimate_value - py AS orig_oty_change, original_estimate_value - pm AS orig_otm_change,
    recalc_estimate_value - py AS recalc_oty_change, recalc_estimate_value - pm AS recalc_otm_change
  FROM (SELECT *, published_estimate_value AS cm,
      lag(published_estimate_value) OVER (PARTITION BY {K4}, series_type_code, {REQ} ORDER BY year, month, backfilled) AS pm
    FROM backfilled) m
  LEFT JOIN year_ago y ON {on('m', 'y', KS + ',month')} AND m.p12m_y = y.year
  WHERE role = 'cm'"""

CTES["comments_before"] = f"""
  SELECT *, lag(analyst_comment) OVER (PARTITION BY {K4}, series_type_code, {REQ} ORDER BY year, month) AS pm_comment
  FROM panel"""

_TOL = "CASE WHEN m.data_type_code IN ('01', '85', '06') THEN {1} * 100 ELSE m.{0} * m.pm END"
CTES["info"] = f"""
  SELECT *, CASE WHEN cm > hi_tolerance THEN 'H' WHEN cm < lo_tolerance THEN 'L' ELSE '' END AS oot FROM (
    SELECT m.* EXCLUDE (role, backfilled, p12m_y), c.pm_comment,
      {_TOL.format('upper_tolerance', rnd('m.upper_tolerance * m.pm / 100'))} AS hi_tolerance,
      {_TOL.format('lower_tolerance', rnd('m.lower_tolerance * m.pm / 100'))} AS lo_tolerance
    FROM metrics m JOIN comments_before c
      ON {on('m', 'c', f'{SEL}, series_type_code, {REQ}')})"""


def _version(name: str, order: int, est: str, prefix: str | None, pm: str, only_asked: bool = False) -> str:
    otm = cut(f"{prefix}otm_change") if prefix is not None else "NULL::BIGINT"
    oty = cut(f"{prefix}oty_change") if prefix is not None else "NULL::BIGINT"
    where = "WHERE this_closing = sel_closing" if only_asked else ""
    return f"""SELECT {K4}, series_type_code, {REQ}, '{name}' AS base, {order} AS ord, {cut(est)} AS est, {pm} AS pm,
      {otm} AS otm, {oty} AS oty, {otm}::DOUBLE / nullif({cut('pm')}, 0) AS otm_pct,
      {oty}::DOUBLE / nullif({cut('pm')}, 0) AS oty_pct FROM info {where}"""


CTES["comparison"] = f"""
  SELECT {K4}, series_type_code, {REQ},
    CASE WHEN this_closing = sel_closing THEN ord
      ELSE CASE base WHEN 'pub' THEN 6 WHEN 'recalc' THEN 7 ELSE 8 END END::BIGINT AS row_order,
    CASE WHEN this_closing = sel_closing THEN base ELSE 'p-' || base END AS version, est, pm, otm, oty, otm_pct, oty_pct
  FROM ({_version('pub', 1, 'published_estimate_value', '', cut('pm'))}
    UNION ALL {_version('hi-tol', 2, 'hi_tolerance', None, 'NULL::BIGINT', True)}
    UNION ALL {_version('lo-tol', 3, 'lo_tolerance', None, 'NULL::BIGINT', True)}
    UNION ALL {_version('recalc', 4, 'recalc_estimate_value', 'recalc_', 'NULL::BIGINT')}
    UNION ALL {_version('orig', 5, 'original_estimate_value', 'orig_', 'NULL::BIGINT')})"""

CTES["parsed"] = f"""
  SELECT *, coalesce(CASE
      WHEN adjreason IN ('MS', 'SI') AND adjtype = 'OT' THEN adjreason || '-' || lower(substr(adjsubtype, 3, 1)) || ': ' || adjamt
      WHEN adjtype = 'RW' THEN 'RW-' || lower(substr(adjsubtype, 1, 1)) || ': ' || adjamt
      WHEN adjtype = 'Manual' THEN 'RW-m: ' || adjamt
      ELSE adjtype || ': ' || adjamt END, {cut('sample_adjustment')}::VARCHAR) AS est_adj
  FROM (SELECT *, {part(1)} AS adjtype, {part(2)} AS adjamt, {part(4)} AS adjsubtype, {part(5)} AS adjreason FROM adjusted)"""

CTES["history"] = f"""
  SELECT {KS}, year, month, estimate_type_code AS closing, published_estimate_value, upper_tolerance, lower_tolerance,
    adjtype, adjsubtype, adjamt, adjreason, est_adj, {cut('original_estimate_value')} AS orig_est,
    estimate_adjustment AS est_adj_value, nse, sample_treatment AS sample_adj, ratio_adjustment AS ratio_adj,
    analyst_comment AS est_adj_cmnt, {cut('published_estimate_value')} AS rvalue,
    {cut('upper_tolerance * before')} AS hitol, {cut('lower_tolerance * before')} AS lotol
  FROM (SELECT *, lag(published_estimate_value) OVER (PARTITION BY {KS} ORDER BY year, month) AS before,
      row_number() OVER (PARTITION BY {KS} ORDER BY year DESC, month DESC) AS back
    FROM (SELECT *, max(estimate_type_code) OVER (PARTITION BY {KS}, year, month) AS newest,
        max(year) OVER (PARTITION BY {KS}) AS last_year FROM parsed)
    WHERE data_type_code = '01' AND estimate_type_code = newest AND year::INT > last_year::INT - 3)
  WHERE back <= 27"""


CTES["vintaged"] = """
  SELECT *, CASE WHEN bmrk_year = '2001' THEN 'current' ELSE bmrk_year END AS vintage FROM fx_estimates"""
CTES["release_vintages"] = f"""
  SELECT {PER}, main || coalesce('+' || earlier, '') AS view, rank, CASE rank WHEN 0 THEN main ELSE earlier END AS vintage,
    CASE rank WHEN 0 THEN main ELSE earlier END IN (SELECT vintage FROM vintaged) AS held
  FROM (SELECT *, CASE WHEN bmrkyr IN (SELECT vintage FROM vintaged) THEN bmrkyr ELSE 'current' END AS main,
      CASE WHEN month IN ('10', '11', '12') AND estimate_type_code = '3' THEN (bmrkyr::INT - 1)::VARCHAR END AS earlier
    FROM reference_periods) JOIN range(0, 2) k(rank) ON rank = 0 OR earlier IS NOT NULL"""
CTES["view_vintages"] = "SELECT DISTINCT view, vintage FROM release_vintages"

CTES["release_history"] = f"""
  SELECT {KS}, sel_year, sel_month, sel_closing, year, month, estimate_type_code AS closing, published_estimate_value, upper_tolerance,
    lower_tolerance, adjtype, adjsubtype, adjamt, adjreason, est_adj, {cut('original_estimate_value')} AS orig_est,
    estimate_adjustment AS est_adj_value, nse, sample_treatment AS sample_adj, ratio_adjustment AS ratio_adj,
    analyst_comment AS est_adj_cmnt, {cut('published_estimate_value')} AS rvalue,
    {cut('upper_tolerance * before')} AS hitol, {cut('lower_tolerance * before')} AS lotol
  FROM (SELECT *, lag(published_estimate_value) OVER (PARTITION BY {KS}, sel_year, sel_month, sel_closing ORDER BY year, month) AS before,
      row_number() OVER (PARTITION BY {KS}, sel_year, sel_month, sel_closing ORDER BY year DESC, month DESC) AS back
    FROM (SELECT e.*, p.year AS sel_year, p.month AS sel_month, p.estimate_type_code AS sel_closing,
        max(e.estimate_type_code) OVER (PARTITION BY {of('e', KS)}, p.year, p.month, p.estimate_type_code, e.year, e.month) AS newest
      FROM parsed e JOIN periods p ON e.year::INT > p.year::INT - 3
        AND (e.year || e.month < p.year || p.month OR (e.year = p.year AND e.month = p.month AND e.estimate_type_code <= p.estimate_type_code)))
    WHERE data_type_code = '01' AND estimate_type_code = newest)
  WHERE back <= 27"""


def _measures(label: str) -> str:
    return f"""{label} AS a_typ_flag, count(DISTINCT report_id) + max((report_id IS NULL)::INT) AS rep_count,
    count(DISTINCT selected_ui_number) + max((selected_ui_number IS NULL)::INT) AS ui_count,
    sum(pm_value)::DOUBLE AS pm_emp, sum(cm_value)::DOUBLE AS cm_emp,
    {total('wpm')} AS pm_weighted_emp, {total('wcm')} AS cm_weighted_emp"""


_DIRECTION = "CASE WHEN cm_value > pm_value THEN 'Inc' WHEN cm_value < pm_value THEN 'Dec' ELSE 'Const' END"
CTES["flags"] = f"""
  SELECT *, CASE WHEN a_typ_flag IN ('U', 'X') THEN 0 ELSE cm_emp::BIGINT - pm_emp::BIGINT END::BIGINT AS unwotm
  FROM (SELECT {SEL}, {_measures('a_typ_flag')} FROM weighted GROUP BY {SEL}, a_typ_flag)"""
CTES["signs"] = f"""
  SELECT *, cm_emp::BIGINT - pm_emp::BIGINT AS unwotm
  FROM (SELECT {SEL}, {_measures('dir')} FROM (SELECT *, {_DIRECTION} AS dir FROM weighted WHERE a_typ_flag IN ('A', 'T'))
    GROUP BY {SEL}, dir)"""

_SUMMED = ("rep_count", "ui_count", "pm_emp", "cm_emp", "pm_weighted_emp", "cm_weighted_emp", "unwotm")
CTES["sums"] = f"""
  SELECT {SEL}, 'Sum' AS a_typ_flag, {', '.join(
      f"coalesce(sum({c}) FILTER (a_typ_flag IN ('A', 'T')), 0)::{'DOUBLE' if c.endswith('emp') else 'BIGINT'} AS {c}" for c in _SUMMED)}
  FROM flags GROUP BY {SEL}"""
CTES["published"] = f"""
  SELECT DISTINCT {SEL}, {cut('pm')} AS pm_est, {cut('cm')} AS pub_est FROM info WHERE this_closing = sel_closing"""


def _shares(name: str, emp: dict[str, str]) -> str:
    cells = ", ".join(f"{value}::DOUBLE / nullif({base}, 0) AS {c}" for c, (value, base) in emp.items())
    return f"'{name}' AS a_typ_flag, 0::BIGINT AS rep_count, 0::BIGINT AS ui_count, {cells}, 0::BIGINT AS unwotm"


_COVERAGE = _shares("Coverage", {
    "pm_emp": ("pm_emp", "pm_est"), "cm_emp": ("cm_emp", "pub_est"),
    "pm_weighted_emp": ("pm_weighted_emp", "pm_est"), "cm_weighted_emp": ("cm_weighted_emp", "pub_est")})
_PM_COVERAGE = _shares("Pm-Covg", {
    "pm_emp": ("coalesce(w.a, 0)", "pm_est"), "cm_emp": ("coalesce(w.b, 0)", "pm_est"),
    "pm_weighted_emp": ("coalesce(w.c, 0)", "pm_est"), "cm_weighted_emp": ("coalesce(w.d, 0)", "pub_est")})
CTES["covered"] = f"SELECT {SEL}, {_COVERAGE} FROM sums JOIN published USING ({SEL})"
CTES["pm_covered"] = f"""
  SELECT {of('p', SEL)}, {_PM_COVERAGE}
  FROM (SELECT *, {PM_YEAR} AS py, {PM_MONTH} AS pmo, {PM_CLOSING} AS pc FROM published) p
  LEFT JOIN (SELECT {SEL}, sum(pm_value) AS a, sum(cm_value) AS b, {total('wpm')} AS c, {total('wcm')} AS d
    FROM weighted GROUP BY {SEL}) w
  ON {on('p', 'w', K4)} AND p.py = w.year AND p.pmo = w.month AND p.pc = w.estimate_type_code"""
_ZEROS = ", ".join(f"coalesce({c}, 0)::{'DOUBLE' if c.endswith('emp') else 'BIGINT'} AS {c}" for c in _SUMMED)
CTES["sums_shown"] = f"SELECT {SEL}, 'Sum' AS a_typ_flag, {_ZEROS} FROM published LEFT JOIN sums USING ({SEL})"
CTES["covered_shown"] = f"SELECT {SEL}, {_COVERAGE} FROM sums_shown JOIN published USING ({SEL})"
CTES["summary"] = f"""
  SELECT {SEL}, list_position(['T','A','Sum','Coverage','Pm-Covg','Inc','Dec','Const','U','X'], a_typ_flag)::BIGINT AS row_order,
    a_typ_flag AS sample, rep_count AS report, ui_count AS ui, pm_emp AS pm, cm_emp AS cm, unwotm AS otm,
    pm_weighted_emp AS wpm, cm_weighted_emp AS wcm
  FROM (FROM flags UNION ALL BY NAME FROM sums_shown UNION ALL BY NAME FROM covered_shown UNION ALL BY NAME FROM pm_covered
    UNION ALL BY NAME FROM signs) SEMI JOIN published USING ({SEL})"""

CTES["reports"] = f"""
  SELECT *, rept_sfc AS reptstate, selected_ui_number AS ui, report_with AS reptw, rept_sfc || report_id AS report,
    naics_code AS naics, selection_size::BIGINT AS selsize, sample_weight AS weight,
    round_even(original_cont_tot_dwnwght, 2) AS origdwght, round_even(cont_tot_dwnwght, 2) AS dwght, diff_resp_rate AS drr,
    pm_value AS pm, cm_value AS cm, original_a_typ_flag AS origflag, a_typ_flag AS flag,
    cm_value - pm_value AS otm, coalesce(cm_comment_1 = '93', false) AS is_knr,
    {rnd('wgt * pm_value')} AS rwpm, {rnd('wgt * cm_value')} AS rwcm
  FROM wotm"""


def codes(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN coalesce({b}, '') WHEN {b} IS NULL OR {a} = {b} THEN {a} "
            f"ELSE least({a}, {b}) || ',' || greatest({a}, {b}) END")


_REPORT = "reptstate, ui, reptw, report"
_DETAIL_URL = """'/sample-history?reptstate=' || coalesce(reptstate, '') || '&ui=' || coalesce(ui, '') || '&report='
    || coalesce(report, '') || '&flag=' || coalesce(flag, '') || '&knr=' || CASE WHEN is_knr THEN 'Y' ELSE '' END
    || '&row_type=' || {0} AS history_url,
    '?q=' || coalesce(reptstate, '') || ';' || coalesce(ui, '') || ';00000;9999;' AS ui_url,
    '?q=' || coalesce(reptstate, '') || ';' || coalesce(substr(report, 3), '') AS report_url"""
CTES["detail"] = f"""
  SELECT *, greatest(greatest(pm_size, cm_size) - selsize, 0) AS szgap, {_DETAIL_URL.format("'detail'")} FROM (
    SELECT {of('r', SEL)}, {of('r', _REPORT)}, r.naics, r.selsize, {size('r.pm')} AS pm_size, {size('r.cm')} AS cm_size,
      r.weight, b.dwght AS pm_dwght, r.origdwght, r.dwght, r.drr, r.pm, r.cm, b.flag AS pm_flag, e.flag AS prior_flag,
      r.origflag, r.flag, {codes('r.pm_comment_1', 'r.pm_comment_2')} AS pmcc, {codes('r.cm_comment_1', 'r.cm_comment_2')} AS cmcc,
      r.otm, r.wotm, r.rwpm AS wpm, r.rwcm AS wcm, r.is_knr
    FROM (SELECT *, {PM_YEAR} AS py, {PM_MONTH} AS pmo, {PM_CLOSING} AS pc,
        CASE WHEN estimate_type_code = '3' AND month = '12' THEN '1' WHEN estimate_type_code = '3' THEN '2'
          WHEN estimate_type_code = '2' THEN '1' END AS ec FROM reports) r
    LEFT JOIN reports b ON {on('r', 'b', K4 + ',' + _REPORT)} AND r.py = b.year AND r.pmo = b.month AND r.pc = b.estimate_type_code
    LEFT JOIN reports e ON {on('r', 'e', K4 + ',' + _REPORT + ',year,month')} AND r.ec = e.estimate_type_code)
  WHERE pm_size IS NOT NULL AND cm_size IS NOT NULL"""

_GROUP = "reptstate, ui, flag, is_knr"


def agree(c: str, other: str) -> str:
    return (f"CASE WHEN count(DISTINCT {c}) + max(({c} IS NULL)::INT) = 1 THEN min({c}) ELSE {other} END AS {c}")


def merged(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split({c}, ',')) FILTER ({c} <> '')))), ','), '')"


# NAICS codes of the test tables have six digits.
_PREFIX = "CASE " + " ".join(f"WHEN left(lo, {n}) = left(hi, {n}) THEN left(lo, {n})" for n in range(6, 0, -1)) + " ELSE '' END"
CTES["rollup"] = f"""
  SELECT *, {_DETAIL_URL.format('row_type')} FROM (
    SELECT * EXCLUDE (lo, hi) REPLACE (CASE WHEN detail_count > 1 THEN reptw ELSE report END AS report),
      {size('pm')} AS pm_size, {size('cm')} AS cm_size,
      greatest(greatest({size('pm')}, {size('cm')}) - selsize, CASE WHEN selsize IS NOT NULL THEN 0 END) AS szgap,
      {_PREFIX} AS naics, detail_count > 1 AS is_summed,
      CASE WHEN detail_count > 1 THEN 'summary' ELSE 'single' END AS row_type
    FROM (SELECT {SEL}, {_GROUP}, count(*) AS detail_count,
        {', '.join(f'sum({c})::{t} AS {c}' for c, t in
                   (('pm', 'BIGINT'), ('cm', 'BIGINT'), ('wpm', 'DOUBLE'), ('wcm', 'DOUBLE'), ('otm', 'BIGINT'), ('wotm', 'DOUBLE')))},
        {merged('pmcc')} AS pmcc, {merged('cmcc')} AS cmcc,
        {', '.join(agree(c, "''") for c in ('report', 'reptw', 'pm_flag', 'origflag', 'prior_flag'))},
        {', '.join(agree(c, 'NULL') for c in ('selsize', 'weight', 'pm_dwght', 'origdwght', 'dwght', 'drr'))},
        min(naics) AS lo, max(naics) AS hi
      FROM detail GROUP BY {SEL}, {_GROUP})
    WHERE {size('pm')} IS NOT NULL AND {size('cm')} IS NOT NULL)"""

CTES["current"] = f"SELECT d.*, v.view FROM detail d JOIN (SELECT DISTINCT {PER}, view FROM release_vintages) v USING ({PER})"
CTES["viewed_reports"] = f"""
  SELECT *, max(estimate_type_code) OVER (PARTITION BY view, {K4}, year, month) AS newest FROM (
    SELECT r.*, v.view FROM reports r JOIN view_vintages v
      ON v.vintage = CASE WHEN bmrk_year = '2001' THEN 'current' ELSE bmrk_year END)"""
CTES["sample_history"] = f"""
  SELECT {of('r', K4)}, r.year, r.month, r.version, {of('r', _REPORT)}, r.naics, r.selsize, r.weight, r.origdwght, r.dwght, r.drr,
    r.pm, r.cm, r.origflag, r.flag, r.otm, r.wotm, r.rwpm AS wpm, r.rwcm AS wcm, r.is_knr,
    concat_ws(',', r.cm_comment_1, r.cm_comment_2) AS cmcc,
    c.year AS cur_year, c.month AS cur_month, c.estimate_type_code AS cur_closing, c.is_knr AS cm_knr, c.flag AS cm_flag
  FROM viewed_reports r JOIN current c ON r.view = c.view AND {on('r', 'c', K4 + ',report')}
  WHERE r.estimate_type_code IN ('1', '2', '3') AND r.estimate_type_code = newest
    AND r.year || r.month || r.estimate_type_code <= c.year || c.month || c.estimate_type_code"""


def history_keys(row_type: str) -> str:
    return f"{K4}, cur_year, cur_month, cur_closing, reptstate, ui, " + ("cm_flag, cm_knr" if row_type == "summary" else "report")


_TEXTS = ("reptw", "naics", "version", "origflag", "flag", "cmcc")
for _type in ("summary", "detail"):
    _keys = history_keys(_type)
    CTES[f"history_{_type}"] = f"""
  SELECT {_keys}, is_knr, year, month, min(report) AS first_report,
    {', '.join(f"arg_min({c}, report) AS {c}" for c in _TEXTS)},
    {', '.join(f"arg_min({c}::VARCHAR, report) AS {c}" for c in ('selsize', 'weight', 'origdwght', 'dwght'))},
    arg_min(CASE WHEN flag = 'X' THEN 'black' WHEN flag = 'A' THEN 'red' WHEN dwght BETWEEN 0.3 AND 0.4 THEN 'orange' ELSE 'blue' END, report) AS colour,
    {', '.join(f"sum({c}::DECIMAL(38,3))::DOUBLE AS {c}" for c in ('pm', 'cm', 'otm', 'wotm'))}, count(*) AS report_rows
  FROM sample_history GROUP BY {_keys}, is_knr, year, month"""
    CTES[f"points_{_type}"] = f"""
  SELECT {_keys}, is_knr, colour, {MONTH_NAME.format('month')} || '''' || right(year, 2) AS segment,
    unnest([{{'axis': year::INT * 12 + month::INT - 2, 'value': pm, 'segment_end': 'pm'}},
      {{'axis': year::INT * 12 + month::INT - 1, 'value': cm, 'segment_end': 'cm'}}], recursive := true)
  FROM history_{_type} WHERE pm <> 0 AND cm <> 0"""
    CTES[f"axis_{_type}"] = f"""
  SELECT {_keys}, unnest(range(min(axis)::BIGINT, max(axis)::BIGINT + 1)) AS axis FROM points_{_type} GROUP BY {_keys}"""
    CTES[f"segments_{_type}"] = f"""
  SELECT {of('a', _keys)}, (a.axis // 12)::VARCHAR AS axis_year, lpad((a.axis % 12 + 1)::VARCHAR, 2, '0') AS axis_month,
    {MONTH_NAME.format('(a.axis % 12 + 1)')} || ' ' || (a.axis // 12)::VARCHAR AS axis_label, segment, is_knr, colour, segment_end, value
  FROM axis_{_type} a LEFT JOIN points_{_type} p ON {on('a', 'p', _keys + ', axis')}"""

CTES["inputs"] = f"""
  SELECT {SEL}, cm, pm, py, birth_death_factor AS bdf, non_sample_adjustment AS nse, apm, acm, twpm, twcm
  FROM (SELECT DISTINCT {SEL}, cm, pm, py, birth_death_factor, non_sample_adjustment FROM info WHERE this_closing = sel_closing)
  JOIN (SELECT {SEL}, {', '.join(f"coalesce(sum({c}) FILTER (sample = '{r}'), 0)::DOUBLE AS {n}" for n, r, c in
      (('apm', 'A', 'pm'), ('acm', 'A', 'cm'), ('twpm', 'T', 'wpm'), ('twcm', 'T', 'wcm')))}
    FROM summary GROUP BY {SEL}) USING ({SEL})"""

CTES["wide_catalog"] = """
  SELECT DISTINCT lpad(s_nationkey::VARCHAR, 2, '0') AS state, lpad((p_size * 100)::VARCHAR, 5, '0') AS area,
    (10 + l_partkey % 35)::VARCHAR || lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 3, '0') || '000' AS series,
    CASE WHEN p_type < 'M' THEN 'B' ELSE 'I' END AS seriestype, CASE l_linestatus WHEN 'F' THEN 'Y' ELSE 'N' END AS toplev,
    CASE l_returnflag WHEN 'R' THEN '85' ELSE '01' END AS datatype, CASE l_returnflag WHEN 'A' THEN 'Y' ELSE 'N' END AS oot
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""

CTES["report_lines"] = """
  SELECT l_returnflag AS sample_group, 'SX' || lpad(l_suppkey::VARCHAR, 6, '0') AS parent_report,
    'CH' || lpad(l_partkey::VARCHAR, 8, '0') AS report, floor(l_extendedprice / 1000)::BIGINT AS cm,
    l_quantity::BIGINT AS pm, floor(l_extendedprice / 1000)::BIGINT - l_quantity::BIGINT AS otm
  FROM lineitem"""


def query(body: str, tables: dict[str, str] | None = None) -> str:
    """The body with every table expression it needs, in definition order."""
    tables = CTES if tables is None else tables
    names = list(tables)
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in names:
            if name not in needed and _mentions(text, name):
                needed.add(name)
                pending.append(tables[name])
    ctes = [f"{name} AS MATERIALIZED ({tables[name]})" for name in names if name in needed]
    own = body.strip()
    if own.startswith("WITH "):
        return ",\n".join(["WITH " + ctes[0], *ctes[1:], own[5:]]) if ctes else own
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + own


# --- several vintages with other values ------------------------------------------
#
# Facts of a view are series of their own here, told apart by a mark behind the series
# code, so that every definition above holds for each view by itself.  At the end only
# the rows of a release's own view count.

_OWN = "split_part({0}series_code, '|', 2)"
_RESTATED = {
    "fx_sample_given": CTES["fx_sample"],
    "fx_given": CTES["fx_estimates"].replace("fx_sample", "fx_sample_given"),
    "vintaged": CTES["vintaged"].replace("fx_estimates", "fx_given"),
    "periods": CTES["periods"].replace("fx_estimates", "fx_given"),
    "reference_periods": CTES["reference_periods"],
    "release_vintages": CTES["release_vintages"],
    "release_views": f"SELECT DISTINCT {PER}, view FROM release_vintages",
    "views": "SELECT DISTINCT view, rank, vintage FROM release_vintages",
}
_NEXT = "CASE WHEN bmrk_year = '2000' THEN 'current' ELSE (bmrk_year::INT + 1)::VARCHAR END"
for _name, _base, _later, _which in (
    ("fx_estimates", "fx_given", "published_estimate_value + 1000 AS published_estimate_value, upper_tolerance + 0.5 AS upper_tolerance", "data_type_code = '01'"),
    ("fx_sample", "fx_sample_given", "2 * cm_value + 1000 AS cm_value", "true"),
):
    _in = "CASE WHEN bmrk_year = '2001' THEN 'current' ELSE bmrk_year END"
    _RESTATED[f"{_name}_stored"] = f"""
  SELECT *, {_in} AS vintage FROM {_base} UNION ALL BY NAME
  SELECT * REPLACE ({_later}), {_NEXT} AS vintage FROM {_base} WHERE {_which} AND bmrk_year <> '2001'"""
    _RESTATED[f"{_name}_newer"] = f"SELECT DISTINCT view, {PER} FROM {_name}_stored JOIN views USING (vintage) WHERE rank = 0"
    _RESTATED[_name] = f"""
  SELECT * EXCLUDE (vintage, view, rank) REPLACE (series_code || '|' || view AS series_code)
  FROM {_name}_stored JOIN views USING (vintage) WHERE rank = 0 OR (view, {PER}) NOT IN (FROM {_name}_newer)"""
_RESTATED["marked"] = "SELECT g.* REPLACE (series_code || '|' || view AS series_code) FROM fx_given g, (SELECT DISTINCT view FROM views)"
_RESTATED["series_rows"] = CTES["series_rows"].replace("fx_estimates", "marked")
RESTATED = {**_RESTATED, **{name: text for name, text in CTES.items() if name not in _RESTATED}}
RESTATED["current"] = f"SELECT d.*, view FROM detail d JOIN release_views v USING ({PER}) WHERE {_OWN.format('d.')} = view"
RESTATED["viewed_reports"] = f"SELECT *, {_OWN.format('')} AS view, max(estimate_type_code) OVER (PARTITION BY {K4}, year, month) AS newest FROM reports"


def restated(columns: str, table: str, release: str = "sel_year, sel_month, sel_closing") -> str:
    """Rows of a table that belong to their release's own view."""
    left = [c.strip() for c in release.split(",")]
    same = " AND ".join(f"t.{c} = v.{p}" for c, p in zip(left, ("year", "month", "estimate_type_code")))
    return query(f"""SELECT {columns} FROM (
    SELECT t.* REPLACE (split_part(t.series_code, '|', 1) AS series_code) FROM {table} t JOIN release_views v ON {same} AND {_OWN.format('t.')} = v.view)""", RESTATED)


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ( ").replace(")", " ) ").split()
    return any(w == name and i and words[i - 1].upper() in ("FROM", "JOIN") for i, w in enumerate(words))
