"""Column groups that identify rows in the review tables."""

AREA_SERIES = ("state_fips_code", "area_fips_code", "series_code")
SERIES = (*AREA_SERIES, "data_type_code")
PERIOD = ("year", "month", "estimate_type_code")
SELECTION = (*SERIES, *PERIOD)

# The reports behind one rolled-up row of the sample.
UNIT_GROUP = ("reptstate", "ui", "flag", "is_knr")

# What was asked for (a period at a closing) and the closing being looked at,
# which is the asked one or the one released before it.
REQUEST = ("sel_year", "sel_month", "sel_closing", "this_closing")

# Set on facts of several data vintages: which vintages a row is read from (see
# periods.as_read).  A requested release has one view, so it is no key of results.
VIEW = "view"

# Set on unfolded histories that are dealt out by series (see history.unfold_history): the
# part a row is in, which its view, series and report decide, so it is no key of results.
PART = "part"


def keyed(rows, *columns: str) -> list[str]:
    """The columns, after the view and the part if the rows have them."""
    return [*[c for c in (VIEW, PART) if c in rows.columns], *columns]


ALL_EMPLOYEES = "01"
SERVICE_SECTOR = "85"
