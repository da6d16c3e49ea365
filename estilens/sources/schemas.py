"""Explicit schemas.  Codes are text: leading zeros matter."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


def _fields(names: str, kind) -> dict:
    return {name: kind for name in names.split()}


_TEXT, _WHOLE, _REAL = StringType(), LongType(), DoubleType()
_KEYS = "state_fips_code area_fips_code series_code data_type_code year month estimate_type_code"

ESTIMATES = _schema(
    **_fields(f"{_KEYS} bmrk_year estimation_type_code", _TEXT),
    **_fields(
        "published_estimate_value original_estimate_value recalc_estimate_value sample_adjustment "
        "non_sample_adjustment upper_tolerance lower_tolerance estimate_link_relative birth_death_factor",
        _REAL,
    ),
    **_fields("analyst_comment state_verified_by ro_verified_by", _TEXT),
)

MATCHED_SAMPLE = _schema(
    **_fields(
        f"{_KEYS} bmrk_year report_id rept_sfc report_with ui_number selected_ui_number naics_code "
        "ownership_code county_fips_code selection_size series_type_code version",
        _TEXT,
    ),
    **_fields("sample_weight diff_resp_rate cont_tot_dwnwght original_cont_tot_dwnwght", _REAL),
    **_fields("pm_value cm_value", _WHOLE),
    **_fields("a_typ_flag original_a_typ_flag pm_comment_1 pm_comment_2 cm_comment_1 cm_comment_2", _TEXT),
)

SMALL_DOMAIN_MODEL = _schema(
    **_fields(_KEYS, _TEXT),
    **_fields("weight_y1 weight_y2 weight_y4 link_y1 link_y2 link_y4 bdf_y1", _REAL),
)

THIRD_GENERATION_MODEL = _schema(
    **_fields(_KEYS, _TEXT),
    **_fields("beta y2_m pm_est y1 y1_st_adj syn y_hat orig_w1 orig_w2 orig_w3", _REAL),
)

SERIES_STRUCTURE = _schema(**_fields(
    "state_fips_code area_fips_code series_code data_type_code year series_type_code "
    "estimation_type_code is_published ws_flag", _TEXT))

AREAS = _schema(**_fields("stid state msa area", _TEXT))
SERIES_TITLES = _schema(**_fields("series_code series_name", _TEXT))

# The teaching CSV files.
REPORTS = _schema(**_fields("sample_group parent_report report", _TEXT), **_fields("cm pm otm", _WHOLE))
PLAIN_REPORTS = _schema(**_fields("parent_report report", _TEXT), **_fields("cm pm otm", _WHOLE))
TWO_LINES = _schema(data_series=_TEXT, **_fields("year month estimate benchmark", _WHOLE))
