"""One query per text operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estilens.llm import (
    decontaminate, exact, fixity, language, licenses, mixing, pseudonyms, quality, ranking, resampling, secrets, simhash, substrings,
)
from estilens.llm.common import read_table
from estilens.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_rules(spark, sf_dir):
    return quality.assess(read_table(spark, sf_dir, "documents"))


@query
def op2_warc_fixity(spark, sf_dir):
    return fixity.audit_pages(read_table(spark, sf_dir, "pages"))


@query
def op3_language_id(spark, sf_dir):
    return language.identify(read_table(spark, sf_dir, "documents"))


@query
def op4_license_scans(spark, sf_dir):
    return licenses.scan_documents(read_table(spark, sf_dir, "documents"))


@query
def op5_secret_scans(spark, sf_dir):
    return secrets.report(read_table(spark, sf_dir, "documents"))


@query
def op6_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


@query
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op8_pii_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymise(read_table(spark, sf_dir, "documents"))


@query
def op9_source_mixing(spark, sf_dir):
    return mixing.mixing_rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).rates


@query
def op10_decontamination(spark, sf_dir):
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op11_exact_dedup(spark, sf_dir):
    return exact.duplicates(read_table(spark, sf_dir, "documents"))


@query
def op12_ranked_search(spark, sf_dir):
    return ranking.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_importance_resampling(spark, sf_dir):
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
