"""Expressions on code strings and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_pad(code: Column, width: int) -> Column:
    """Left-pad numeric codes; longer and non-numeric codes stay as they are."""
    short = code.rlike("^[0-9]+$") & (F.length(code) < width)
    return F.when(short, F.lpad(code, width, "0")).otherwise(code)


def common_prefix(left: Column, right: Column) -> Column:
    """Longest shared prefix; empty when either side is null or empty."""
    shared = F.least(F.length(left), F.length(right))
    differing = F.filter(
        F.sequence(F.lit(1), shared),
        lambda i: F.substring(left, i, F.lit(1)) != F.substring(right, i, F.lit(1)),
    )
    length = F.coalesce(F.array_min(differing) - 1, shared)
    filled = (F.length(left) > 0) & (F.length(right) > 0)
    return F.when(filled, F.substring(left, F.lit(1), length)).otherwise("")


def code_label(code: Column, label: Column, width: int | None = None,
               separator: str = "-") -> Column:
    """'01-Jan' when a label exists, else the code alone."""
    shown = zero_pad(code, width) if width else code
    named = label.isNotNull() & (label != "")
    return F.when(named, F.concat(shown, F.lit(separator), label)).otherwise(shown)


def series_label(code: Column, series_type: Column, label: Column) -> Column:
    """'20-237000-B-name': the first two digits are set apart."""
    shown = F.when(
        F.length(code) == 8,
        F.concat(F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 6)),
    ).otherwise(code)
    full = F.concat_ws("-", shown, F.coalesce(series_type, F.lit("")), label)
    return F.when(label.isNotNull() & (label != ""), full).otherwise(shown)


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows something other than a letter or digit."""
    words = F.split(F.lower(text), r"(?<=[^\p{Alnum}])")
    return F.array_join(F.transform(words, lambda word: F.initcap(word)), "")


def verifier_name(account: Column) -> Column:
    """Short display name of an account such as 'jane.doe@example.org'."""
    # The service account and the text shown in its place.
    shown = title_case(F.regexp_replace(account, r"[.@].*$", ""))
    return F.regexp_replace(shown, r"Ces_Sa", "*Auto")


def code_order(code: Column) -> Column:
    """Sort key that puts numeric codes in numeric order, before text codes."""
    numeric = code.rlike("^[0-9]+$")
    return F.struct(
        (~numeric).alias("is_text"),
        F.when(numeric, code.try_cast("decimal(38,0)")).alias("number"),
        code.alias("code"),
    )


def joined_codes(*codes: Column) -> Column:
    """Distinct non-null codes of one row, comma separated, in code order."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*codes)))), ",")


def merged_code_lists(lists: Column) -> Column:
    """Aggregate: distinct codes over many comma separated lists.

    The state is the set of distinct lists in the group, which the code
    vocabulary bounds, however many rows the group has.
    """
    pieces = F.transform(
        F.collect_set(F.when(lists != "", lists)), lambda text: F.split(text, ",")
    )
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(pieces))), ",")


# Fixed value: one "flag: count" entry.
FLAG_COUNT_PATTERN = r"([ATX])\s*:\s*(\d+)"


def flag_counts(text: Column) -> Column:
    """'A: 3, T: 5' as an array of (flag, count); empty if anything else is in it."""
    pattern = F.lit(FLAG_COUNT_PATTERN)
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    pairs = F.zip_with(
        F.regexp_extract_all(trimmed, pattern, F.lit(1)),
        F.regexp_extract_all(trimmed, pattern, F.lit(2)),
        lambda flag, count: F.struct(flag.alias("flag"), count.alias("count")),
    )
    rest = F.translate(F.regexp_replace(trimmed, FLAG_COUNT_PATTERN, ""), " ,", "")
    return F.when(rest == "", pairs).otherwise(F.slice(pairs, 1, 0))
