"""Reading adjustments out of analyst comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the layout of an adjustment comment.  Groups: 1 type, 2 amount,
# 4 subtype (optional), 5 reason.
ADJUSTMENT_PATTERN = (
    r"(Manual|OT|EM|RW|R1), Amt: (-?\d+)"
    r"(?:,\s+(Type:|adj Y1 weight to) (\w+))?"
    r".+\{(SI|MS|SR|SM|MR)\}"
)


def adjustment_parts(comment: Column) -> dict[str, Column]:
    def group(number: int) -> Column:
        return F.nullif(F.regexp_extract(comment, ADJUSTMENT_PATTERN, number), F.lit(""))

    return {"adjtype": group(1), "adjamt": group(2), "adjsubtype": group(4), "adjreason": group(5)}


def adjustment_label(kind: Column, amount: Column, subtype: Column, reason: Column,
                     sample_adjustment: Column) -> Column:
    """Short text such as 'MS-m: 912'; the plain adjustment when nothing parsed.

    The text is a name and the amount.  An adjustment over the month that has a reason
    of its own is named by it, reweighting of both sorts by RW, the rest by their type.
    Behind RW and a reason stands the letter of the subtype that tells variants apart.
    """
    by_reason = F.coalesce((kind == "OT") & reason.isin("MS", "SI"), F.lit(False))
    reweighted = kind.isin("RW", "Manual")
    name = F.when(by_reason, reason).when(reweighted, F.lit("RW")).otherwise(kind)
    place = F.when(by_reason, 3).when(kind == "RW", 1)
    letter = F.when(kind == "Manual", F.lit("m")).otherwise(F.lower(F.substring(subtype, place, F.lit(1))))
    full = F.when(by_reason | reweighted, F.concat(name, F.lit("-"), letter)).otherwise(name)
    return F.coalesce(F.concat(full, F.lit(": "), amount), sample_adjustment.cast("bigint").cast("string"))


def moved_to_first_link(estimator: Column, comment: Column) -> Column:
    """Whether the comment says the estimate uses the y1 link."""
    text = F.lower(F.coalesce(comment, F.lit("")))
    return (
        F.when(estimator == "S", F.replace(text, F.lit(" "), F.lit("")).contains("adjustedtoy1link"))
        .when(estimator == "Q", ~text.contains("y2"))
        .otherwise(False)
    )
