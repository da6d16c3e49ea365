"""Line-first quality rules.

Every line of a text is judged by itself; lines that fail are taken out, and a
document that loses too much of its text with them is rejected.  A line fails by

- punctuation: over a tenth as many symbols, or runs of exclamation and question
  marks, as words;
- navigation: under five words without any sentence mark, as in menus;
- boilerplate: a fixed phrase of page furniture, or the same line earlier in the text.

All of it is column expressions over the one row: no shuffle, no Python.  What a
text repeats is found by sorting the hashes of its 5-word windows, so the time per
document is n log n in its words, also for texts that repeat everything.

Defined results: a null text counts as empty; it has no words, so it fails, like
every text under ten words; repeated rows are judged one by one; an empty table
gives an empty result.  Internal columns stand in one struct, so that no name of
the input can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.llm.common import let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
MARKS = "[!?]{2,}"
SENTENCE_MARK = "[.!?:;…。]"
#: Fixed phrases of page furniture.
FURNITURE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "click here", "sign up for our newsletter", "skip to content", "lorem ipsum",
)
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
MENU_WORDS, WORDS_PER_SYMBOL = 5, 10
#: A document goes if it loses more than this share of the characters of its lines.
MAX_LOST = 0.3


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def line_failure(line: Column) -> Column:
    """The name of the rule that a line fails, or null."""

    def judge(n):
        return (
            F.when(line.rlike(SYMBOL) & (_count(line, SYMBOL) * WORDS_PER_SYMBOL > n), "punctuation")
            .when(line.rlike(MARKS) & (_count(line, MARKS) * WORDS_PER_SYMBOL > n), "punctuation")
            .when((n < MENU_WORDS) & ~line.rlike(SENTENCE_MARK), "navigation")
            .when(line.rlike("(?i)" + "|".join(FURNITURE)), "boilerplate")
        )

    return let(_count(line, WORD), judge)


def repeated_words(words: Column) -> Column:
    """How many words stand in windows whose hash occurs again among the windows."""

    def windows(hashes):
        def at(i):
            return F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])

        return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), at)).otherwise(
            F.array().cast("array<bigint>")
        )

    def covered(ranked):
        def again(pair, i):
            before, after = F.get(ranked, i - 1)["h"], F.get(ranked, i + 1)["h"]
            return F.coalesce(before == pair["h"], F.lit(False)) | F.coalesce(after == pair["h"], F.lit(False))

        starts = F.sort_array(F.transform(F.filter(ranked, again), lambda pair: pair["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            starts, none,
            lambda sofar, i: F.struct((sofar["n"] + F.least(F.lit(WINDOW), i - sofar["last"])).alias("n"), i.alias("last")),
        )["n"]

    def count(hashes):
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ranked, covered))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def assessment(text: Column) -> Column:
    """A struct of all counts and the verdict on one text."""
    text = F.coalesce(text, F.lit(""))

    def long(value: Column, name: str) -> Column:
        return value.cast("bigint").alias(name)

    def of_words(words):
        return F.struct(
            long(F.size(words), "n_words"), long(F.length(F.array_join(words, "")), "word_chars"), long(repeated_words(words), "n_repeat_words")
        )

    def of_lines(lines):
        def of_first(first):
            kept = F.filter(first, lambda line: line_failure(line).isNull())
            return let(
                F.array_join(kept, "\n"),
                lambda clean: F.struct(
                    long(F.size(lines) - F.size(first), "n_dup_lines"), long(F.size(lines), "n_lines"),
                    long(F.length(F.array_join(lines, "\n")), "n_chars_before"), long(F.length(clean), "n_chars_after"), clean.alias("clean_text"),
                ),
            )

        return let(F.array_distinct(lines), of_first)

    def verdict(both):
        words, lines = both["w"], both["l"]
        failed = (words["n_words"] < MIN_WORDS) | (100 * words["n_repeat_words"] > MAX_REPEATED_PERCENT * words["n_words"])
        lost = lines["n_chars_before"] - lines["n_chars_after"]
        return F.struct(
            words["n_words"].alias("n_words"), words["word_chars"].alias("word_chars"), both["s"].alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"), words["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & (lost <= MAX_LOST * lines["n_chars_before"])).alias("kept"),
            lines["n_lines"].alias("n_lines"), lost.alias("n_lost_chars"), lines["clean_text"].alias("clean_text"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return let(
        F.struct(
            let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("w"), let(lines, of_lines).alias("l"),
            long(_count(text, SYMBOL), "s"),
        ),
        verdict,
    )


def assess(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document, and what its lines lost."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lost_chars")
    judged = docs.select("doc_id", assessment(F.col("text")).alias("q"))
    return judged.select("doc_id", *[F.col("q")[name].alias(name) for name in names])


def clean(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with the lines that passed; all columns as given.

    n_chars, if there, follows the new text.
    """
    # As a filter the verdict would be computed a second time, below the projection.
    passed = F.filter(F.array(assessment(F.col("text"))), lambda q: q["kept"])
    judged = docs.select(F.struct("*").alias("row"), F.explode(passed).alias("q"))
    new = {"text": F.col("q.clean_text"), "n_chars": F.length("q.clean_text")}
    return judged.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
