"""Quality rules against a plain count in Python, and their verdicts."""

import collections
import random
import re

from estilens.llm import quality
from texts import prose

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    counts, hit = collections.Counter(runs), set()
    for k, run in enumerate(runs):
        if counts[run] > 1:
            hit |= set(range(k, k + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


def test_counts(frame, edge_rows):
    rows = edge_rows + [(20, "a b c d e f a b c d e g\na b c\na b c\n\n#$ | x")]
    got = quality.assess(frame(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *base(t))) for i, t in rows)


def test_lines_and_verdict(frame):
    good = "\n".join(prose(random.Random(k), 12) + "." for k in range(12))
    rows = [
        (1, good), (2, good + "\nHome\nAll rights reserved by us, the makers of it."),
        (3, "\n".join(f"{w} | item{k} | more{k} | now{k} | then{k}." for k, w in enumerate("abcdef"))),
        (4, good.replace(" ", "!! ")), (5, good + "\n" + good.split("\n")[0]),
    ]
    kept = {r["doc_id"]: r["text"] for r in quality.clean(frame(rows)).collect()}
    assert kept == {1: good, 2: good, 5: good}


def test_columns_and_empty_table(frame, edge_rows):
    docs = frame(edge_rows)
    assert quality.clean(docs).schema.names == docs.schema.names
    assert quality.clean(docs.limit(0)).count() == quality.assess(docs.limit(0)).count() == 0


def test_plan_is_native_and_narrow(frame, edge_rows):
    plan = quality.assess(frame(edge_rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Aggregate" not in plan
