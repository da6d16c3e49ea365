"""Exact duplicates against brute force, at every setting that must not matter."""

import hashlib
import random

import pytest

from estilens.llm import exact
from texts import prose


def brute(rows):
    ids = {}
    for i, text in rows:
        ids.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        group = ids[text or ""]
        keep = max((x for x in group if x is not None), default=None)
        out.append(str((i, keep, len(group), i == keep, hashlib.sha256((text or "").encode()).hexdigest())))
    return sorted(out)


def cases(edge_rows):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    rows = list(edge_rows) + [(100 + k, rng.choice(texts)) for k in range(150)]
    hot = prose(rng, 50)
    rows += [(1000 + k, hot) for k in range(120)]  # a third of all rows
    # Almost equal: other case, a space more, another form of the same letter.
    return rows + [(2000, texts[0].upper()), (2001, texts[0] + " "), (2002, "é"), (2003, "é"), (2004, "é")]


@pytest.mark.parametrize("settings", [
    {}, {"parts": 1, "salts": 1}, {"parts": 10, "salts": 3}, {"parts": 10, "salts": 3, "digest_bytes": 1}, {"parts": 1, "digest_bytes": 1},
])
def test_equals_brute_force(frame, edge_rows, settings):
    rows = cases(edge_rows)
    got = exact.duplicates(frame(rows, 7), **settings).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_hot_digests_are_bounded(spark):
    members = spark.range(1000).selectExpr("CASE WHEN id < 400 THEN 0 WHEN id < 600 THEN 1 ELSE id END AS digest", "IF(id = 999, 100000, 1) AS n_bytes")
    hot = {r[0] for r in exact.hot_digests(members, 10).collect()}
    assert hot == {0, 1, 999}  # by rows, by rows, by bytes


def test_keep_one_leaves_whole_rows(frame, edge_rows):
    rows = cases(edge_rows)
    docs = frame(rows)
    kept = exact.keep_one(docs)
    assert kept.schema == docs.schema
    got = kept.collect()
    expected = {(max((i for i, u in rows if (u or "") == (t or "") and i is not None), default=None), t or "") for _, t in rows}
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in got) == sorted(map(str, expected))


def test_empty_table(frame, edge_rows):
    docs = frame(edge_rows).limit(0)
    assert exact.duplicates(docs).count() == exact.keep_one(docs).count() == 0
