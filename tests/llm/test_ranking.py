"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from estilens.llm import ranking
from texts import prose

ITEMS = "item_id bigint, text string, score string, key string"


def terms_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(rows, items, k):
    docs = [(i, Counter(terms_of(t))) for i, t in rows]
    n_docs = sum(bool(c) for _, c in docs)
    n_all = sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked, scored = set(terms_of(text)), []
        for i, c in docs:
            m = 10 + 90 * c.total() * n_docs // n_all if n_all else 10
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [str((item, at, i, -s)) for at, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def cases(edge_rows):
    rng = random.Random(8)
    rows = list(edge_rows)
    for k in range(150):  # of very different lengths, some alike, with rare and common terms
        rows.append((100 + k, " ".join([prose(rng, rng.choice([1, 5, 40, 300]), rng.choice([5, 60, 400])), rng.choice(["Rare", "été-x", ""])])))
    rows += [(1000 + k, "hot copy of w1 w2 rare") for k in range(70)] + [(k, "hot copy of w1 w2 rare") for k in (500, 500, None)]
    items = [(k, prose(rng, n, 100).upper()) for k, n in enumerate([1, 2, 8, 40, 120])]
    items += [(10, "rare"), (11, "hot copy"), (12, "nowhere to find"), (13, None), (14, "--"), (None, "w3 w4 w3"), (15, "rare"), (15, "rare")]
    return rows, items


@pytest.mark.parametrize("k,block_terms,first_rows", [(10, 200_000, 20_000), (10, 200_000, 1), (3, 60, 20), (1000, 60, 50)])
def test_equals_brute_force(spark, frame, cases, k, block_terms, first_rows):
    rows, items = cases
    table = spark.createDataFrame([(*x, "?", "?") for x in items], ITEMS)
    got = ranking.ranked(frame(rows, 5), table, k, block_terms, first_rows).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, items, k)


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    n, n_terms = 3000, 200
    dense = rng.integers(1, 1000, (n, n_terms)) * (rng.random((n, n_terms)) < 0.05)
    dense = dense[dense.any(axis=1)]
    row, numbers = np.nonzero(dense)
    length = np.sqrt((dense.astype(float) ** 2).sum(axis=1))
    bucket = ranking.Bucket(numbers.astype(np.uint32), row, dense[row, numbers].astype(np.int64), length)
    for size in (3, 12, 40):
        wanted = rng.choice(n_terms, size, replace=False).astype(np.uint32)
        scores = dense[:, wanted].sum(axis=1)
        for floor in (0, int(np.sort(scores)[-10]), int(scores.max()), int(scores.max()) + 1):
            found, exact = bucket.survivors(wanted, floor)
            assert found.tolist() == np.flatnonzero(scores >= max(floor, 1)).tolist()
            assert (exact == scores[found]).all()
    assert not len(bucket.survivors(wanted, int(length.max() * np.sqrt(len(wanted))) + 1)[0])


def test_blocks_hold_all_queries(spark, cases):
    from estilens.llm.common import staged

    table = spark.createDataFrame([(*x, "?", "?") for x in cases[1]], ITEMS)
    queries = staged(ranking.query_terms(table), "queries")
    blocks = ranking.blocks_of(queries, 50)
    sizes = [[len(r["terms"]) for r in b.collect()] for b in blocks]
    assert len(blocks) > 2 and all(sum(s) <= 50 or len(s) == 1 for s in sizes)
    assert sum(len(s) for s in sizes) == len(cases[1])


def test_empty_tables(spark, frame, cases):
    rows, items = cases
    table = spark.createDataFrame([(*x, "?", "?") for x in items], ITEMS)
    assert ranking.ranked(frame(rows).limit(0), table).count() == 0
    assert ranking.ranked(frame(rows), table.limit(0)).count() == 0
