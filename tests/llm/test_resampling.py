"""Resampling against brute force; quickselect against a plain sort."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from estilens.llm import resampling
from estilens.llm.common import staged
from texts import prose

TARGET = "item_id bigint, text string, score string"


def features(text, max_run, buckets):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    runs = [" ".join(words[k:k + n]) for n in range(1, max_run + 1) for k in range(len(words) - n + 1)]
    return len(words), [crc32(r.encode()) % buckets for r in runs]


def brute(rows, target, max_run=1, buckets=10_000, percent=10):
    source, wanted = Counter(), Counter()
    for _, t in rows:
        source.update(features(t, max_run, buckets)[1])
    for t in target:
        wanted.update(features(t, max_run, buckets)[1])
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (source.total() + buckets) / ((source[b] + 1) * (wanted.total() + buckets)))) for b in range(buckets)]
    scored = []
    for i, t in rows:
        n, found = features(t, max_run, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((k for k, r in enumerate(scored) if r[1] >= 20), key=lambda k: (-scored[k][4], scored[k][0] is None, scored[k][0] or 0))
    rank = {k: at for at, k in enumerate(order[:percent * len(order) // 100], 1)}
    return sorted(str((r[0], *r[2:], rank.get(k))) for k, r in enumerate(scored))


@pytest.fixture(scope="module")
def cases(edge_rows):
    rng = random.Random(6)
    rows = list(edge_rows) + [(100 + k, prose(rng, rng.randrange(10, 80), rng.choice([30, 400]))) for k in range(200)]
    same = prose(rng, 30, 30)
    rows += [(400, same)] * 100  # a third of all rows, equal in everything
    return rows, [prose(rng, 40, 30) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("percent", [0, 10, 60, 100])
def test_equals_brute_force(spark, frame, cases, percent):
    rows, target = cases
    table = spark.createDataFrame([(k, t, "?") for k, t in enumerate(target)], TARGET)
    got = resampling.resample(frame(rows, 5), table, percent=percent, pivots=3).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, target, percent=percent)


def test_runs_of_words_and_few_buckets(spark, frame, cases):
    rows, target = cases
    table = spark.createDataFrame([(k, t, "?") for k, t in enumerate(target)], TARGET)
    got = resampling.resample(frame(rows), table, max_run=3, buckets=50).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, target, 3, 50)


@pytest.mark.parametrize("pivots", [1, 16])
def test_quickselect(spark, pivots):
    rng = random.Random(pivots)
    keys = [(rng.randrange(8), rng.randrange(60)) for _ in range(200)] + [(5, 7)] * 100 + [(5, None), (0, None)]
    table = staged(spark.createDataFrame(keys, "score bigint, doc_id bigint"), "keys")
    ranked = sorted(keys, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    for k in (1, 150, len(keys)) if pivots == 1 else (1, 2, 50, 150, len(keys) - 1, len(keys)):
        assert resampling.kth_key(table, k, pivots) == ranked[k - 1]


def test_drawn_documents_and_empty_tables(spark, frame, cases):
    rows, target = cases
    docs, table = frame(rows), spark.createDataFrame([(k, t, "?") for k, t in enumerate(target)], TARGET)
    drawn = resampling.drawn_documents(docs, table)
    assert drawn.schema == docs.schema
    ranks = {r["doc_id"] for r in resampling.resample(docs, table).filter(F.col("rank").isNotNull()).collect()}
    assert {r["doc_id"] for r in drawn.collect()} == ranks
    assert resampling.resample(docs.limit(0), table).count() == 0
    # Without a target the gains follow the documents alone.
    assert sorted(str(tuple(r)) for r in resampling.resample(docs, table.limit(0)).collect()) == brute(rows, [])
