"""Substring dedup against brute force."""

import collections
import hashlib
import random
import re

import pytest

from estilens.llm import substrings
from texts import prose


def brute(rows, window):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = collections.Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k:k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append(str((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("period,cover", substrings.COVERS.items())
def test_covers_have_every_difference(period, cover):
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [5, 9, 20, 35])
def test_equals_brute_force(frame, edge_rows, window):
    rng = random.Random(window)
    shared = [prose(rng, n) for n in (window - 1, window, window + 1, 3 * window)]
    rows = edge_rows + [(100 + k, " ".join([prose(rng, rng.randrange(40)), rng.choice(shared), prose(rng, rng.randrange(40)), rng.choice(shared)])) for k in range(30)]
    got = substrings.remove_repeats(frame(rows), window, block_bytes=20_000, bucket_bytes=50_000).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, window)


def test_empty_table(frame):
    assert substrings.remove_repeats(frame([(1, "x")]).limit(0)).count() == 0
