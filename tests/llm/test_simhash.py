"""SimHash: fingerprints, the index and components against brute force."""

import random
import re

import numpy as np
import xxhash

from estilens.llm import simhash
from estilens.llm.common import staged
from texts import prose


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes):
    """The smallest place reachable from each place."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(codes)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(codes))]


def test_documents(frame, edge_rows):
    rng = random.Random(2)
    rows = list(edge_rows)
    for k in range(12):
        words = prose(rng, 300).split()
        rows.append((50 + 2 * k, " ".join(words)))
        words[k] = "other"
        rows.append((51 + 2 * k, " ".join(words).upper() if k % 2 else " ".join(words)))
    codes = [plain(t) for _, t in rows]
    ids = [i for i, _ in rows]
    of = groups(codes)
    least = {g: min([ids[k] for k in range(len(rows)) if of[k] == g and ids[k] is not None], default=None) for g in set(of)}
    expected = sorted(str((ids[k], f"{codes[k]:016x}", least[of[k]])) for k in range(len(rows)))
    for node_rows in (20_000, 8):
        got = simhash.near_duplicates(frame(rows), node_rows).collect()
        assert sorted(str(tuple(r)) for r in got) == expected
    kept = simhash.keep_one(frame(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(x) for x in least.values())
    assert simhash.keep_one(frame(rows).limit(0)).count() == simhash.near_duplicates(frame(rows).limit(0)).count() == 0


def dense_codes():
    rng = np.random.default_rng(1)
    out = []
    for at in rng.integers(0, 2**63, 8, dtype=np.uint64):
        for _ in range(60):
            near = at ^ (np.uint64(1) << np.uint64(rng.integers(64)))
            out.append(near)
            at = near if rng.random() < 0.3 else at
    return np.unique(np.array(out, np.uint64))


def test_gray_rank_is_the_inverse_of_the_gray_code():
    place = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(place ^ (place >> np.uint64(1))) == place).all()


def test_index_finds_each_close_pair_once():
    codes = dense_codes()
    ranked = codes[np.argsort(simhash.gray_rank(codes))]
    found = [tuple(sorted((int(ranked[x]), int(ranked[y])))) for a, b in simhash.close_pairs(ranked) for x, y in zip(a, b)]
    expected = {tuple(sorted((int(x), int(y)))) for k, x in enumerate(codes) for y in codes[k + 1:] if int(x ^ y).bit_count() <= 3}
    assert len(found) == len(set(found)) and set(found) == expected


def test_nodes_that_are_factored_again_lose_no_link(spark):
    codes = dense_codes()
    table = staged(spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code bigint"), "codes")
    of = groups([int(c) for c in codes])
    expected = {frozenset(int(codes.view(np.int64)[k]) for k in range(len(codes)) if of[k] == g) for g in set(of)}
    for node_rows in (20_000, 30):
        root = {r["code"]: r["root"] for r in simhash.components(simhash.links(table, node_rows)).collect()}
        found = {}
        for c in codes.view(np.int64).tolist():
            found.setdefault(root.get(c, c), set()).add(c)
        assert {frozenset(g) for g in found.values()} == expected
