"""Decontamination against brute force."""

import hashlib
import random
import re

from estilens.llm import decontaminate
from texts import prose

ITEMS = "item_id bigint, text string, n_words string"


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, items):
    windows = {}
    for name, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("" if name is None else str(name))
    out = []
    for i, text in rows:
        w, hit, names = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    names |= windows[tuple(w[k:k + n])]
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append(str((i, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w))))
    return sorted(out)


def cases(edge_rows):
    rng = random.Random(7)
    items = [(k, prose(rng, n, 60)) for k, n in enumerate([1, 3, 5, 12, 13, 14, 20, 40])] + [(50, None), (51, ""), (52, "--"), (None, prose(rng, 15, 60))]
    items += [(60, items[5][1]), (61, " ".join(items[7][1].split()[3:30])), (62, " ".join(items[2][1].split()[1:4]))]
    rows = list(edge_rows)
    for k in range(40):
        part = rng.choice(items)[1] or ""
        rows.append((100 + k, " ".join([prose(rng, rng.randrange(60), 60), part.upper() if k % 3 else part.replace(" ", "-"), prose(rng, rng.randrange(60), 60)])))
    return rows, items


def test_equals_brute_force(spark, frame, edge_rows):
    rows, items = cases(edge_rows)
    table = spark.createDataFrame([(*x, "?") for x in items], ITEMS)
    got = decontaminate.contamination(frame(rows), table).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, items)


def test_items_in_several_automata_give_the_same(spark, frame, edge_rows):
    rows, items = cases(edge_rows)
    table = spark.createDataFrame([(*x, "?") for x in items], ITEMS)
    one, many = (decontaminate.benchmark_hits(frame(rows), table, shard_words=n).collect() for n in (1_000_000, 100))
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_cleaning_with_several_automata_is_the_same(spark, frame, edge_rows):
    rows, items = cases(edge_rows)
    table = spark.createDataFrame([(*x, "?") for x in items if x[1] and len(x[1].split()) >= 13], ITEMS)
    docs = frame(rows)
    one, many = (decontaminate.decontaminate(docs, table, shard_words=n) for n in (1_000_000, 40))
    assert one.schema == many.schema == docs.schema
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert decontaminate.decontaminate(docs.limit(0), table, shard_words=40).count() == 0


def test_cleaning(spark, frame, edge_rows):
    rows, items = cases(edge_rows)
    table = spark.createDataFrame([(*x, "?") for x in items if x[1] and len(x[1].split()) >= 13], ITEMS)
    docs = frame(rows)
    clean = decontaminate.decontaminate(docs, table)
    assert clean.schema == docs.schema
    bad = [r for r in decontaminate.contamination(docs, table).collect() if r["contaminated"]]
    assert bad and clean.count() == len(rows) - len(bad)
    assert not decontaminate.contamination(clean, table).filter("contaminated").count()
    assert decontaminate.decontaminate(docs, table.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(docs.limit(0), table).count() == 0
