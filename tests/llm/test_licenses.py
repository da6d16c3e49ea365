"""License scans: cosines against a plain computation, and inheritance."""

import math
import random
import re
from collections import Counter

from estilens.llm import licenses
from texts import prose

MIT, GPL = dict(licenses.TEMPLATES)["MIT"], dict(licenses.TEMPLATES)["GPL-3.0"]


def files_of(spark, rows):
    return spark.createDataFrame([(*r, "?", "?") for r in rows], "path string, text string, key string, license string")


def brute(rows):
    """(license, similarity, how) of each text, comparing every unit with every template."""
    split = [re.findall("[a-z0-9]+", (t or "").lower()) for _, t in rows]
    vectors = [(name, Counter(re.findall("[a-z0-9]+", text.lower()))) for name, text in licenses.TEMPLATES]
    known = {w for _, v in vectors for w in v}
    n = len(rows)
    df = Counter(w for words in split for w in set(words))
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in known}
    out = []
    for (_, text), _ in zip(rows, split):
        best = None
        for unit, line in enumerate([text or "", *(text or "").split("\n")]):
            tf = Counter(re.findall("[a-z0-9]+", line.lower()))
            length = math.sqrt(sum((c * idf[w]) ** 2 if w in known else c * (math.log(1 + n) + 1) ** 2 for w, c in tf.items()))
            for name, v in vectors:
                size = math.sqrt(sum((c * idf[w]) ** 2 for w, c in v.items()))
                product = sum(c * idf[w] * v[w] * idf[w] for w, c in tf.items() if w in v)
                similarity = round(product / size / length, 6) if length else 0
                versions = {w for w in v if w.isdigit()}
                if similarity >= licenses.THRESHOLD and versions <= set(tf):
                    best = min(best or (9,), (-similarity, unit, name))
        out.append((best[2], -best[0], "file" if best[1] == 0 else "header") if best else (None, None, None))
    return out


def test_cosines_equal_brute_force(spark, edge_rows):
    rng = random.Random(4)
    rows = [(f"r/{k}", t) for k, (_, t) in enumerate(edge_rows)]
    words = " ".join(text for _, text in licenses.TEMPLATES).split()
    for k in range(60):
        line = rng.choice(licenses.TEMPLATES)[1].split()
        line[rng.randrange(len(line))] = rng.choice(words)
        rows.append((f"r/{k % 5}/{k}", "\n".join([prose(rng, 9), " ".join(line[rng.randrange(3):]), " ".join(rng.choices(words, k=6)), prose(rng, 5)])))
    rows += [("r/a", MIT), ("r/a", MIT), (None, GPL), (None, None)]
    found = {r["key"]: (r["license"], r["similarity"], r["how"]) for r in licenses.own_licenses(files_of(spark, rows)).collect()}
    keys = [r["key"] for r in files_of(spark, rows).drop("key").select(licenses.file_key().alias("key")).collect()]
    expected = brute(rows)
    assert sum(e[0] is not None for e in expected) > 30
    for key, row in zip(keys, expected):
        got = found.get(key, (None, None, None))
        assert got[0] == row[0] and got[2] == row[2] and (row[1] is None or abs(got[1] - row[1]) < 2e-6)


def test_versions_are_told_apart(spark):
    said = {
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
        "GPL-3.0": "you can modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
        "BSD-2-Clause": "Licensed under the BSD 2-Clause License", "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
        "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.", "ISC": "Permission to use, copy, modify and distribute this software for any purpose with or without fee is hereby granted",
        # Versions that no template has.
        "Apache-1.1": "Licensed under the Apache License, Version 1.1.", "CC-BY-3.0": "Licensed under CC BY 3.0.", "MPL-1.1": "terms of the Mozilla Public License, v. 1.1.",
    }
    rows = [(f"{name}/{k}.c", f"int {k}\n{text}\nend") for k, (name, text) in enumerate(said.items())] + [(f"x/{k}.c", prose(random.Random(k), 30)) for k in range(40)]
    got = {r["path"].split("/")[0]: r["license"] for r in licenses.license_scan(files_of(spark, rows)).collect() if r["path"][0] != "x"}
    assert got == {name: None if name in ("Apache-1.1", "CC-BY-3.0", "MPL-1.1") else name for name in said}


def test_nearest_directory_gives_its_license(spark):
    rows = [
        ("a/LICENSE", GPL), ("a/x.c", "int"), ("a/b/y.c", "int"), ("a/b/c/COPYING", MIT), ("a/b/c/z.c", "int"), ("a/b/c/d/e/z.c", "int"),
        ("a/b/c/own.c", "int\n" + licenses.TEMPLATES[0][1]), ("other/q.c", None), ("top.c", ""), ("ab/LICENSE", "nothing known"), ("ab/f.c", "int"),
        ("a/x.c", "int"), (None, "int"),
    ]
    got = sorted((str(r["path"]), str(r["license"]), r["how"], str(r["inherited_from"])) for r in licenses.license_scan(files_of(spark, rows)).collect())
    assert got == sorted([
        ("a/LICENSE", "GPL-3.0", "file", "None"), ("a/x.c", "GPL-3.0", "inherited", "a/LICENSE"), ("a/x.c", "GPL-3.0", "inherited", "a/LICENSE"),
        ("a/b/y.c", "GPL-3.0", "inherited", "a/LICENSE"), ("a/b/c/COPYING", "MIT", "file", "None"), ("a/b/c/z.c", "MIT", "inherited", "a/b/c/COPYING"),
        ("a/b/c/d/e/z.c", "MIT", "inherited", "a/b/c/COPYING"), ("a/b/c/own.c", "Apache-2.0", "header", "None"), ("other/q.c", "None", "none", "None"),
        ("top.c", "None", "none", "None"), ("ab/LICENSE", "None", "none", "None"), ("ab/f.c", "None", "none", "None"), ("None", "None", "none", "None"),
    ])


def test_edges_and_plan(spark, frame, edge_rows):
    docs = frame(edge_rows)
    got = licenses.scan_documents(docs)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, _ in edge_rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan_documents(docs.limit(0)).count() == 0
    none = licenses.license_scan(licenses.as_repositories(docs), ())
    assert {r["how"] for r in none.collect()} == {"none"}
