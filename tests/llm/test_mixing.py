"""Mixing: posteriors on held-out labels, rates against a plain solver."""

import random

import numpy as np

from estilens.llm import mixing
from estilens.llm.common import staged
from texts import prose

LABELS = "doc_id bigint, quality int, toxic int, text string"


def made(n: int):
    rng = random.Random(11)
    rows, kinds = [], {}
    for k in range(n):
        kind = ("clean", "clean", "poor", "toxic")[k % 4]
        words = prose(rng, rng.randrange(30, 200)).split()
        if kind == "poor":
            words = [w + "###" for w in words]
        if kind == "toxic":
            words[3] = rng.choice(["idiot,", "moron"])
        rows.append((k, " ".join(words)))
        kinds[k] = kind
    return rows, kinds


def labels_of(spark, kinds, keep):
    return spark.createDataFrame([(k, int(v != "poor"), int(v == "toxic"), "?") for k, v in kinds.items() if keep(k)], LABELS)


def test_held_out_posteriors(spark, frame):
    rows, kinds = made(400)
    docs = frame(rows)
    model = mixing.fit_classifier(docs, labels_of(spark, kinds, lambda k: k % 3))
    assert set(model.domains) == {"clean", "poor", "toxic"}
    right = asked = 0
    for r in mixing.domain_posteriors(docs, model).collect():
        p = {d: r[f"p_{d}"] for d in model.domains}
        assert abs(sum(p.values()) - 1) < 1e-9 and r["n_tokens"] == len(dict(rows)[r["doc_id"]].split())
        if r["doc_id"] % 3 == 0:
            asked += 1
            right += max(p, key=p.get) == kinds[r["doc_id"]]
    assert right / asked > 0.95


def test_rates_meet_targets_and_equal_a_plain_solver(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    tokens = rng.integers(1, 1000, 500)
    table = spark.createDataFrame([(k, int(tokens[k]), *map(float, p[k])) for k in range(500)], "doc_id bigint, n_tokens bigint, p_a double, p_b double, p_c double")
    targets = {"a": 0.7, "b": 0.3, "c": 0.0}
    fit = mixing.fit_rates(staged(table, "p"), targets, 0.5, steps=80)
    rate = np.array([r["rate"] for r in sorted(fit.rates.collect(), key=lambda r: r["doc_id"])])
    assert (rate >= 0).all()
    wanted = np.array([0.35, 0.15, 0.0])
    reached = (rate * tokens) @ p / tokens.sum()
    assert np.allclose(reached, fit.reached, atol=1e-5)
    # Long plain descent, without momentum.
    r, m = np.ones(500), (p * tokens[:, None]).T @ p / tokens.sum()
    for _ in range(20_000):
        r = np.maximum(r - ((r * tokens) @ p / tokens.sum() - wanted) @ p.T / np.linalg.eigvalsh(m)[-1], 0)
    best = np.abs((r * tokens) @ p / tokens.sum() - wanted).max()
    assert np.abs(reached - wanted).max() <= best + 5e-3  # half a percent of the tokens


def test_a_small_domain_reaches_its_target(spark):
    rng = np.random.default_rng(7)
    for toxic in (4, 8):  # of 4,000
        kind = np.array([0] * toxic + [2] * 480 + [1] * (3520 - toxic))
        p = np.array([[0.97, 0.02, 0.01], [1e-4, 0.98, 0.0199], [1e-3, 0.05, 0.949]])[kind]
        p = np.clip(p + rng.normal(0, 0.003, p.shape), 1e-5, 1)
        p /= p.sum(axis=1, keepdims=True)
        rows = [(i, int(rng.integers(100, 400)), *map(float, x)) for i, x in enumerate(p)]
        table = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, p_toxic double, p_clean double, p_poor double")
        fit = mixing.fit_rates(staged(table, "p"))
        rates = {r["doc_id"]: r["rate"] for r in fit.rates.collect()}
        assert fit.steps < mixing.STEPS and [rates[i] for i in range(toxic)] == [0] * toxic
        assert abs(fit.reached[1] - 0.95 * 0.8) < 1e-3 and abs(fit.reached[2] - 0.05 * 0.8) < 1e-3


def test_edges(spark, frame, edge_rows):
    rows, kinds = made(80)
    rows = edge_rows + [(1000 + k, t) for k, t in rows]
    labels = labels_of(spark, {1000 + k: v for k, v in kinds.items()}, lambda k: True)
    odd = spark.createDataFrame([(None, 1, 0, ""), (1000, 0, 1, ""), (99999, 1, 0, ""), (1001, None, None, "")], LABELS)
    docs = frame(rows)
    got = mixing.mixing_rates(docs, labels.union(odd)).rates.collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    assert next(r for r in got if r["doc_id"] == 1)["n_tokens"] == 0
    out = mixing.mix(docs, labels)
    assert [c for c in docs.columns if c not in ("n_words", "rate", "p_clean")] == [c for c in out.columns if c in docs.columns and c not in ("n_words", "rate", "p_clean")]
    assert dict(out.dtypes)["rate"] == "double" and all(r["rate"] > 0 for r in out.collect())
    gone = {i for i, _ in rows} - {r["doc_id"] for r in out.collect()}
    assert {k for k in gone if k and k >= 1000} <= {1000 + k for k, v in kinds.items() if v != "clean"}
    alone = mixing.mixing_rates(docs, labels.limit(0))
    assert alone.domains == ("any",) and alone.rates.count() == len(rows)
    assert mixing.mixing_rates(docs.limit(0), labels).rates.count() == 0


def test_whole_query_against_plain_descent_and_targets_out_of_reach(spark, frame):
    rows, kinds = made(80)
    docs, labels = frame(rows), labels_of(spark, kinds, lambda k: True)
    fit = mixing.mixing_rates(docs, labels)
    got = sorted(fit.rates.collect(), key=lambda r: r["doc_id"])
    p = np.array([[r[f"p_{d}"] for d in fit.domains] for r in got])
    tokens = np.array([r["n_tokens"] for r in got])
    assert tokens.tolist() == [len(t.split()) for _, t in sorted(rows)]
    share, size = tokens / tokens.sum(), tokens @ p / tokens.sum()
    plain = np.full(len(got), mixing.BUDGET)
    for _ in range(5000):
        off = ((plain * share) @ p - fit.targets * mixing.BUDGET) / size
        plain = np.clip(plain - 0.9 * (p @ off + mixing.PULL * (plain - mixing.BUDGET)), 0, mixing.MOST_RATE)
    rate = np.array([r["rate"] for r in got])
    # A fit ends while single rates still move a little; the totals of domains no longer do.
    assert np.abs((rate * share) @ p - (plain * share) @ p).max() < 1e-3 and np.allclose(rate, plain, rtol=0.05, atol=0.1)
    # A word or two is all that tells toxic documents apart here: some doubt about clean ones stays.
    assert [why for name, *_, why in fit.summary() if name != "toxic"] == ["", ""]
    # More than MOST_RATE times the toxic tokens there are.
    wanted = mixing.mixing_rates(docs, labels, {"toxic": 1.0}, 8.0)
    assert dict((name, why) for name, _, _, why in wanted.summary())["toxic"] == "no rates meet the targets"
    few = mixing.mixing_rates(docs, labels.filter("toxic = 0 OR doc_id < 8"))
    assert few.domains == ("clean", "poor") and few.summary()[-1] == ("toxic", 0.0, None, "too few labelled documents")
