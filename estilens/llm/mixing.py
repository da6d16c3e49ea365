"""Mixing to target weights with soft membership.

A classifier fitted on labelled documents gives every document a soft membership in
each domain: its posteriors, raised to the power SHARPNESS, so that slight doubts about
very many documents do not add up to a domain.  Document rates r >= 0 are then fitted
so that the expected tokens of each domain, the sum over documents of rate * tokens *
membership, come to the target weights times a budget: least squares, each domain's
residual measured by its own size, by projected gradient with momentum.  A small pull
to the common rate (PULL) makes the solution unique and equal for equal memberships,
and no rate exceeds MOST_RATE.  The gradient of a document depends on the corpus only
through one residual per domain, so a step is one pass that sums a few numbers per
partition; rates are written every ROUND steps, so a step replays few of them.

Bounds: the classifier is fitted on at most SAMPLE labelled documents (the first in
the order of a hash, over all labels) in one task, with at most FEATURES selected
words; memberships, tokens and all sums cover every document and every word of it.

Defined results: a null or empty text has no tokens, a membership like a text
without known words, and a rate; labels that are null, contradict each other or
name no document are not used; a domain with under MIN_LABELS examples cannot be
learned: its target is shared out over the others, and summary() names it, as it does
targets that no rates meet; with no domain left everything is one domain, "any";
repeated rows are documents of their own; an empty table gives an empty result.  Only
doc_id and text are read for the fit; in mix(), columns of the input that have the
name of a new one are replaced.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from estilens.llm.common import SPACE, chunks, staged, text_buffer, word_bounds, word_hashes

#: Domains in the order in which a labelled document is given to them, and their weights.
DOMAINS = ("toxic", "clean", "poor")
TARGETS = {"toxic": 0.0, "clean": 0.95, "poor": 0.05}
#: Tokens wanted, as a share of those there are.
BUDGET = 0.8
SAMPLE, FEATURES, MIN_LABELS = 3000, 400, 5
#: Hash values of words that are told apart.
SLOTS = 1 << 20
#: A fit ends when a step moves the mean rate of no domain by more than TOLERANCE.
STEPS, TOLERANCE = 200, 1e-4
#: Rates are written after so many steps.
ROUND = 20
SHARPNESS, PULL, MOST_RATE = 2.0, 3e-4, 20.0
#: A word is selected if chance explains its share in a domain with less than this probability, over all words tried.
CHANCE = 0.05
PIECE_BYTES = 1 << 20

_WORD_BREAK = np.array([not (0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A or 0x30 <= c <= 0x39 or c >= 0x80) for c in range(256)])
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_KIND = np.zeros((5, 256), bool)
_KIND[0, [ord(c) for c in "#*$%&<>"]] = True
_KIND[1, [ord(c) for c in "!?"]] = True
_KIND[2, ord("|")] = True
_KIND[3, 0x41:0x5B] = True
_KIND[4, [*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Shape of a text: symbols, marks and bars per word, capitals per letter, share of repeated words, log of length.
SHAPE = 6


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def describe(texts):
    """For pieces of an Arrow column: rows (from, to), tokens, shape, and the slot
    of each word with the number of words per row."""
    data, offsets = text_buffer(texts)
    for a, b in chunks(offsets, PIECE_BYTES):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        tokens = np.diff(word_bounds(part, at, SPACE)[2])
        starts, ends, first = word_bounds(part, at, _WORD_BREAK)
        slots = (word_hashes(_LOWER[part], starts, ends) % np.uint64(SLOTS)).astype(np.int64)
        words = np.diff(first)
        row = np.repeat(np.arange(b - a), words)
        kinds = [_per_row(kind[part], at) for kind in _KIND]
        least = np.maximum(tokens, 1)
        same = (slots[1:] == slots[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row[1:][same], minlength=b - a)
        shape = np.stack([
            np.minimum(kinds[0] / least, 1), np.minimum(kinds[1] / least, 1), np.minimum(kinds[2] / least, 1),
            kinds[3] / np.maximum(kinds[4], 1), again / least, np.log1p(tokens) / 10,
        ], axis=1)
        yield a, b, tokens, shape, slots, row


class Classifier(NamedTuple):
    domains: tuple[str, ...]
    slots: np.ndarray
    weights: np.ndarray  # (shape + selected words + 1) x domains
    #: Domains that had too few examples.
    unlearned: tuple[str, ...] = ()

    def posteriors(self, shape: np.ndarray, slots: np.ndarray, row: np.ndarray) -> np.ndarray:
        n = len(shape)
        if len(self.domains) == 1:
            return np.ones((n, 1))
        place = np.full(SLOTS, -1, np.int32)
        place[self.slots] = np.arange(len(self.slots))
        feature = place[slots]
        known = feature >= 0
        pairs = np.unique(row[known] * len(self.slots) + feature[known])  # presence, not counts
        scores = shape @ self.weights[:SHAPE] + self.weights[-1]
        np.add.at(scores, pairs // max(len(self.slots), 1), self.weights[SHAPE:-1][pairs % max(len(self.slots), 1)])
        return _softmax(SHARPNESS * scores)


def _softmax(scores: np.ndarray) -> np.ndarray:
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _likelihood(k: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of k successes in n at their own share against another."""
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(k > 0, k * np.log(k / (n * share)), 0)
        miss = np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - share))), 0)
    return hit + miss


def telling_words(domain: np.ndarray, k: int, present: list[np.ndarray]) -> np.ndarray:
    """Slots of words that stand in more documents of a domain than chance explains:
    by the likelihood ratio, which holds for small counts, at a level for all words tried."""
    n, sizes = len(domain), np.bincount(domain, minlength=k)
    counts = np.zeros((k, SLOTS), np.float64)
    for d, slots in zip(domain, present):
        counts[d, slots] += 1
    total = counts.sum(axis=0)
    tried = np.flatnonzero((total > 2) & (total < n))
    if not len(tried):
        return tried
    share, least = total[tried] / n, 2 * np.log(len(tried) * k / CHANCE)
    ratio = np.zeros(len(tried))
    for d in range(k):
        own, rest = counts[d, tried], total[tried] - counts[d, tried]
        if sizes[d] < n:
            both = 2 * (_likelihood(own, sizes[d], share) + _likelihood(rest, n - sizes[d], share))
            ratio = np.maximum(ratio, np.where(own * n > total[tried] * sizes[d], both, 0))
    best = np.argsort(-ratio, kind="stable")[:FEATURES]
    return np.sort(tried[best[ratio[best] > least]])


def _fit(domain: np.ndarray, k: int, shape: np.ndarray, present: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on the shape and on the words that tell domains apart best."""
    n, chosen = len(domain), telling_words(domain, k, present)
    place = np.full(SLOTS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, SHAPE + len(chosen) + 1))
    x[:, :SHAPE], x[:, -1] = shape, 1
    for i, slots in enumerate(present):
        known = place[slots]
        x[i, SHAPE + known[known >= 0]] = 1
    wanted = np.eye(k)[domain]
    weights, speed = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    rate = 1 / (0.5 * np.linalg.norm(x.T @ x / n, 2) + 1e-4)
    for _ in range(1500):
        ahead = weights + 0.95 * speed
        speed = 0.95 * speed - rate * (x.T @ (_softmax(x @ ahead) - wanted) / n + 1e-4 * ahead)
        weights = weights + speed
    return chosen, weights


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on a bounded sample: the first labelled documents by hash of their id."""
    named = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("q0"), F.max("quality").alias("q"), F.min("toxic").alias("t0"), F.max("toxic").alias("t")
    ).filter("q0 = q AND t0 = t")
    domain = F.when(F.col("t") == 1, 0).when(F.col("q") == 1, 1).when(F.col("q") == 0, 2)
    named = named.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")
    known = docs.select("doc_id").join(named, "doc_id").distinct()
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(9)), "doc_id").limit(sample)

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, _, shape, slots, row in describe(batch.column(2)):
                edges = np.searchsorted(row, np.arange(b - a + 1))
                sets = [np.unique(slots[edges[i]:edges[i + 1]]).astype(np.int32) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].cast(pa.string()), batch.column(1)[a:b].cast(pa.int32()),
                     pa.array(list(shape), pa.list_(pa.float64())), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "domain", "shape", "slots"],
                )

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows
    rows = texts.select("doc_id", "domain", "text").mapInArrow(features, "doc_id string, domain int, shape array<double>, slots binary")

    def fit(table):
        import pyarrow as pa

        # Repeated documents count once; the order must not depend on the partitions.
        found = {(r["doc_id"], r["slots"]): r for r in table.to_pylist()}
        data = [found[key] for key in sorted(found)]
        sizes = np.bincount([r["domain"] for r in data], minlength=len(DOMAINS))
        kept = [d for d in range(len(DOMAINS)) if sizes[d] >= MIN_LABELS]
        data = [r for r in data if r["domain"] in kept]
        slots, weights = np.zeros(0, np.int64), np.zeros((SHAPE + 1, len(kept)))
        if len(kept) > 1:
            slots, weights = _fit(
                np.array([kept.index(r["domain"]) for r in data]), len(kept), np.array([r["shape"] for r in data]),
                [np.frombuffer(r["slots"], np.int32) for r in data],
            )
        return pa.table({
            "domains": [json.dumps([DOMAINS[d] for d in kept])], "slots": [slots.astype(np.int64).tobytes()], "weights": [weights.tobytes()],
        })

    fitted = rows.groupBy().applyInArrow(fit, "domains string, slots binary, weights binary").first()
    domains = tuple(json.loads(fitted["domains"])) if fitted else ()
    if not domains:
        return Classifier(("any",), np.zeros(0, np.int64), np.zeros((SHAPE + 1, 1)), DOMAINS)
    slots, weights = np.frombuffer(fitted["slots"], np.int64), np.frombuffer(fitted["weights"]).reshape(-1, len(domains))
    return Classifier(domains, slots, weights, tuple(d for d in DOMAINS if d not in domains))


def domain_posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens and the posterior of each domain, for every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(tuple(classifier))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p_{d}" for d in classifier.domains]

    def predict(batches):
        import pyarrow as pa

        known = Classifier(*model.value)
        for batch in batches:
            for a, b, tokens, shape, slots, row in describe(batch.column(1)):
                p = known.posteriors(shape, slots, row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(tokens, pa.int64()), *[pa.array(p[:, k]) for k in range(p.shape[1])]],
                    ["doc_id", "n_tokens", *names],
                )

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, n_tokens bigint, " + ", ".join(f"{n} double" for n in names))


def _rates(p: np.ndarray, pulls: np.ndarray, common: float, since: int = 0, now=None, ahead=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates after some steps, the point where the next gradient is taken, and how far the last step moved."""
    now = np.full(len(p), common) if now is None else now
    ahead, moved = now if ahead is None else ahead, np.zeros(len(p))
    for k, pull in enumerate(pulls, since):
        before = now
        # No eigenvalue of the scaled squares exceeds one.
        now = np.clip(ahead - (p @ pull + PULL * (ahead - common)) / (1 + PULL), 0, MOST_RATE)
        moved = np.abs(now - ahead)
        ahead = now + k / (k + 3) * (now - before)
    return now, ahead, moved


class Fit(NamedTuple):
    rates: DataFrame
    pulls: np.ndarray
    budget: float
    domains: tuple[str, ...]
    targets: np.ndarray
    reached: np.ndarray
    steps: int
    unlearned: tuple[str, ...] = ()

    def summary(self, tolerance: float = 0.01) -> list[tuple[str, float, float | None, str]]:
        """Per domain its target and what was reached, as shares of all tokens, and what is amiss."""
        out = []
        for name, target, reached in zip(self.domains, (self.targets * self.budget).tolist(), self.reached.tolist()):
            out.append((name, target, reached, "" if abs(reached - target) <= tolerance else "no rates meet the targets"))
        return out + [(name, 0.0, None, "too few labelled documents") for name in self.unlearned]


def fit_rates(posteriors: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, steps: int = STEPS) -> Fit:
    """posteriors (written) -> a rate for each document.

    Steps are scaled by tokens (a document's rate moves by its memberships times the
    residuals), so short and long documents with equal memberships get equal rates.
    """
    names = [c for c in posteriors.columns if c.startswith("p_")]
    k = len(names)
    t = F.col("n_tokens").cast("double")
    sums = [float(x or 0) for x in posteriors.agg(F.sum(t), *[F.sum(t * F.col(a)) for a in names]).first()]
    total, sizes = max(sums[0], 1.0), np.maximum(np.array(sums[1:]) / max(sums[0], 1.0), 1e-9)
    weights = np.array([max(targets.get(n[2:], 0.0), 0.0) for n in names])
    weights = weights / weights.sum() if weights.sum() else np.full(k, 1 / k)
    wanted = weights * budget
    kind = posteriors.schema["doc_id"].dataType.simpleString()
    state, since = posteriors.select("doc_id", "n_tokens", *names), 0
    past: list[np.ndarray] = []

    def replay(batch, pulls):
        p = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
        kept = [batch.column(i + k + 2).to_numpy(zero_copy_only=False) for i in range(2)] if since else [None, None]
        return p, *_rates(p, pulls, budget, since, *kept)

    def sums_at(pulls, final=False):
        def add(batches):
            import pyarrow as pa

            reached, drift = np.zeros(k), np.zeros(k)
            for batch in batches:
                p, now, ahead, moved = replay(batch, pulls)
                tokens = batch.column(1).to_numpy(zero_copy_only=False)
                reached += ((now if final else ahead) * tokens) @ p
                drift += (moved * tokens) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*reached, *drift]], [*names, *[f"d{n}" for n in names]])

        columns = [*names, *[f"d{n}" for n in names]]
        parts = state.mapInArrow(add, ", ".join(f"{c} double" for c in columns))
        found = np.array([float(x or 0) for x in parts.agg(*[F.sum(c) for c in columns]).first()]) / total
        return found[:k], found[k:] / sizes

    def with_rates(pulls, *columns):
        def add(batches):
            import pyarrow as pa

            for batch in batches:
                p, now, ahead, _ = replay(batch, pulls)
                own = [batch.column(i) for i in range(k + 2)]
                # Sums over partitions agree to the last digits only.
                new = {"rate": now.round(6), "now": now, "ahead": ahead}
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(new[c]) for c in columns]], ["doc_id", "n_tokens", *names, *columns])

        return state.mapInArrow(add, f"doc_id {kind}, n_tokens bigint, " + ", ".join(f"{c} double" for c in (*names, *columns)))

    for _ in range(steps):
        reached, drift = sums_at(np.array(past[since:]).reshape(-1, k))
        if len(past) > max(since, 1) and (drift < TOLERANCE).all():
            break
        past.append((reached - wanted) / sizes)
        if len(past) - since == ROUND:
            written = staged(with_rates(np.array(past[since:]), "now", "ahead"), "rates")
            state, since = written, len(past)
    pulls = np.array(past[since:]).reshape(-1, k)
    rates = with_rates(pulls, "rate")
    return Fit(rates, np.array(past).reshape(-1, k), budget, tuple(n[2:] for n in names), weights, sums_at(pulls, True)[0], len(past))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> Fit:
    """Memberships and rates of all documents."""
    classifier = fit_classifier(docs, labels)
    fit = fit_rates(staged(domain_posteriors(docs, classifier), "posteriors"), targets, budget)
    return fit._replace(unlearned=classifier.unlearned)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """Documents with a positive rate, with n_tokens, posteriors and rate beside their columns.

    The documents are read a second time, which costs less than to join the rates to the texts.
    """
    classifier = fit_classifier(docs, labels)
    fit = fit_rates(staged(domain_posteriors(docs, classifier), "posteriors"), targets, budget)
    model = docs.sparkSession.sparkContext.broadcast((tuple(classifier), fit.pulls, budget))
    names = ["n_tokens", *[f"p_{d}" for d in classifier.domains], "rate"]
    own = [c for c in docs.columns if c not in names]
    at = own.index("text")

    def add(batches):
        import pyarrow as pa

        known, pulls, common = model.value
        known = Classifier(*known)
        for batch in batches:
            for a, b, tokens, shape, slots, row in describe(batch.column(at)):
                p = known.posteriors(shape, slots, row)
                rate = _rates(p, pulls, common)[0].round(6)
                new = [pa.array(tokens, pa.int64()), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(rate)]
                rows = pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns], *new], [*batch.schema.names, *names])
                yield rows.filter(pa.array(rate > 0))

    chosen = docs.select(*own)
    schema = StructType([*chosen.schema, *[StructField(name, LongType() if name == "n_tokens" else DoubleType()) for name in names]])
    return chosen.mapInArrow(add, schema)
