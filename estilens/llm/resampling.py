"""Importance resampling towards a target distribution.

Words and runs of words are hashed into buckets.  A bucket's gain is the logarithm of
its share in the target texts over its share in the documents, as an integer; gains of
all buckets are one array that every task has.  A document's weight is the mean of its
gains; with Gumbel noise from a keyed hash of its id, the highest scores are a sample
without replacement whose odds follow the weights.

The documents that are drawn are those up to the k-th key (score, then smaller id),
which quickselect finds on a written table of scores: random pivot keys of the range
that is still open, then exact counts of the rows before, at and behind each pivot in
one pass, narrow the range until a pivot is the k-th key.  The range never moves
between machines and never meets anywhere.  Only the rows up to that key are sorted,
by ranges, and ranked by the counts of the ranges before theirs.

Defined results: a null or empty text has no features, the weight 0, and is not drawn
(it has fewer than MIN_WORDS words); a null doc_id has the noise of an empty name and
comes last among ties; rows that are repeated are drawn one by one; with no target
texts all gains follow from empty counts; an empty table gives an empty result.  Only
ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.llm.common import shared_root, staged
from estilens.operators.ranks import with_rank

BUCKETS, MAX_RUN = 10_000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Pivot keys of one round.
PIVOTS = 32

#: A-Z become a-z; digits, a-z and all beyond ASCII stay; the rest separates words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def feature_buckets(words: list[bytes], max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of one to max_run words, repeats included."""
    found = [np.fromiter(map(crc32, words), np.uint32, len(words))]
    for n in range(2, min(max_run, len(words)) + 1):
        runs = (crc32(b" ".join(words[k:k + n])) for k in range(len(words) - n + 1))
        found.append(np.fromiter(runs, np.uint32, len(words) - n + 1))
    return np.concatenate(found) % np.uint32(buckets)


def bucket_counts(rows: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks add up their own first."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(feature_buckets(words_of(text.as_py()), max_run, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = rows.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in parts.collect():  # a row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    buckets, t_all, s_all = len(target), int(target.sum()), int(source.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
        for t, s in zip(target.tolist(), source.tolist())
    ], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise, in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, and its text's MD5."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        import pyarrow as pa

        gain = shared.value
        for batch in batches:
            rows, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = words_of(text)
                found = feature_buckets(words, max_run, len(gain))
                keys.append(hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest())
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((len(words), len(found), weight, weight + noise(doc_id, seed)))
            columns = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns.T.copy()], pa.array(keys, pa.string())], ["doc_id", "n_words", "n_features", "weight", "score", "key"])

    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, key string")


# --- quickselect ----------------------------------------------------------------------


def _same(key) -> Column:
    return (F.col("score") == key[0]) & F.col("doc_id").eqNullSafe(F.lit(key[1]))


def _before(key) -> Column:
    """Rows before a key: a higher score, or the same and a smaller id."""
    smaller = F.col("doc_id").isNotNull() if key[1] is None else F.coalesce(F.col("doc_id") < key[1], F.lit(False))
    return (F.col("score") > key[0]) | ((F.col("score") == key[0]) & smaller)


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS):
    """keys(score, doc_id), written -> the k-th key, 1 <= k <= rows."""
    low = high = None  # the k-th key lies behind the one and before the other
    turn = 0
    while True:
        turn += 1
        still = keys
        if low is not None:
            still = still.filter(~_before(low) & ~_same(low))
        if high is not None:
            still = still.filter(_before(high))
        # Random rows of the open range: the first by a hash that changes with each round.
        drawn = still.orderBy(F.xxhash64("score", "doc_id", F.lit(turn))).select("score", "doc_id").limit(pivots).collect()
        asked = sorted({(r["score"], r["doc_id"]) for r in drawn}, key=lambda x: (-x[0], x[1] is None, x[1]))
        counts = keys.agg(*[F.count_if(test(key)) for key in asked for test in (_before, _same)]).first()
        for key, before, same in zip(asked, counts[::2], counts[1::2]):
            if before < k <= before + same:
                return key
            if before >= k:
                high = key
                break
            low = key


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN,
    buckets: int = BUCKETS, seed: int = SEED, pivots: int = PIVOTS, keep_key: bool = False,
) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank of
    every document; rank is null for those that are not drawn.  keep_key adds the MD5
    of the text."""
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(target, max_run, buckets), bucket_counts(docs, max_run, buckets))
    scored = staged(scores(docs, gains, max_run, seed), "resampling-scores")
    fit = F.col("n_words") >= min_words
    columns = ("doc_id", "n_features", "weight", "score", *["key"] * keep_key)
    k = percent * scored.filter(fit).count() // 100
    if not k:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    last = kth_key(scored.filter(fit), k, pivots)
    first = fit & (_before(last) | _same(last))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = with_rank(scored.filter(first), order, name="rank", root=shared_root(spark))
    # Equal rows at the k-th key may be more than are drawn.
    drawn = ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.union(scored.filter(~first).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents that are drawn, with all their columns; rows that agree in id and
    text are returned together if one of them is drawn."""
    key = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    # The ids of the texts are judged; what decides a row is both.
    drawn = resample(docs, target, keep_key=True, **settings).filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id"), F.col("key").alias("drawn_key"))
    rows = rows.join(drawn, F.col("id").eqNullSafe(F.col("drawn_id")) & (F.col("key") == F.col("drawn_key")), "left_semi")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
