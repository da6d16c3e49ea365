"""Ranked lexical search with norm buckets.

A document is a vector of impacts, one for each term of the queries that it has: the
term's weight times its saturated frequency, an integer.  A query is a vector of ones
over its terms, so a score is their inner product.  Vectors are ordered by length and
written in buckets of about equal length.  Given a score that a query's k-th result
has at least (its floor),

- a bucket whose longest vector times the query's length stays below the floor is
  pruned for that query (Cauchy-Schwarz); a bucket pruned for all queries isn't read;
- inside a bucket the query's heaviest terms are looked up first.  What the other
  terms can add to a document is at most the length of the rest of the query times the
  length of the rest of the document's vector: whoever stays below the floor is out;
- survivors are scored exactly in 64-bit integers over all terms of the query.

The first floors come from the buckets of the longest vectors; a task raises its own
as it goes.  Bounds are floating point with a margin, and what ties with a floor
survives, so the results are those of scoring every document.

Queries are dealt with in blocks of at most BLOCK_TERMS terms (one query at least),
each of which reads the documents again; what is broadcast, and all that a task holds
beside its documents, is bounded by a block.  Counts of documents and terms cover the
whole table.  The vectors move once, ordered by bucket and a hash of the row, so that
many vectors of one length spread over the tasks.

Defined results: a null text has no terms, whether document or query; a query without
a term that some document has gets no rows; rows that are repeated, also queries, are
ranked one by one, and equal scores go by doc_id, a null one last; empty tables give
an empty result.  Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estilens.llm.common import staged

K = 10
#: Distinct terms of the queries of one block.
BLOCK_TERMS = 200_000
#: Buckets for each doubling of the length.
PER_DOUBLING = 4
#: Documents that the buckets hold from which the first floors come.
FIRST_ROWS = 20_000
#: Documents of a bucket that are bounded together, and terms that are looked up first.
TOGETHER, FOCUS = 4096, 6
#: Fixed values of the impact formula.
FREQUENCY_SCALE, SATURATION, FLAT, SLOPE = 1_000_000_000, 8, 10, 90

#: A-Z become a-z; digits, other letters and all beyond ASCII stay; the rest separates terms.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_MARGIN = 1 + 1e-9


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


# --- queries --------------------------------------------------------------------------


def query_terms(items: DataFrame) -> DataFrame:
    """items(item_id, text) -> (key, item_id, terms): the distinct terms of each row, under a name for it."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(set(terms(text.as_py()))) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["key", "item_id", "terms"])

    named = items.select(F.monotonically_increasing_id().alias("key"), "item_id", "text")
    return named.mapInArrow(split, f"key bigint, item_id {kind}, terms array<binary>")


def blocks_of(queries: DataFrame, block_terms: int = BLOCK_TERMS) -> list[DataFrame]:
    """queries (written) in parts that hold at most so many terms, or one query."""
    size = F.size("terms")
    total = queries.agg(F.sum(size)).first()[0] or 0
    n = -(-total // block_terms) or 1
    while True:
        block = F.pmod(F.xxhash64("key"), F.lit(n))
        over = queries.groupBy(block).agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("q")).filter((F.col("t") > block_terms) & (F.col("q") > 1))
        if over.isEmpty():
            break
        n *= 2
    return [queries.filter(block == k) for k in range(n)]


# --- document vectors -------------------------------------------------------------------


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and of the vocabulary's terms that occur their
    numbers and frequencies (as 32-bit integers, by number)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        place = known.value
        for batch in batches:
            sizes, numbers, times = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                found = Counter(words)
                pairs = sorted((place[w], found[w]) for w in found.keys() & place.keys())
                sizes.append(len(words))
                numbers.append(np.array([a for a, _ in pairs], np.uint32).tobytes())
                times.append(np.array([b for _, b in pairs], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary()), pa.array(times, pa.binary())],
                ["doc_id", "n", "numbers", "times"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n bigint, numbers binary, times binary")


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after another, and where each row's begin."""
    parts = column.to_pylist()
    ends = np.cumsum([0, *(len(p) for p in parts)]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), ends


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs; tasks add up their own first."""

    def add(batches):
        import pyarrow as pa

        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column(0), np.uint32)[0], minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    parts = counted.select("numbers").mapInArrow(add, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for row in parts.toLocalIterator():  # as many as the block has terms
        df[row["term"]] = row["df"]
    return df


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(times: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Weight times saturated frequency, all in integers."""
    times = times.astype(np.int64)
    return weights * ((FREQUENCY_SCALE * times) // (1000 * times + SATURATION * m))


def bucket_of(lengths: np.ndarray) -> np.ndarray:
    """Buckets of about equal length; those of longer vectors have larger numbers."""
    return np.floor(PER_DOUBLING * np.log2(lengths)).astype(np.int32)


def vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """counted (written) -> the same with m, the length of the vector and its bucket, for
    documents that have any impact, ordered by bucket."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)
    kind = counted.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        import pyarrow as pa

        weight = shared.value
        for batch in batches:
            m = np.array([FLAT + SLOPE * n * n_docs // n_words if n else FLAT for n in batch.column(1).to_pylist()], np.int64)
            numbers, ends = _joined(batch.column(2), np.uint32)
            times, _ = _joined(batch.column(3), np.uint32)
            row = np.repeat(np.arange(len(m)), np.diff(ends))
            value = impacts(times, weight[numbers], m[row]).astype(float)
            length = np.sqrt(np.bincount(row, value * value, minlength=len(m)))
            some = length > 0
            bucket = np.zeros(len(m), np.int32)
            bucket[some] = bucket_of(length[some])
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m), pa.array(length), pa.array(bucket), batch.column(2), batch.column(3)],
                ["doc_id", "m", "length", "bucket", "numbers", "times"],
            )
            yield rows.filter(pa.array(some))

    found = counted.mapInArrow(measure, f"doc_id {kind}, m bigint, length double, bucket int, numbers binary, times binary")
    spread = F.xxhash64("doc_id", "numbers", "times", F.spark_partition_id())
    return found.withColumn("spread", spread).repartitionByRange(F.desc("bucket"), "spread").drop("spread")


# --- search -----------------------------------------------------------------------------


class Bucket:
    """Some vectors of about equal length, with lists of documents by term."""

    def __init__(self, numbers, row, value, length):
        order = np.argsort(numbers, kind="stable")
        self.row, self.value, self.length = row[order], value[order], length
        self.terms, begins = np.unique(numbers[order], return_index=True)
        self.begins = np.append(begins, len(order))

    def lists(self, wanted: np.ndarray) -> list[slice]:
        """Of some terms, those that occur, each with its place in the lists."""
        at = np.searchsorted(self.terms, wanted)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)]
        return [slice(self.begins[k], self.begins[k + 1]) for k in at.tolist()]

    def survivors(self, wanted: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may reach the floor, by term bounds, and their exact scores.

        wanted: the terms of a query, those of the largest weight first.
        """
        n, none = len(self.length), np.zeros(0, np.int64)
        if math.sqrt(len(wanted)) * self.length.max() * _MARGIN < floor:
            return none, none
        score, square = np.zeros(n, np.int64), np.zeros(n)
        for part in self.lists(wanted[:FOCUS]):  # a row stands in a list once
            value = self.value[part]
            score[self.row[part]] += value
            square[self.row[part]] += value.astype(float) ** 2
        rest = wanted[FOCUS:]
        # What stays of a squared length may be off by its last digits.
        left = np.sqrt(np.maximum(self.length ** 2 * _MARGIN - square, 0))
        alive = (score + math.sqrt(len(rest)) * left) * _MARGIN >= max(floor, 1)
        if not alive.any():
            return none, none
        for part in self.lists(rest):
            row = self.row[part]
            score[row] += self.value[part]
        rows = np.flatnonzero(alive & (score >= max(floor, 1)))
        return rows, score[rows]


def search(rows: DataFrame, weights: np.ndarray, queries: list[tuple[int, np.ndarray]], floors: dict[int, int], k: int) -> DataFrame:
    """vectors -> (key, doc_id, score): what each task found to be among the best k of a query."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((weights, queries, floors))

    def find(batches):
        import heapq

        import pyarrow as pa

        weight, asked, least = shared.value
        least = dict(least)
        best: dict[int, list] = {key: [] for key, _ in asked}
        for batch in batches:
            order = np.argsort(-batch.column(2).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            ids = batch.column(0).to_pylist()
            for a in range(0, len(ids), TOGETHER):
                part = batch.slice(a, TOGETHER)
                numbers, ends = _joined(part.column(3), np.uint32)
                times, _ = _joined(part.column(4), np.uint32)
                row = np.repeat(np.arange(len(part)), np.diff(ends))
                value = impacts(times, weight[numbers], part.column(1).to_numpy()[row])
                bucket = Bucket(numbers, row, value, part.column(2).to_numpy())
                for key, wanted in asked:
                    found, scores = bucket.survivors(wanted, least.get(key, 0))
                    if not len(found):
                        continue
                    heap = best[key]
                    heap.extend((s, ids[a + r]) for r, s in zip(found.tolist(), scores.tolist()))
                    best[key] = heap = heapq.nsmallest(k, heap, key=lambda x: (-x[0], x[1] is None, x[1]))
                    if len(heap) == k:
                        least[key] = max(least.get(key, 0), heap[-1][0])
        flat = [(key, i, s) for key, heap in best.items() for s, i in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], rows_type), pa.array([x[2] for x in flat], pa.int64())],
            ["key", "doc_id", "score"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    rows_type = to_arrow_type(rows.schema["doc_id"].dataType)
    columns = rows.select("doc_id", "m", "length", "numbers", "times")
    return columns.mapInArrow(find, f"key bigint, doc_id {kind}, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, queries: DataFrame, k: int, first_rows: int) -> DataFrame:
    asked = queries.select("key", "terms").collect()  # at most a block's terms
    vocabulary = {term: at for at, term in enumerate(sorted({bytes(t) for r in asked for t in r["terms"]}))}
    counted = staged(frequencies(docs, vocabulary), "ranking-counts")
    n_docs, n_words = (x or 0 for x in counted.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first())
    df = document_frequencies(counted, len(vocabulary))
    weights = weights_of(df, n_docs)
    # Terms of weight zero add nothing, and no document has those of frequency zero.
    lists = [(r["key"], np.array([vocabulary[bytes(t)] for t in r["terms"]], np.uint32)) for r in asked]
    lists = [(key, wanted[(weights[wanted] > 0) & (df[wanted] > 0)]) for key, wanted in lists]
    lists = [(key, wanted[np.argsort(-weights[wanted], kind="stable")]) for key, wanted in lists if len(wanted)]
    rows = staged(vectors(counted, weights, n_docs, n_words), "ranking-vectors", by="bucket")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    sizes = sorted(map(tuple, sizes.collect()), reverse=True)  # a few for each doubling of the length
    total, first = 0, []
    for bucket, n, _ in sizes:
        first.append(bucket)
        total += n
        if total >= first_rows:
            break
    found = staged(search(rows.filter(F.col("bucket").isin(first)), weights, lists, {}, k), "ranking-first")
    last = _best(found, k).filter(F.col("rank") == k)
    floors = {r["key"]: r["score"] for r in last.select("key", "score").toLocalIterator()}
    # A bucket is read if some query may find something in it.
    reach = max(((math.sqrt(len(wanted)) * _MARGIN / max(floors.get(key, 1), 1)) for key, wanted in lists), default=0.0)
    others = [bucket for bucket, _, longest in sizes if bucket not in first and longest * reach >= 1]
    if others:
        found = found.union(search(rows.filter(F.col("bucket").isin(others)), weights, lists, floors, k))
    return _best(found, k).join(queries.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, first_rows: int = FIRST_ROWS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score: the k
    documents with the highest scores above zero for each item."""
    queries = staged(query_terms(items), "ranking-queries")
    out = None
    for block in blocks_of(queries, block_terms):
        found = _search_block(docs, block, k, first_rows)
        out = found if out is None else out.union(found)
    return out
