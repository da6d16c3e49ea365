"""Repeated passages by difference-cover anchors.

A set of residues D is a difference cover of a period m if every difference mod m
is one of two members of D.  Hashing short windows only where the position mod m
is in D is then enough: a passage repeated at positions i and j, of at least m - 1
words more than an anchor, has a shift k < m at which i + k and j + k both are
anchors, and their hashes agree.  Anchors found twice are extended to the full
window on both sides, and only those windows are hashed and counted again, so
that nothing rests on an anchor alone.  Windows are the same if two hashes of 64 bits
with different multipliers agree (over 64-bit hashes of their words): 10^12 windows
have one false pair with a probability of about 10^-15.

Work is dealt out in blocks of documents.  A block asks about the hashes it has,
each once, split by hash range over buckets; a bucket answers with a bit for each:
does it occur elsewhere.  A passage that fills a third of the corpus therefore
reaches its bucket once per block, not once per copy, and no pair is ever made.
The texts are shuffled once; both rounds and the removal read that same exchange.

Defined results: a null or empty text has no words; documents shorter than a
window lose nothing; a row is a document, also if its id or its whole content is
repeated (then all of it is removed); an empty table gives an empty result.  Only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estilens.llm.common import chunks, text_buffer, window_hashes, word_bounds, word_hashes

WINDOW = 35
#: Perfect difference covers by period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Odd multipliers of the two hashes of a window; anchors have the first one.
MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93))
#: An anchor of fewer words matches by chance too often.
ANCHOR_WORDS = 12
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Texts are hashed in pieces of about so many bytes (a longer text is one piece).
PIECE_BYTES = 1 << 20

#: kind: 1 for anchors, 2 for windows, which is also the number of hashes of each.
ASK = "kind int, block bigint, bucket bigint, hashes binary, twice binary"
ANSWER = "kind int, block bigint, bucket bigint, n bigint, bits binary"


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover whose anchors still are long enough."""
    fit = [m for m in COVERS if window - m + 1 >= min(ANCHOR_WORDS, window - min(COVERS) + 1)]
    return (max(fit), COVERS[max(fit)]) if fit and window >= min(COVERS) else (1, (0,))


class _Block:
    """The documents of a block, in a fixed order, with the hashes of their words."""

    def __init__(self, table, window: int):
        order = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.texts, self.window = order["doc_id"], order["text"], window
        data, offsets = text_buffer(order["text"])
        hashes, counts = [], [np.zeros(0, np.int64)]
        for a, b in chunks(offsets, PIECE_BYTES):
            part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            starts, ends, first = word_bounds(part, at)
            hashes.append(word_hashes(part, starts, ends))
            counts.append(np.diff(first))
        self.words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.counts = np.concatenate(counts)
        ends = np.cumsum(self.counts)
        starts = ends - self.counts
        # Positions within their documents, and words from there to the end.
        number = np.arange(len(self.words))
        self.position = number - np.repeat(starts, self.counts)
        self.left = np.repeat(ends, self.counts) - number

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors and their hashes (one column), in documents that have a window."""
        period, cover = cover_of(self.window)
        size = self.window - period + 1
        residues = np.zeros(period, bool)
        residues[list(cover)] = True
        at = np.flatnonzero(residues[self.position % period] & (self.left >= size) & (self.position + self.left >= self.window))
        return at, self._hashes(at, size, MULTIPLIERS[:1])

    def windows(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window may be repeated, extending the anchors at known, and two hashes of each."""
        period, _ = cover_of(self.window)
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, np.maximum(known - np.minimum(period - 1, self.position[known]), 0), 1)
        np.add.at(change, known + 1, -1)
        at = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (self.left >= self.window))
        return at, self._hashes(at, self.window, MULTIPLIERS)

    def _hashes(self, at: np.ndarray, size: int, multipliers) -> np.ndarray:
        """A column for each multiplier."""
        if not len(at):
            return np.zeros((0, len(multipliers)), np.uint64)
        return np.stack([window_hashes(self.words, size, m)[at] for m in multipliers], axis=1)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, the place of each row among them, and how often each occurs."""
    order = np.lexsort(hashes.T[::-1])
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(ranked), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place, np.bincount(place, minlength=int(new.sum()))


def _ask(kind: int, block: int, hashes: np.ndarray, buckets: int):
    """One row per bucket: the distinct hashes in order, and which are here twice."""
    import pyarrow as pa

    found, _, counts = _distinct(hashes)
    twice = counts > 1
    # Hash ranges of equal width: bucket k holds hashes from k * width on.
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(found[:, 0], np.array([min(k * width, (1 << 64) - 1) for k in range(1, buckets)], np.uint64)) if buckets > 1 else []
    cuts = [0, *map(int, edges), len(found)]
    used = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
    return pa.table({
        "kind": pa.array([kind] * len(used), pa.int32()), "block": pa.array([block] * len(used), pa.int64()),
        "bucket": pa.array(used, pa.int64()),
        "hashes": pa.array([found[cuts[k]:cuts[k + 1]].tobytes() for k in used], pa.binary()),
        "twice": pa.array([np.packbits(twice[cuts[k]:cuts[k + 1]]).tobytes() for k in used], pa.binary()),
    })


def _answer(table):
    """For each question of a bucket: which hashes occur twice in all of them."""
    import pyarrow as pa

    columns = table["kind"][0].as_py()  # all questions of a bucket are of one kind
    asked = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, columns) for x in table["hashes"]]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)) for x, h in zip(table["twice"], asked)]
    _, place, counts = _distinct(np.concatenate(asked))
    known = (counts[place] > 1) | np.concatenate(twice).astype(bool)
    ends = np.cumsum([len(h) for h in asked])
    return pa.table({
        "kind": table["kind"], "block": table["block"], "bucket": table["bucket"],
        "n": pa.array([len(h) for h in asked], pa.int64()),
        "bits": pa.array([np.packbits(x).tobytes() for x in np.split(known, ends[:-1])], pa.binary()),
    })


def _repeated(hashes: np.ndarray, answers, kind: int) -> np.ndarray:
    """For each hash of a block, whether the answers say that it occurs twice."""
    if not len(hashes):
        return np.zeros(0, bool)
    rows = sorted(((r["bucket"], r["n"], r["bits"]) for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r[0])
    known = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for _, n, bits in rows]).astype(bool)
    return known[_distinct(hashes)[1]]


def _remove(block: _Block, starts: np.ndarray):
    """The contract's columns, without the words of the windows that begin at starts."""
    import pyarrow as pa

    change = np.zeros(len(block.words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + block.window, -1)
    gone = np.cumsum(change[:-1]) > 0
    removed, digests, at = [], [], 0
    for text, n in zip(block.texts, block.counts.tolist()):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        lost = gone[at:at + n]
        removed.append(int(lost.sum()))
        if removed[-1]:
            words = list(compress(words, ~lost))
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        at += n
    return pa.table({
        "doc_id": block.ids, "n_words": pa.array(block.counts, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
    })


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256: each document
    without the words that windows found anywhere else cover."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = math.ceil(size / block_bytes) or 1, math.ceil(size / bucket_bytes) or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def ask_anchors(table):
        return _ask(1, table["block"][0].as_py(), _Block(table, window).anchors()[1], buckets)

    def places(table, answers):
        block = _Block(table, window)
        at, hashes = block.anchors()
        return block, *block.windows(at[_repeated(hashes, answers, 1)])

    def ask_windows(table, answers):
        block, _, hashes = places(table, answers)
        return _ask(2, table["block"][0].as_py(), hashes, buckets)

    def remove(table, answers):
        block, at, hashes = places(table, answers)
        return _remove(block, at[_repeated(hashes, answers, 2)])

    by_block = placed.groupBy("block")
    first = by_block.applyInArrow(ask_anchors, ASK).groupBy("bucket").applyInArrow(_answer, ANSWER)
    second = by_block.cogroup(first.groupBy("block")).applyInArrow(ask_windows, ASK).groupBy("bucket").applyInArrow(_answer, ANSWER)
    return by_block.cogroup(first.union(second).groupBy("block")).applyInArrow(
        remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    )
