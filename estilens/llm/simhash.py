"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are 64 bits; two are linked if they differ in at most three.  The
index is a tree of masked bit patterns.  Its upper nodes are dealt out by Spark:
of four blocks of the bits that are still open, two linked fingerprints share one
entirely, so a node is "these blocks have these values", and a fingerprint stands
below four nodes.  A node with more members than one task should hold is factored
again, on the bits it leaves open; since members are distinct, nodes end.  Inside
a node, members are sorted by Gray rank (neighbours then share long bit patterns)
and grouped; a group's mask has the bits on which its members agree.  Differences
on bits that two groups both fix add up from upper to lower groups, and as soon as
they exceed three, everything below the two groups is left out.

What a node returns is a spanning forest: its components, as links to each one's
smallest fingerprint, so at most one row per member however many pairs there are.
Components across nodes follow by alternating stars, as joins of written tables.

Defined results: a null or empty text, or one without words, has the fingerprint
zero and is linked like any other; fewer words than a shingle form one shingle;
equal texts share a fingerprint; repeated rows are one document each; a null
doc_id is never the smallest of its group while there is another; an empty table
gives an empty result.  Only doc_id and text are read by the fingerprints.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estilens.llm.common import staged

BITS, FAR = 64, 3
SHINGLE, SEED = 3, 42
#: Members that one task sorts and compares; larger nodes are factored further.
NODE_ROWS = 20_000
#: Members of a lowest group, and lowest groups of an upper one.
GROUP, UPPER = 16, 16

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


# --- fingerprints ---------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles of a text, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[:n - 1] + 1).tolist()]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1:].tolist())), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at:at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a long with the same bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            prints = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, fingerprint bigint")


# --- the index inside a node ------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _groups(values: np.ndarray, mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of size nodes: the bits they fix alike, and the values there."""
    begins = np.arange(0, len(values), size)
    ones = np.bitwise_and.reduceat(values & mask, begins)
    zeros = np.bitwise_and.reduceat(~values & mask, begins)
    return ones, ones | zeros


def _near(values, mask, a, b):
    """Of the pairs a, b: those that may be close, by the bits that both fix."""
    return np.bitwise_count((values[a] ^ values[b]) & mask[a] & mask[b]) <= FAR


def _below(a: np.ndarray, b: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of pairs of groups, each once."""
    steps = np.arange(size)
    left = np.repeat(a[:, None] * size + steps, size, axis=1).ravel()
    right = np.tile(b[:, None] * size + steps, (1, size)).ravel()
    keep = (left <= right) & (right < n)
    return left[keep], right[keep]


def close_pairs(codes: np.ndarray):
    """Pairs of places in codes (distinct, in Gray order) that differ in at most
    three bits, in parts of bounded size."""
    n = len(codes)
    all_bits = np.full(n, ~np.uint64(0))
    low, low_mask = _groups(codes, all_bits, GROUP)
    top, top_mask = _groups(low, low_mask, UPPER)
    every = np.arange(len(top))
    for at in range(len(top)):
        right = every[at:]
        right = right[_near(top, top_mask, np.full(len(right), at), right)]
        for part in np.array_split(right, len(right) // 64 + 1):
            a, b = _below(np.full(len(part), at), part, UPPER, len(low))
            keep = _near(low, low_mask, a, b)
            a, b = _below(a[keep], b[keep], GROUP, n)
            keep = (a < b) & (np.bitwise_count(codes[a] ^ codes[b]) <= FAR)
            yield a[keep], b[keep]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put the components of each pair under their smallest member."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def forest(masks: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of some nodes to the smallest of their component.

    Nodes of one lowest group are compared directly, all of them at once.
    """
    order = np.lexsort((gray_rank(codes), values, masks))
    masks, values, codes = masks[order], values[order], codes[order]
    known, place = np.unique(codes.view(np.int64), return_inverse=True)
    root = np.arange(len(known))
    begins = np.flatnonzero(np.concatenate(([True], (masks[1:] != masks[:-1]) | (values[1:] != values[:-1]))))
    sizes = np.diff(np.append(begins, len(codes)))
    left = np.repeat(np.where(sizes <= GROUP, begins + sizes, 0), sizes)
    for apart in range(1, GROUP):
        a = np.flatnonzero(np.arange(len(codes)) + apart < left)
        b = a + apart
        close = np.bitwise_count(codes[a] ^ codes[b]) <= FAR
        _merge(root, place[a[close]], place[b[close]])
    for at, size in zip(begins[sizes > GROUP].tolist(), sizes[sizes > GROUP].tolist()):
        for a, b in close_pairs(codes[at:at + size]):
            _merge(root, place[at + a], place[at + b])
    linked = root != np.arange(len(known))
    return known[root[linked]], known[linked]


# --- upper nodes ----------------------------------------------------------------


def _blocks(open_bits: int) -> list[int]:
    """FAR + 1 masks over the given bits: two codes within FAR share one block."""
    places = [i for i in range(BITS) if open_bits >> i & 1]
    size = -(-len(places) // (FAR + 1))
    return [sum(1 << i for i in places[k:k + size]) for k in range(0, len(places), size)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(codes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """codes(code), distinct and written -> links (a, b), a < b, that connect all
    codes within three bits of each other, directly or through others."""
    # A task holds a few nodes' worth of members; every code stands below FAR + 1 nodes.
    buckets = -(-codes.count() * (FAR + 1) // node_rows) or 1
    members = codes.select(F.lit(0).cast("bigint").alias("mask"), "code")
    masks, found = [0], []
    while masks:
        below = F.lit(None).cast("array<bigint>")
        for mask in masks:
            children = F.array(*[F.lit(_signed(mask | block)) for block in _blocks(~mask & ((1 << 64) - 1))])
            below = F.when(F.col("mask") == _signed(mask), children).otherwise(below)
        nodes = members.select(F.explode(below).alias("mask"), "code").withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
        if found:  # two nodes above may lead to the same one
            nodes = nodes.distinct()
        large = nodes.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_rows)
        large = staged(large.select("mask", "value"), "simhash-large")
        # As many masks at most as there are blocks at each level above, never nodes.
        masks = [r[0] & ((1 << 64) - 1) for r in large.select("mask").distinct().collect()]
        if masks:
            members = staged(nodes.join(large, ["mask", "value"], "left_semi").select("mask", "code"), "simhash-nodes")
            nodes = nodes.join(large, ["mask", "value"], "left_anti")
        bucket = F.pmod(F.xxhash64("mask", "value"), F.lit(buckets)).alias("bucket")
        found.append(nodes.select(bucket, "mask", "value", "code").groupBy("bucket").applyInArrow(_forest_of, "a bigint, b bigint"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _forest_of(table):
    import pyarrow as pa

    mask, value, code = (table[name].to_numpy().view(np.uint64) for name in ("mask", "value", "code"))
    a, b = forest(mask, value, code)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


# --- components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (code, root) for every end: the smallest end reachable.

    Each round ties every neighbour of a node to the smallest one, first on the
    larger side, then on the smaller, until nothing changes; stars remain.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "code")


def rooted(prints: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """prints(doc_id, fingerprint), written -> (code, first, root): of each distinct
    fingerprint its smallest doc_id and the smallest fingerprint it is connected with."""
    codes = staged(prints.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("first")), "codes")
    found = codes.join(components(links(codes.select("code"), node_rows)), "code", "left")
    return staged(found.select("code", "first", F.coalesce("root", "code").alias("root")), "roots")


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id."""
    prints = staged(fingerprints(docs), "fingerprints")
    codes = rooted(prints, node_rows)
    # One row per distinct fingerprint: copies meet their group only in the last join.
    group = codes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = codes.join(group, "root").select(F.col("code").alias("fingerprint"), "component_id")
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; all columns as given.

    Of rows with that doc_id the one with the smaller checksum stays, of equal rows one.
    """
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    # Rows are known by a checksum: an id may stand for several texts.
    prints = staged(fingerprints(docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), "text")), "fingerprints")
    prints = prints.select("doc_id.*", "fingerprint")
    codes = rooted(prints, node_rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = prints.groupBy(F.col("fingerprint").alias("code")).agg(F.min(order).alias("best"))
    kept = codes.join(best, "code").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias("key"))
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
