"""Shared storage, inputs and word arrays of the text operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    A local session without that setting (a test) gets a temporary folder;
    a cluster without it is an error, since executors would not see each
    other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-stages-"))
    return spark.sparkContext.getCheckpointDir()


def staged(rows: DataFrame, name: str, by: str = "") -> DataFrame:
    """Write a table that later steps read, and read it back: cuts the lineage
    and outlives lost executors.  Filters on the column by select folders."""
    path = f"{shared_root(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*[by] if by else []).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once per row.

    The optimizer copies a named expression into every lambda that mentions it
    and would compute it again per element; a lambda's own variable is not copied.
    """
    return F.transform(F.array(value), use)[0]


# --- words as arrays ------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and where each row starts; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunks
        texts = pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int):
    """Ranges of rows of about size bytes each; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word's number per row (one more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(separator[data], out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = inside[:-1]
    stops[:-1] &= begins[:-1] | ~inside[:-1]
    ends = np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
    values = _BYTES[data[within + np.repeat(starts, lengths)]]
    values *= powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first[:-1]) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, length: int, multiplier: np.uint64 = _MIX_1) -> np.ndarray:
    """A hash of every run of so many words; empty if there are fewer.

    Another multiplier, odd, gives another hash.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(length):
            out += words[k:k + n] * factor
            factor = factor * multiplier
    return mix(out)
