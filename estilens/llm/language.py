"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sample text knows every string in it.  A
text is parsed against it from left to right: each phrase is the longest match that
begins where the last one ended, and a symbol that the sample lacks is a phrase by
itself.  Phrases, times the logarithm of the sample's size and per symbol of the
text, estimate the cross entropy; the language with the least wins.

A parse needs no suffix links: where there is no transition the next phrase begins
at the root, so each automaton becomes one table of next states, and many segments
of many texts walk through the tables of all languages at once.  Texts are parsed
whole, in segments of SEGMENT symbols; a phrase ends with its segment.

Bounds: automata are built from at most SAMPLE_TEXTS texts and SAMPLE_BYTES bytes of
each language (the first texts in the order of a hash, over all labelled rows), and
from TOTAL_BYTES bytes in all, so their tables have a bounded size for any number of
languages.  Prediction reads the text only.

Defined results: a null text, or one without letters, is "und" with score 0; equal
texts get equal results; with one language known all other texts are in it, with
score 1; with none they are "und"; of languages with equal entropies the first by
name wins; a null language is not learned, an empty name is one like others; an empty table gives
an empty result.  Other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estilens.llm.common import chunks, staged, text_buffer

SAMPLE_TEXTS, SAMPLE_BYTES, TOTAL_BYTES = 200, 20_000, 200_000
#: More values than this in the column of languages are an error.
MOST_LANGUAGES = 1000
SEGMENT, PIECE_BYTES = 512, 1 << 20
UNKNOWN = "und"

#: Bytes: letters in lower case and parts of other characters stay, the rest is a space.
_FOLD = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)], np.uint8)


def folded(data: np.ndarray) -> np.ndarray:
    """Letters with single spaces between words."""
    data = _FOLD[data]
    space = data == 0x20
    return data[~(space & np.concatenate(([True], space[:-1])))] if len(data) else data


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new, at = len(step), last
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            old = step[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(step)
                step.append(dict(step[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                link[old] = link[new] = copy
                while at >= 0 and step[at].get(c) == old:
                    step[at][c] = copy
                    at = link[at]
        last = new
    return step


class Model:
    """Parsing tables of all languages, one behind the other."""

    def __init__(self, samples: dict[str, bytes]):
        parts = {lang: folded(np.frombuffer(text, np.uint8)) for lang, text in sorted(samples.items())}
        self.languages = list(parts)
        known = np.unique(np.concatenate([*parts.values(), np.array([0x20], np.uint8)]))
        # Symbols of the samples, one for all others, and one that fills segments up.
        self.width = len(known) + 2
        self.code = np.full(256, len(known), np.intp)
        self.code[known] = np.arange(len(known))
        self.bits = np.array([np.log2(max(len(text), 2)) for text in parts.values()])
        tables, self.roots, first = [], [], 0
        for text in parts.values():
            step = automaton(self.code[text].tolist())
            # One state more, for a symbol that the sample lacks: any other ends that phrase.
            table = np.full((len(step) + 1, self.width), -1, np.int32)
            for state, following in enumerate(step):
                for c, to in following.items():
                    table[state, c] = to
            begin = np.where(table[0] >= 0, table[0], len(step))
            table[0] = begin
            # A negative entry ends the phrase: the next one begins with this symbol.
            table = np.where(table >= 0, (table + first) * self.width, ~((begin + first) * self.width)).astype(np.int32)
            table[:, -1] = (np.arange(len(table)) + first) * self.width
            tables.append(table.ravel())
            self.roots.append(first * self.width)
            first += len(step) + 1
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    @classmethod
    def of(cls, parts: dict) -> "Model":
        new = object.__new__(cls)
        new.__dict__.update(parts)
        return new

    def phrases(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of rows of folded text, per row and language."""
        segments = -(-sizes // SEGMENT)
        row = np.repeat(np.arange(len(sizes)), segments)
        total = int(segments.sum())
        out = np.zeros((len(sizes), len(self.languages)))
        if not total:
            return out
        # Each row's symbols fill its segments from the first one on.
        codes = np.full(total * SEGMENT, self.width - 1, np.intp)
        places = np.arange(len(data)) + np.repeat(
            np.concatenate(([0], np.cumsum(segments)[:-1])) * SEGMENT - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes
        )
        codes[places] = self.code[data]
        codes = np.ascontiguousarray(codes.reshape(total, SEGMENT).T)
        for k, root in enumerate(self.roots):
            state = np.full(total, root, np.int32)
            count = np.ones(total, np.int32)  # the phrase that the segment's end ends
            for symbols in codes:
                state = self.table[state + symbols]
                ended = state >> 31
                count -= ended
                state ^= ended
            out[:, k] = np.bincount(row, count, minlength=len(sizes))
        return out


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES, total: int = TOTAL_BYTES) -> Model:
    """A model from docs(text, lang): of each language the first texts by hash."""
    rows = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text", F.lit(3)))
    # Hash ranges that hold enough texts, from their counts: a language's rows never meet in one task.
    part = F.shiftrightunsigned("h", 52)
    hashes = rows.select("lang", "h").distinct()
    counts = staged(hashes.groupBy("lang", part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "language-counts")
    if (languages := counts.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; MOST_LANGUAGES is {MOST_LANGUAGES}")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).filter(F.col("before") < texts).groupBy("lang").agg(F.max("part").alias("last"))
    few = hashes.join(F.broadcast(last), "lang").filter(part <= F.col("last"))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h")
    chosen = few.select("lang", "h", F.row_number().over(first).alias("n")).filter(F.col("n") <= texts)
    # Only the bytes that may be used come to the driver: so many of each language, in order of n.
    need = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "n", F.substring("text", 1, size).alias("text"))
    need = need.groupBy("lang", "n").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    need = need.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < size)
    samples: dict[str, bytes] = {}
    for r in need.orderBy("lang", "n").toLocalIterator():
        samples[r["lang"]] = samples.get(r["lang"], b"") + r["text"].encode("utf-8", "surrogatepass") + b" "
    share = min(size, total // max(len(samples), 1))
    return Model({lang: text[:share] for lang, text in samples.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every whole text."""
    tables = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def parse(batches):
        import pyarrow as pa

        known = Model.of(tables.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            languages, scores = [], []
            for a, b in chunks(offsets, PIECE_BYTES):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                rows = [folded(part[at[i]:at[i + 1]]) for i in range(b - a)]
                sizes = np.array([len(r) for r in rows])
                cost = known.phrases(np.concatenate(rows), sizes) * known.bits
                for i, row in enumerate(rows):
                    lettered = (row != 0x20).any() and (
                        ((row >= 0x61) & (row <= 0x7A)).any() or any(map(str.isalpha, row.tobytes().decode("utf-8", "ignore")))
                    )
                    if not lettered or not known.languages:
                        languages.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(cost[i]))
                    others = np.delete(cost[i], best)
                    languages.append(known.languages[best])
                    scores.append(float(1 - cost[i][best] / others.min()) if len(others) else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(parse, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str) -> Column:
    """Documents that are not learned from: the remainder of the id's checksum is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from the part that is not held out."""
    found = predict(docs, learn(docs.filter(~held_out("doc_id"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
