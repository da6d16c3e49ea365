"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of every document stream through the automaton, which keeps the longest
suffix that some test item contains.  Where it is as long as a window, the words
it covers are hit.  Documents do not move between machines.  An automaton holds the
items of at most about SHARD_WORDS words and is built in a task; with more items there
are several, and one at a time is built, sent out and streamed over the documents, so
that neither the driver nor a task ever holds more than one.  Their hits, which have no
texts, are then united by text.

Defined results: a null or empty text has no words and no hits; an item without
words is ignored; items with equal texts are all reported; a null item id is
reported as an empty name; repeated rows are judged one by one; an empty table of
items or documents gives no hits or no rows.  Columns other than those named are
not read, so their names cannot clash.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.llm.common import staged

WINDOW = 13
#: Words that one automaton may hold (an item is never split); more items are spread over several.
SHARD_WORDS = 2_000_000

#: A-Z become a-z, digits and other letters stay, all other ASCII separates words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def folded_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton over the words of all items (states are lists by number)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark(items)

    @classmethod
    def of(cls, parts: dict) -> "Automaton":
        """From vars() of another: only plain lists and dicts are broadcast."""
        new = object.__new__(cls)
        new.__dict__.update(parts)
        return new

    def _extend(self, last: int, word: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        known = step[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, word, known)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            known = step[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._clone(at, word, known)
        return new

    def _clone(self, at: int, word: bytes, old: int) -> int:
        step, link = self.step, self.link
        new = len(step)
        step.append(dict(step[old]))
        self.length.append(self.length[at] + 1)
        link.append(link[old])
        link[old] = new
        while at >= 0 and step[at].get(word) == old:
            step[at][word] = new
            at = link[at]
        return new

    def _mark(self, items) -> None:
        """What each state reports: the window that ends there, and short items."""
        window, link, length = self.window, self.link, self.length
        order = sorted(range(len(length)), key=length.__getitem__)
        full = [-1] * len(length)
        for state in order[1:]:
            if length[state] >= window:
                full[state] = state if length[link[state]] < window else full[link[state]]
        short: list[list[tuple[int, str]]] = [[] for _ in length]
        self.owners: dict[int, set[str]] = {}
        for name, words in items:
            state = 0
            for at, word in enumerate(words, 1):
                state = self.step[state][word]
                if at >= window:
                    self.owners.setdefault(full[state], set()).add(name)
            if 0 < len(words) < window:
                short[state].append((len(words), name))
        for state in order[1:]:
            if short[link[state]]:
                short[state] = short[state] + short[link[state]]
        self.full = full
        self.short = {state: found for state, found in enumerate(short) if found}
        self.least = min([window, *(n for found in self.short.values() for n, _ in found)])

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (end exclusive) and the items with occurring windows."""
        step, link, length, window, least = self.step, self.link, self.length, self.window, self.least
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        names: set[str] = set()
        state = size = 0
        for at, word in enumerate(words, 1):
            following = step[state].get(word)
            if following is None:
                while state and following is None:
                    state = link[state]
                    following = step[state].get(word)
                if following is None:
                    size = 0
                    continue
                size = length[state] + 1
            else:
                size += 1
            state = following
            if size < least:
                continue
            reach = 0
            if size >= window:
                reach = window
                states.add(self.full[state])
            for n, name in self.short.get(state, ()):
                if n <= size:
                    names.add(name)
                    reach = max(reach, n)
            if reach:
                begin = at - reach
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at))
        for found in states:
            names |= self.owners[found]
        return spans, names


def _shards(items: DataFrame, shard_words: int) -> list[DataFrame]:
    """Items in parts of about so many words, as filters on the table."""
    items = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word takes two bytes at least, with the space after it.
    n = -(-size // (2 * shard_words)) or 1
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _build(part: DataFrame, window: int) -> bytes | None:
    """The automaton of a part, built in one task; nothing if no item has a word."""

    def build(table):
        import pyarrow as pa

        items = [(r["item"], words) for r in table.to_pylist() if (words := folded_words(r["text"]))]
        return pa.table({"parts": pa.array([pickle.dumps(vars(Automaton(items, window)))] if items else [], pa.binary())})

    row = part.groupBy().applyInArrow(build, "parts binary").first()
    return bytes(row["parts"]) if row else None


def _hits(docs: DataFrame, automata: list, key: str) -> DataFrame:
    """docs(key, text) -> key, n_words, spans, items by one automaton (broadcast bytes), or none."""
    kind = docs.schema[key].dataType.simpleString()

    def find(batches):
        import pyarrow as pa

        known = [Automaton.of(pickle.loads(b.value)) for b in automata]
        for batch in batches:
            sizes, spans, names = [], [], []
            for text in batch.column(1):
                words = folded_words(text.as_py())
                where, which = known[0].hits(words) if known else ([], set())
                sizes.append(len(words))
                spans.append([{"begin": a, "end": b} for a, b in where])
                names.append(sorted(which))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array(names, pa.list_(pa.string())),
                ],
                [key, "n_words", "spans", "items"],
            )

    return docs.select(key, "text").mapInArrow(find, f"{key} {kind}, n_words bigint, {_FOUND}")


_FOUND = "spans array<struct<begin:bigint,end:bigint>>, items array<string>"


def _merge_hits(hits: DataFrame) -> DataFrame:
    """Hits of several automata as one row per text: spans united, names in order."""
    span = "struct<begin:bigint,end:bigint>"

    def add(merged, x):
        last = F.get(merged, F.size(merged) - 1)
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end")).cast(span)
        joined = F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(wider))
        return F.when(x["begin"] <= last["end"], joined).otherwise(F.concat(merged, F.array(x)))

    # As many spans as a text has words, as many names as there are items.
    both = hits.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return both.select("key", F.aggregate("s", F.array().cast(f"array<{span}>"), add).alias("spans"), "items")


def _text_key(text) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _found_by_text(docs: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """(key, spans, items) of every text with hits, one automaton at a time: a pass over
    the documents for each part, whose hits are written before the next one is built."""
    spark, found = docs.sparkSession, None
    for part in parts:
        automaton = _build(part, window)
        if automaton is None:
            continue
        sent = spark.sparkContext.broadcast(automaton)
        hits = _hits(docs.select(_text_key(F.col("text")).alias("key"), "text"), [sent], "key").filter(F.size("spans") > 0)
        hits = staged(hits.drop("n_words").dropDuplicates(["key"]), "benchmark-hits")
        sent.unpersist()
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"key string, {_FOUND}")
    return staged(_merge_hits(found), "benchmark-found")


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> per document n_words, the hit
    spans in words (array of begin, end) and the names of items with occurring windows.

    Items of up to shard_words words are one automaton, and one pass is all; more are
    several, of which one at a time is sent to the tasks.
    """
    parts = _shards(items, shard_words)
    if len(parts) == 1:
        automaton = _build(parts[0], window)
        sent = [docs.sparkSession.sparkContext.broadcast(automaton)] if automaton else []
        return _hits(docs, sent, "doc_id")
    found = _found_by_text(docs, parts, window)
    plain = _hits(docs.select(F.struct("doc_id", _text_key(F.col("text")).alias("key")).alias("doc"), "text"), [], "doc")
    rows = plain.select("doc.*", "n_words").join(found, "key", "left")
    empty = {"spans": "array<struct<begin:bigint,end:bigint>>", "items": "array<string>"}
    return rows.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in empty.items()])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns for every document."""
    found = benchmark_hits(docs, items, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given words; what separates the others stays."""
    data = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(data.translate(_FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for begin, end in spans:
        kept.append(data[at:starts[begin]])
        at = int(ends[end - 1])
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents of which one word in so many is hit go; hit spans go from the others.

    Keeps all columns of docs, in order; n_chars, if there, follows the new text.
    """
    parts = _shards(items, shard_words)
    names, at = docs.columns, docs.columns.index("text")
    count = names.index("n_chars") if "n_chars" in names else -1
    automata, rows = [], docs
    if len(parts) == 1:
        if automaton := _build(parts[0], window):
            automata = [docs.sparkSession.sparkContext.broadcast(automaton)]
    else:
        # The spans of several automata meet the texts before anything is cut.
        found = _found_by_text(docs, parts, window).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
        rows = docs.withColumn("__key", _text_key(F.col("text"))).join(found, "__key", "left").select(*names, "__spans")

    def clean(batches):
        import pyarrow as pa

        known = [Automaton.of(pickle.loads(b.value)) for b in automata]
        for batch in batches:
            texts, keep = [], []
            for row, text in enumerate(batch.column(at)):
                text = text.as_py()
                words = folded_words(text)
                if known:
                    where = known[0].hits(words)[0]
                else:
                    given = batch.column(len(names))[row].as_py() if len(batch.columns) > len(names) else None
                    where = [(s["begin"], s["end"]) for s in given or []]
                n_hit = sum(b - a for a, b in where)
                keep.append(not (n_hit and one_in * n_hit >= len(words)))
                texts.append(_cut(text, where) if where else text)
            columns = list(batch.columns)[:len(names)]
            new = pa.array(texts, batch.schema.field(at).type)
            if count >= 0:
                sizes = [len(b) if a is not None and b is not None and a != b else n.as_py()
                         for a, b, n in zip((t.as_py() for t in columns[at]), texts, columns[count])]
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            columns[at] = new
            out = pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:len(names)]))
            yield out.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(clean, docs.schema)
