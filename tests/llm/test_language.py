"""Cross-parsing against a plain parse, and held-out accuracy."""

import random

import numpy as np

from estilens.llm import language
from texts import prose


def plain(text: bytes, sample: bytes) -> int:
    at = phrases = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        phrases, at = phrases + 1, max(end - 1, at + 1)
    return phrases


def test_phrases_equal_a_plain_parse():
    samples = {"a": b"the cat sat on the mat and then that thing", "b": "der die das und ist nicht schön".encode()}
    model = language.Model(samples)
    rng = random.Random(1)
    texts = [language.folded(np.frombuffer(bytes(rng.choice(b"thecadrisn oxq\xc3\xb6") for _ in range(rng.randrange(200))), np.uint8)) for _ in range(60)]
    got = model.phrases(np.concatenate(texts), np.array([len(t) for t in texts]))
    for k, text in enumerate(texts):
        assert got[k].tolist() == [plain(text.tobytes(), language.folded(np.frombuffer(s, np.uint8)).tobytes()) for s in samples.values()]


def test_segments_add_up():
    model = language.Model({"a": b"abcabcabd"})
    text = language.folded(np.frombuffer(b"abcabdx" * 300, np.uint8))
    parts = [text[k:k + language.SEGMENT] for k in range(0, len(text), language.SEGMENT)]
    assert model.phrases(text, np.array([len(text)]))[0, 0] == sum(plain(p.tobytes(), b"abcabcabd") for p in parts)


def made(lang: str, rng: random.Random, n: int) -> str:
    sounds = {"xa": "ba be bi bo", "xb": "tsch ung ein", "xc": "ção são não"}[lang].split()
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edges(frame, edge_rows):
    rng = random.Random(3)
    of = {100 + k: ("xa", "xb", "xc")[k % 3] for k in range(90)}
    rows = edge_rows + [(i, made(lang, rng, rng.randrange(5, 60))) for i, lang in of.items()] + [(500, "1234 ... !!"), (501, "漢字")]
    docs = frame(rows, lang=lambda i, t: of.get(i))
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    asked = [r for r in got if r["doc_id"] in of and r["held_out"]]
    assert len(asked) > 15 and all(r["lang_pred"] == of[r["doc_id"]] for r in asked)
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 500):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language.identify(docs.limit(0)).count() == 0
    # Nothing to learn from, and one language only.
    none = language.identify(frame(rows)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = language.predict(docs, language.learn(docs.filter("lang = 'xa'"))).collect()
    assert {r["lang_pred"] for r in one if r["doc_id"] in of} == {"xa"}


def test_prediction_reads_the_text_only(frame, edge_rows):
    rng = random.Random(4)
    rows = [(k, made(("xa", "xb")[k % 2], rng, 30)) for k in range(40)]
    model = language.learn(frame(rows, lang=lambda i, t: ("xa", "xb")[i % 2]))
    first = {r["doc_id"]: tuple(r)[1:] for r in language.predict(frame(rows), model).collect()}
    other = {r["doc_id"]: tuple(r)[1:] for r in language.predict(frame([(i + 1000, t) for i, t in rows], lang=lambda i, t: "xz"), model).collect()}
    assert first == {i - 1000: r for i, r in other.items()}
