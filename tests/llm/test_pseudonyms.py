"""Pseudonyms: permutations, formats, links and the way back."""

import datetime
import random
import re

import pytest

from estilens.llm import pseudonyms
from estilens.llm.pseudonyms import KINDS, Feistel, Pseudonyms, luhn_digit

TEXT = (
    "Mail jane.Doe-9@Ex-ample.co.uk, card 4785380592391139 or 4785-3805-9239-1139. Tel +1 (743) 555-3824, (743) 555-3824 743-555-3824 "
    "ip 152.143.123.131 300.1.1.1 on 2021-03-04, 31.12.1999 12/25/2020 2021-13-45 v1.2.3.4.5 ssn 123-45-6789 666-45-6789 "
    "IBAN GB82WEST12345698765432 GB82 WEST 1234 5698 7654 32 GB83WEST12345698765432 dup@x.com dup@x.com 1234567812345678"
)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_feistel_is_a_permutation_with_an_inverse(n):
    net = Feistel(b"key")
    image = [net.permute(k, n, "name") for k in range(n)]
    assert sorted(image) == list(range(n))
    assert [net.permute(k, n, "name", True) for k in image] == list(range(n))


def test_round_trip_and_formats():
    names = Pseudonyms(b"key")
    new, spans = names.text(TEXT)
    assert names.text(new, back=True)[0] == TEXT
    assert len(new) == len(TEXT) + sum(len(b) - len(a) for a, b in [("152.143.123.131", re.search(r"ip (\S+)", new)[1])])
    found = {kind: [TEXT[a:b] for a, b, k in spans if k == kind] for kind in KINDS}
    assert found == {
        "email": ["jane.Doe-9@Ex-ample.co.uk", "dup@x.com", "dup@x.com"], "iban": ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"],
        "card": ["4785380592391139", "4785-3805-9239-1139"], "ssn": ["123-45-6789"],
        "phone": ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824"], "ip": ["152.143.123.131"], "date": ["2021-03-04", "31.12.1999", "12/25/2020"],
    }
    for same in (found["card"], found["iban"], found["phone"], ["dup@x.com", "dup@x.com"]):
        assert len({re.sub(r"\W", "", names.replace(next(k for k in KINDS if same[0] in found[k]), x))[-10:] for x in same}) == 1
    card = names.replace("card", "4785380592391139")
    assert luhn_digit(card[:-1]) == int(card[-1]) and card != "4785380592391139"
    datetime.date.fromisoformat(names.replace("date", "2021-03-04"))
    assert all(x in new for x in ("300.1.1.1", "2021-13-45", "v1.2.3.4.5", "666-45-6789", "GB83WEST12345698765432", "1234567812345678"))


@pytest.mark.parametrize("text, values", [
    ("+1 (826) 555-4081 190.137.223.5 x", ["+1 (826) 555-4081", "190.137.223.5"]),
    ("+1 (843) 555-7672 12", ["+1 (843) 555-7672"]),
    ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
    ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
    ("77 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("ES91 2100 0418 4502 0005 1332 BIC", ["ES91 2100 0418 4502 0005 1332"]),
    ("call 1-800-555-1234 or 555 123 4567", ["1-800-555-1234", "555 123 4567"]),
])
def test_numbers_beside_each_other(text, values):
    new, spans = Pseudonyms(b"key").text(text)
    assert [text[a:b] for a, b, _ in spans] == values and all(v not in new for v in values)


def test_different_values_get_different_pseudonyms():
    names = Pseudonyms(b"key")
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=k)).isoformat() for k in range(0, 73049, 31)]
    assert len({names.replace("date", d) for d in days}) == len(days)
    assert len({names.replace("ip", f"10.0.{k % 256}.{k // 256}") for k in range(2000)}) == 2000
    assert Pseudonyms(b"other").replace("ip", "10.0.0.1") != names.replace("ip", "10.0.0.1")


def test_documents(frame, edge_rows):
    rows = edge_rows + [(20, TEXT), (21, "card 4785380592391139."), (21, "card 4785380592391139."), (22, "7" * 5000 + " a@" * 2000)]
    got = pseudonyms.pseudonymise(frame(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[1] is None and texts[4] == dict(edge_rows)[4] and texts[21].split()[1][:-1] in texts[20]
    assert {r["doc_id"]: r["n_found"] for r in got}[21] == 1
    assert pseudonyms.pseudonymise(frame(rows).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["josé", "Müller.jürgen", "ИВАН.petrov-9", "straße", "李.wei", "a" * 100, "İpek_Şen", "ﬁ.x", "x+tag"])
def test_whole_names_of_any_alphabet(name):
    names = Pseudonyms(b"key")
    text = f"mail {name}@firma.de, {name}@firma.de"
    new, spans = names.text(text)
    assert [text[a:b] for a, b, _ in spans] == [f"{name}@firma.de"] * 2
    got = new.split()[1].removesuffix("@firma.de,")
    assert new.split()[2] == f"{got}@firma.de" and len(got) == len(name) and got != name
    assert [(c.isalnum(), c.isupper() and c != pseudonyms._folded(c)) for c in got] == [(c.isalnum(), c.isupper() and c != pseudonyms._folded(c)) for c in name]
    assert names.text(new, back=True)[0] == text
    if len(name) > 10:
        assert sum(a == b for a, b in zip(got, name)) < len(name) // 2


def test_spellings_of_a_name_stay_linked():
    names = Pseudonyms(b"key")
    assert names.replace("email", "JÜRGEN@x.de").lower() == names.replace("email", "jürgen@x.de")


@pytest.mark.parametrize("number, country", [("+44 20 7946 0958", "+44"), ("+1 743 555 3824", "+1"), ("+354 555 1234", "+354"), ("+7 495 123 4567", "+7"), ("+998 71 123 4567", "+998")])
def test_country_codes_stay(number, country):
    names = Pseudonyms(b"key")
    new, spans = names.text(f"call {number}.")
    assert spans == [(5, 5 + len(number), "phone")] and new.startswith(f"call {country} ") and new != f"call {number}."
    assert [len(x) for x in new.split()] == [len(x) for x in f"call {number}.".split()]
    assert names.text(new, back=True)[0] == f"call {number}."


def test_the_finder_leaves_no_valid_number():
    """All substrings of random texts against the checks."""
    rng = random.Random(9)
    names = Pseudonyms(b"key")
    cards = ["4111111111111111", "378282246310005", "5555 5555 5555 4444", "6011-1111-1111-1117"]
    ibans = ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"]
    seen = 0
    for _ in range(150):
        parts = [rng.choice([*cards, *ibans, "12", "x", "4111 1111", "+1 (843) 555-7672", "2021-03-04", str(rng.randrange(10**rng.randrange(1, 17)))]) for _ in range(4)]
        text = rng.choice([" ", ", ", " x "]).join(parts)
        covered = [False] * len(text)
        for a, b, _ in names.text(text)[1]:
            covered[a:b] = [True] * (b - a)
        for a in range(len(text)):
            for b in range(a + 13, min(a + 40, len(text)) + 1):
                whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
                s = text[a:b]
                card = re.fullmatch(r"\d(?:[ -]?\d){12,18}", s) and names.replace("card", s)
                iban = re.fullmatch(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", s) and names.replace("iban", s)
                if whole and (card or iban):
                    seen += 1
                    assert any(covered[a:b]), (text, s)
    assert seen > 100
