"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their check are replaced by others of the same format:
a keyed Feistel network permutes the numbers below the size of the format, so that
equal values get equal pseudonyms in all documents, different values different ones,
and the holder of the key can go back.  Separators, lengths, prefixes, capital
letters and check digits keep their form, so what was valid stays valid.

Kinds: e-mail addresses (the whole name before the sign, letters of any alphabet within
their own), payment cards (13 to 19 digits, Luhn), IBANs (mod 97), phone numbers
(international form, whose country code stays, or North American form), social security
numbers, IPv4 addresses, dates (year first, or day and month before the year).  Not
covered: national numbers of other countries, IPv6 addresses, dates with month names,
host names beyond ASCII.

One pass over each row, without a shuffle.  Defined results: a null text stays null
and has no findings; repeated rows get equal results; a value that fails its check
is left alone, after its shorter ends were tried (a phone number prefers its country's
length); a number and a neighbour that are valid as one remain one; where two kinds match at one place the first of KINDS wins; an empty
table gives an empty result.  Only doc_id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re

from pyspark.sql import DataFrame

#: Kinds in order of precedence.
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
ROUNDS = 8
#: For tests and checks; a deployment gives its own secret.
DEMO_KEY = b"not a secret"

_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to the end of 2099

# Each begins with a class of characters, which the search can skip to.
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    "iban": re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z]\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"\d(?<![\d.]\d)(?:[ -]?\d){12,18}(?![\d])"),
    "ssn": re.compile(r"\d(?<![\d-]\d)\d\d-\d\d-\d{4}(?![\d-])"),
    "phone": re.compile(r"(?:\+(?<![\w+]\+)[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\d])|\((?<![\w(]\()\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d(?<![\d.+-]\d)(?:(?<=1)[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\d\d[ .-]\d{3}[ .-]\d{4})(?![\d-]))"),
    "ip": re.compile(r"\d(?<![\d.]\d)\d{0,2}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"),
    "date": re.compile(r"\d(?<![\d./-]\d)(?:\d{3}([-/.])\d{1,2}\1\d{1,2}|\d?([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)"),
}
#: Digits of a number after the country's, for countries with one length.
_PHONE_DIGITS = {"1": 10, "7": 10, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "61": 9, "86": 11, "91": 10}
#: Kinds whose match may take in what stands behind it.
_SHORTER = ("iban", "card", "phone")
#: Country codes of two digits; those of one are 1 and 7, all others have three.
_COUNTRIES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: Letters of other alphabets are exchanged within blocks of so many code points.
_BLOCK = 64


def _country(digits: str) -> str:
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in _COUNTRIES else digits[:3]


def _name_start(text: str, at: int, least: int) -> int:
    """Where the name before an @ begins, at least so far on: letters and digits of any
    alphabet, and ._%+- inside; at itself if there is none."""
    begin = at
    while begin > least and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
        begin -= 1
    if begin < at and text[at - 1] == ".":
        return at
    while begin < at and not text[begin].isalnum():
        begin += 1
    return begin


def _folded(c: str) -> str:
    """A letter without its case, where it has just one other form."""
    return c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c


@functools.cache
def _alphabet(block: int, cased: bool) -> str:
    """The letters and digits of a block that have a capital form, or that have none."""
    chars = [chr(c) for c in range(block, block + _BLOCK) if chr(c).isalnum()]
    return "".join(c for c in chars if c == _folded(c) and (len(c.upper()) == 1 and c.upper() != c and _folded(c.upper()) == c) is cased)


def _letters_like(c: str) -> tuple[str, str]:
    """The characters a letter or digit may become, and the name of that set."""
    if c.isascii():
        return (_ALNUM[:10], "d") if c.isdigit() else (_ALNUM[10:], "l")
    block = ord(c) // _BLOCK * _BLOCK
    cased = len(c.upper()) == 1 and c.upper() != c and _folded(c.upper()) == c
    return _alphabet(block, cased), f"({block:x}{'c' if cased else ''})"


class Feistel:
    """Keyed permutations of range(n), for any n and any domain name."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, name: bytes, k: int, value: int, size: int) -> int:
        text = b"%s:%d:%d" % (name, k, value)
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=16 + (size.bit_length() + 7) // 8).digest(), "big") % size

    def permute(self, value: int, n: int, name: str, back: bool = False) -> int:
        """Another number below n; walks on while the network leads outside."""
        if n < 2:
            return value
        low = 1 << (n - 1).bit_length() // 2
        high = -(-n // low)
        tag = b"%s/%d" % (name.encode(), n)
        while True:
            left, right = divmod(value, low)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if k % 2:
                    right = (right + (-1 if back else 1) * self._round(tag, k, left, low)) % low
                else:
                    left = (left + (-1 if back else 1) * self._round(tag, k, right, high)) % high
            value = left * low + right
            if value < n:
                return value


def luhn_digit(digits: str) -> int:
    """The digit that completes a card number."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(form: str, digits: str) -> str:
    """The digits in the places of a form's digits."""
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in form)


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(_ALNUM.index(c.lower())) for c in rest + country + "00")) % 97


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _digits(self, digits: str, name: str, back: bool) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), name, back)).zfill(len(digits)) if digits else ""

    def _letters(self, text: str, name: str, back: bool) -> str:
        """Letters and digits anew, each keeping its class and case."""
        sets = [_letters_like(_folded(c)) for c in text]
        value, n = 0, 1
        for c, (chars, _) in zip(text, sets):
            value, n = value * len(chars) + chars.index(_folded(c)), n * len(chars)
        value = self.feistel.permute(value, n, name + "/" + "".join(tag for _, tag in sets), back)
        out = []
        for c, (chars, _) in zip(reversed(text), reversed(sets)):
            value, place = divmod(value, len(chars))
            out.append(chars[place].upper() if c != _folded(c) else chars[place])
        return "".join(reversed(out))

    def replace(self, kind: str, found: str, back: bool = False) -> str | None:
        """The pseudonym of a match, or None if it isn't valid."""
        return getattr(self, f"_{kind}")(found, back)

    def _email(self, found: str, back: bool) -> str:
        name, _, host = found.rpartition("@")
        # Capital letters are another spelling of the same address.
        plain = "".join(_folded(c) for c in name if c.isalnum())
        new = iter(self._letters(plain, "email@" + host.lower(), back))
        return "".join((next(new).upper() if c != _folded(c) else next(new)) if c.isalnum() else c for c in name) + "@" + host

    def _card(self, found: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", found)
        if luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        new = self._digits(digits[:-1], "card", back)
        return _refill(found, new + str(luhn_digit(new)))

    def _iban(self, found: str, back: bool) -> str | None:
        text = found.replace(" ", "")
        if not 15 <= len(text) <= 34 or _iban_check(text[:2], text[4:]) != int(text[2:4]):
            return None
        rest = self._letters(text[4:], "iban" + text[:2], back)
        new = iter(f"{text[:2]}{_iban_check(text[:2], rest):02d}{rest}")
        return "".join(c if c == " " else next(new) for c in found)

    def _ssn(self, found: str, back: bool) -> str | None:
        area, group, serial = int(found[:3]), int(found[4:6]), int(found[7:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        value = ((area - (area > 666) - 1) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self.feistel.permute(value, 898 * 99 * 9999, "ssn", back), 9999)
        area, group = divmod(value, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, found: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", found)
        # The country's code stays, and with it what it says about length and form.
        keep = len(_country(digits)) if found[0] == "+" else 1 if len(digits) == 11 else 0
        if not (8 if keep else 7) <= len(digits) <= (15 if keep else 14):
            return None
        national = digits[keep:]
        return _refill(found, digits[:keep] + self._digits(national, "phone" + (digits[:keep] or "1"), back))

    def _ip(self, found: str, back: bool) -> str | None:
        parts = found.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.feistel.permute(value, 1 << 32, "ip", back).to_bytes(4, "big")))

    def _date(self, found: str, back: bool) -> str | None:
        a, sign, b, c = re.fullmatch(r"(\d+)(\D)(\d+)\D(\d+)", found).groups()
        first = len(a) == 4
        year, month, day = (int(a), int(b), int(c)) if first else (int(c), int(b), int(a))
        swapped = not first and month > 12 >= day  # month before day
        if swapped:
            month, day = day, month
        try:
            place = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= place < _DAYS:
            return None
        # Day and month stay recognisable as such: dates that read either way keep to those that do.
        new = datetime.date.fromordinal(self._day(place, swapped, first, back) + _FIRST_DAY)
        if first:
            return f"{new.year:04d}{sign}{new.month:02d}{sign}{new.day:02d}"
        d, m = (new.month, new.day) if swapped else (new.day, new.month)
        return f"{d:02d}{sign}{m:02d}{sign}{new.year:04d}"

    def _day(self, place: int, swapped: bool, first: bool, back: bool) -> int:
        """Permutes days; with the month in front, among the days that show it."""
        while True:
            place = self.feistel.permute(place, _DAYS, "date", back)
            if not swapped or datetime.date.fromordinal(place + _FIRST_DAY).day > 12:
                return place

    def _ends(self, kind: str, text: str, begin: int, end: int):
        """Ends of a match where a number or word ends, the likeliest first, then the longest."""
        ends = [end, *(e for e in range(end - 1, begin, -1) if text[e - 1].isalnum() and not text[e].isalnum() and PATTERNS[kind].fullmatch(text, begin, e))]
        if kind == "phone" and text[begin] == "+":
            def usual(e):
                digits = re.sub(r"\D", "", text[begin:e])
                return any(digits.startswith(c) and len(digits) == len(c) + n for c, n in _PHONE_DIGITS.items())
            ends.sort(key=lambda e: not usual(e))
        return ends

    def _next(self, kind: str, text: str, at: int) -> tuple[int, int, str] | None:
        """The first valid match from a place on: begin, end, kind."""
        while match := PATTERNS[kind].search(text, at):
            begin, end = match.span()
            if kind == "email":
                begin = _name_start(text, match.start(), at)
                if begin < match.start():
                    return begin, end, kind
            elif kind in _SHORTER:
                # Of a match that may be too long the part that is valid.
                for shorter in self._ends(kind, text, begin, end):
                    if self.replace(kind, text[begin:shorter]) is not None:
                        return begin, shorter, kind
            elif self.replace(kind, text[begin:end]) is not None:
                return begin, end, kind
            # Where nothing is valid, one may begin further on.
            at = match.start() + 1
        return None

    def text(self, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and what was replaced (begin, end, kind).

        Of all kinds the one that begins first is taken; the others are looked for
        again behind it, where they reached into it.
        """
        ahead = {kind: self._next(kind, text, 0) for kind in KINDS}
        out, spans, at = [], [], 0
        while found := min((x for x in ahead.values() if x), key=lambda x: (x[0], KINDS.index(x[2])), default=None):
            begin, end, kind = found
            out += [text[at:begin], self.replace(kind, text[begin:end], back)]
            spans.append(found)
            at = end
            for other, x in ahead.items():
                if x and x[0] < at:
                    ahead[other] = self._next(other, text, at)
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with pseudonyms, n_found and spans."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def replace(batches):
        import pyarrow as pa

        names = Pseudonyms(key)
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(1):
                text = text.as_py()
                new, found = (None, []) if text is None else names.text(text)
                texts.append(new)
                spans.append([{"begin": b, "end": e, "kind": k} for b, e, k in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(span))],
                ["doc_id", "text", "n_found", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        replace, f"doc_id {id_type}, text string, n_found bigint, spans array<struct<begin:bigint,end:bigint,kind:string>>"
    )
