"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates that pass a check of their kind are permuted by a keyed
Feistel network within all values of the same format: a card number becomes a
card number with a right check digit, a date a date. Equal values become equal
pseudonyms in all documents, different values different ones, and who holds the
key can go back. Nothing is looked up or stored, so documents are worked on
apart from each other.

Kinds: card numbers (check digit), account numbers with a country code (check
digits), telephone numbers, social security numbers, network addresses of both
versions, dates, the local parts of mail addresses, and long hexadecimal
secrets.

What counts as equal: a telephone number is its national number, however it is
spaced and whether or not the country code is written, which stays. A date
keeps its order, its separator and the widths of its day and month (``1/2/2024``
becomes a date of one-digit day and month), so dates are linked within one
format. Of the longer network addresses all spellings are linked; pseudonym and
way back are in the shortest spelling, in the case of the text.

Results for odd input: a null text stays null, an empty one empty; text outside
matches is untouched; repeated rows get equal results; extra columns stay out;
no rows give no rows. Where matches could overlap, the one that begins first
and then the kind named first counts. A match that fails its check is tried in
its shorter lengths, then as the other kinds, and then the search goes on one
character further; the way back from such a place goes by its span.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import map_once

ROUNDS = 10
KINDS = ("mail", "secret", "iban", "card", "phone", "ssn", "address", "date")
_FIRST_DAY, _DAYS = date(1900, 1, 1), 73_049  # dates permuted: 1900 to 2099

PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "secret": r"\b(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)"
    r"|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w.+-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
    r"|(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"
    r"|(?<![\w:.])(?=[0-9a-fA-F:]*\d)[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}::(?:[0-9a-fA-F]{1,4}:){0,6}"
    r"[0-9a-fA-F]{1,4}(?![\w:])",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])"
    r"|(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)",
}
FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
_EACH = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_CARD_LEAST = 13  # digits
_IBAN_LEAST = 15  # signs
# signs of an account number by country
_IBAN_SIGNS = {
    country: int(n)
    for n, countries in re.findall(
        r"(\d+):([A-Z ]+)",
        "15:NO 16:BE 18:DK FI FO GL NL SD 19:MK SI 20:AT BA EE KZ LT LU MN XK 21:CH HR LI LV "
        "22:BG BH CR DE GB GE IE ME RS VA 23:AE GI IL IQ OM SO TL 24:AD CZ DZ ES MD PK RO SA SE SK TN VG "
        "25:LY PT ST 26:IS TR 27:BI DJ FR GR IT MC MR SM 28:AL AZ BY CY DO GT HU LB NI PL SV 29:BR EG PS QA UA "
        "30:JO KW MU YE 31:MT SC 32:LC 33:RU",
    )
    for country in countries.split()
}
# fixed values: country codes of telephone numbers with one and with two digits; all others have three
_CALLING = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48",
    "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84",
    "86", "90", "91", "92", "93", "94", "95", "98",
)
_MAY = re.compile(r"\d|@")


class Permutation:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network, walked until it lands inside."""

    def __init__(self, key: bytes, tweak: str):
        self.key, self.tweak = key, tweak.encode()

    def _round(self, i: int, value: int, modulus: int) -> int:
        message = b"%s|%d|%d|%d" % (self.tweak, modulus, i, value)
        return int.from_bytes(hmac.new(self.key, message, hashlib.sha256).digest(), "big") % modulus

    def _once(self, value: int, side: int, back: bool) -> int:
        left, right = divmod(value, side)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - self._round(i, left, side)) % side, left
            else:
                left, right = right, (left + self._round(i, right, side)) % side
        return left * side + right

    def __call__(self, value: int, size: int, back: bool = False) -> int:
        side = _root(size)
        while True:  # side * side is little more than size, so few turns are needed
            value = self._once(value, side, back)
            if value < size:
                return value


@lru_cache(maxsize=256)
def _root(size: int) -> int:
    low = max(2, int(size**0.5) if size < 2**52 else 1 << ((size.bit_length() + 1) // 2))
    while low * low < size:
        low += 1
    return low


def check_digit(digits: str) -> int:
    """The Luhn digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_rest(account: str, country: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _fill(pattern: str, new: str) -> str:
    """``pattern`` with its letters and digits replaced in turn by those of ``new``."""
    signs = iter(new)
    return "".join(next(signs) if c.isalnum() else c for c in pattern)


def _permute_text(permute: Permutation, text: str, back: bool) -> str:
    """Each digit stays a digit, each letter a letter of its case, other characters stay."""
    bases = [10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 0 for c in text]
    size, value = 1, 0
    for c, base in zip(text, bases):
        if base:
            size, value = size * base, value * base + (int(c) if base == 10 else ord(c.lower()) - 97)
    if size < 2:
        return text
    value, out = permute(value, size, back), []
    for c, base in zip(reversed(text), reversed(bases)):
        if base:
            value, digit = divmod(value, base)
            out.append(str(digit) if base == 10 else chr(digit + (65 if c.isupper() else 97)))
        else:
            out.append(c)
    return "".join(reversed(out))


def _permute_number(permute: Permutation, digits: str, back: bool) -> str:
    return str(permute(int(digits), 10 ** len(digits), back)).zfill(len(digits))


def _permute_date(permute: Permutation, text: str, back: bool) -> str | None:
    parts = re.split(r"([-/.])", text)
    a, sign, b, c = parts[0], parts[1], parts[2], parts[4]
    try:
        if sign == "-":
            day = date(int(a), int(b), int(c))
        elif sign == ".":
            day = date(int(c), int(b), int(a))
        else:  # month first if that is a date, else day first
            day = date(int(c), int(a), int(b)) if int(a) <= 12 else date(int(c), int(b), int(a))
    except ValueError:
        return None
    at = (day - _FIRST_DAY).days
    if not 0 <= at < _DAYS:
        return None
    if sign == "-":
        return (_FIRST_DAY + timedelta(permute(at, _DAYS, back))).isoformat()
    # with slashes, day and month can be told apart only above 12: each reading is permuted within itself
    month_first = sign == "/" and int(a) <= 12
    while True:
        at = permute(at, _DAYS, back)
        new = _FIRST_DAY + timedelta(at)
        pair = (new.month, new.day) if month_first else (new.day, new.month)
        if _has_widths(pair, (len(a), len(b))) and (month_first or sign == "." or new.day > 12):
            return f"{pair[0]:0{len(a)}d}{sign}{pair[1]:0{len(b)}d}{sign}{new.year:04d}"


def _has_widths(pair: tuple[int, int], widths: tuple[int, int]) -> bool:
    """Whether two numbers are written with these widths: zeros are put before both of them or neither."""
    return widths == (2, 2) or all(len(str(v)) == w for v, w in zip(pair, widths))


def _calling_code(digits: str) -> str:
    return next((c for c in _CALLING if digits.startswith(c)), digits[:3])


def replaced(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a match, or the original of a pseudonym; None if the value is not of its kind."""
    permute = Permutation(key, kind)
    if kind in ("mail", "secret"):
        if kind == "mail":
            return _permute_text(permute, text, back)
        base = "0123456789ABCDEF" if text.isupper() else "0123456789abcdef"
        value = permute(int(text, 16), 16 ** len(text), back)
        return "".join(base[(value >> 4 * i) & 15] for i in reversed(range(len(text))))
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        if int(digits[-1]) != check_digit(digits[:-1]):
            return None
        new = _permute_number(permute, digits[:-1], back)
        return _fill(text, new + str(check_digit(new)))
    if kind == "iban":
        plain = text.replace(" ", "")
        if (_iban_rest(plain[4:], plain[:2]) + int(plain[2:4])) % 97 != 1:
            return None
        new = _permute_text(permute, plain[4:], back)
        return _fill(text, f"{plain[:2]}{98 - _iban_rest(new, plain[:2]):02d}{new}")
    if kind == "phone":
        keep = _calling_code(digits) if text[0] == "+" else ""
        rest = digits[len(keep) :]
        return _fill(text, keep + _permute_number(permute, rest, back)) if 6 <= len(rest) else None
    if kind == "ssn":
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        while True:
            digits = _permute_number(permute, digits, back)
            if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
                return _fill(text, digits)
    if kind == "address" and ":" in text:
        try:
            value = int(IPv6Address(text))
        except ValueError:
            return None
        new = str(IPv6Address(Permutation(key, "address6")(value, 2**128, back)))
        return new.upper() if text.upper() == text and re.search("[A-F]", text) else new
    if kind == "address":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        value = permute(int.from_bytes(bytes(parts), "big"), 2**32, back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    return _permute_date(permute, text, back)


def _ends(kind: str, value: str) -> Iterator[int]:
    """The whole match, then where a shorter value of its kind could end: before a sign that is no letter or digit."""
    yield len(value)
    if kind in ("card", "iban"):
        least = _CARD_LEAST if kind == "card" else _IBAN_SIGNS.get(value[:2], _IBAN_LEAST)
        most = _IBAN_SIGNS.get(value[:2], len(value)) if kind == "iban" else len(value)
        for end in range(len(value) - 1, 0, -1):
            if value[end - 1].isalnum() and not value[end].isalnum():
                if least <= sum(c.isalnum() for c in value[:end]) <= most:
                    yield end


def _first_right(text: str, m: re.Match, key: bytes, back: bool) -> tuple[str | None, int, str | None]:
    """(kind, end, new value) of what begins at ``m``: longest first within a kind, then the other kinds."""
    for kind in KINDS[KINDS.index(m.lastgroup) :]:
        match = m if kind == m.lastgroup else _EACH[kind].match(text, m.start())
        if match:
            for end in _ends(kind, match.group()):
                new = replaced(kind, match.group()[:end], key, back)
                if new is not None:
                    return kind, m.start() + end, new
    return None, m.start(), None


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, begin, end) of each in the new text."""
    if not _MAY.search(text):
        return text, []
    out, spans, last, shift, at = [], [], 0, 0, 0
    while m := FIND.search(text, at):
        kind, end, new = _first_right(text, m, key, back)
        if new is None:
            at = m.start() + 1
            continue
        out += [text[last : m.start()], new]
        spans.append((kind, m.start() + shift, m.start() + shift + len(new)))
        shift += len(new) - (end - m.start())
        last = at = end
    return "".join([*out, text[last:]]), spans


def _worker(key: bytes):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, found = [], []
            for text in part.column("text").to_pylist():
                new, spans = (None, []) if text is None else pseudonymise(text, key)
                texts.append(new)
                found.append([{"kind": k, "begin": b, "end": e} for k, b, e in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(texts, pa.string()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array(found, _SPANS),
                ],
                names=["doc_id", "text", "n_replaced", "spans"],
            )

    return batches


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_replaced and spans of every row."""
    if not key:
        raise ValueError("a key is needed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, text string, n_replaced long, spans array<struct<kind: string, begin: long, end: long>>"
    return map_once(rows, _worker(key), schema, "pseudonyms")
