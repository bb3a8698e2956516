"""Format-preserving pseudonyms for personal data.

Validated values (card numbers by their check digit, bank accounts by theirs, phone numbers, social security numbers,
network addresses, calendar dates, mail addresses and quoted access tokens) are numbered within the set of all values
of their format, and the number is permuted under a key by a Feistel network with cycle walking. The result is a value
of the same format; equal values get equal pseudonyms in every document, and the holder of the key can undo it. The
permutation is conjugated with a shift, so that no value stands for itself.

Defined cases: null texts stay null, empty texts empty; values that fail validation, such as 16 digits without a valid
check digit, stay as they are; texts of any length are read whole; repeated rows get equal results; an empty table gives
an empty result; the added column gets a free name if one of that name is there.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0..size-1 for every size and label; no element is mapped to itself."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _feistel(self, label: str, half: int, x: int, rounds: range) -> int:
        left, right = x >> half, x & ((1 << half) - 1)
        backwards = rounds.step < 0
        for r in rounds:
            if backwards:
                left, right = right, left
            seed = f"{label}|{half}|{r}|{right}".encode()
            mixed = int.from_bytes(hashlib.blake2b(seed, key=self.key, digest_size=16).digest()) & ((1 << half) - 1)
            left ^= mixed
            if not backwards:
                left, right = right, left
        return left << half | right

    def _walk(self, label: str, size: int, x: int, rounds: range) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        label = f"{label}|{size}"
        x = self._feistel(label, half, x, rounds)
        while x >= size:
            x = self._feistel(label, half, x, rounds)
        return x

    def _moved(self, label: str, size: int, x: int, by: int) -> int:
        if size < 2:
            return x
        there = self._walk(label, size, x, range(ROUNDS))
        return self._walk(label, size, (there + by) % size, range(ROUNDS - 1, -1, -1))

    def forth(self, label: str, size: int, x: int) -> int:
        return self._moved(label, size, x, 1 if size == 2 else 1 + size // 3)

    def back(self, label: str, size: int, x: int) -> int:
        return self._moved(label, size, x, -1 if size == 2 else -1 - size // 3)


Move = Callable[[str, int, int], int]


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    doubled = [int(d) * (2 if i % 2 == 0 else 1) for i, d in enumerate(reversed(digits))]
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def refilled(text: str, digits: str) -> str:
    """``text`` with its digits replaced one by one."""
    fill = iter(digits)
    return re.sub(r"\d", lambda _: next(fill), text)


def only_digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def mixed_radix(move: Move, label: str, text: str) -> str:
    """Letters stay letters of their case, digits stay digits, everything else stays."""
    alphabets = [next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), "") for c in text]
    size, number = 1, 0
    for c, a in zip(text, alphabets, strict=True):
        if a:
            size, number = size * len(a), number * len(a) + a.index(c)
    shape = "".join({10: "9", 26: a[:1]}.get(len(a), c) for c, a in zip(text, alphabets, strict=True))
    number, out = move(f"{label}|{shape}", size, number), []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            number, at = divmod(number, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _card(move: Move, m: re.Match) -> str | None:
    digits = only_digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = f"{move('card', 10**n, int(digits[:-1])):0{n}d}"
    return refilled(m[0], body + luhn_digit(body))


def _secret(move: Move, m: re.Match) -> str:
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if not m[0].strip(digits):
            moved = move("hex", 16 ** len(m[0]), int(m[0], 16))
            return "".join(digits[moved >> 4 * k & 15] for k in reversed(range(len(m[0]))))
    return mixed_radix(move, "secret", m[0])


def _phone(move: Move, m: re.Match) -> str:
    digits = only_digits(m["number"])
    new = f"{move('phone', 10 ** len(digits), int(digits)):0{len(digits)}d}"
    return m["country"] + refilled(m["number"], new)


def _ssn(move: Move, m: re.Match) -> str | None:
    area, group, serial = (int(m[k]) for k in (1, 2, 3))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    areas = [a for a in range(1, 900) if a != 666]
    number = move("ssn", len(areas) * 99 * 9999, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
    number, serial = divmod(number, 9999)
    area, group = divmod(number, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _address(move: Move, m: re.Match) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, move("ip", 2**32, int.from_bytes(bytes(parts))).to_bytes(4)))


def _account(move: Move, m: re.Match) -> str | None:
    """A bank account number: country, two check digits, the account proper."""
    plain = m[0].replace(" ", "").upper()
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = mixed_radix(move, "account", plain[4:])
    check = 98 - as_number(body + plain[:2] + "00") % 97
    fill = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(fill) for c in m[0])


def _date(order: str) -> Callable[[Move, re.Match], str | None]:
    def moved(move: Move, m: re.Match) -> str | None:
        try:
            day = datetime.date(*(int(m[k]) for k in "ymd"))
        except ValueError:
            return None
        start = datetime.date(day.year // 100 * 100 or 1, 1, 1)  # a date stays in its hundred years
        last = datetime.date(day.year // 100 * 100 + 99, 12, 31)
        new = start + datetime.timedelta(move("date", (last - start).days + 1, (day - start).days))
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return m["s"].join(parts[k] for k in order)

    return moved


#: Digits of a phone number at most, with those of its country.
PHONE_DIGITS = 15
#: A number that is complete as it is written, so that a group after a space is not part of it: three, three and four
#: digits; or two groups behind an area, the last of four digits; or a last part in one piece.
COMPLETE = r"(?:\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(?\d{1,4}(?:(?:\)[ .-]?|[ ])\d{3,4}[ .-]|[.-]\d{3,4}[.-])\d{4}|(?:\(?\d{1,4}\)?[ .-]?)?\d{7,14})(?!\d|[.-]\d)"
#: Any other: two to four groups behind an area; none follows a space once one has followed a point or hyphen.
GROUPS = r"\(?\d{1,4}\)?(?:(?:(?P<tight>[.-])|(?(tight)(?!)|[ ])|)\d{2,4}){2,4}(?!\d)"


class WithCountry:
    """Phone numbers with a country code, of PHONE_DIGITS digits at most; found like the matches of a pattern."""

    def __init__(self, number: str):
        self.pattern = re.compile(rf"(?P<country>(?<!\w)\+(?:1(?=[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\d))|\d{{1,3}})[ .-]?)(?P<number>{number})")

    def finditer(self, text: str, at: int, end: int) -> Iterator[re.Match]:
        while m := self.pattern.search(text, at, end):
            at = m.end()
            while m and len(only_digits(m[0])) > PHONE_DIGITS:  # without its last group
                last = re.search(r"\d+\Z", text[m.start() : m.end()])
                m = self.pattern.match(text, m.start(), m.start() + last.start()) if last else None
            if m:
                at = m.end()
                yield m


#: What stands directly behind the sign or code of a country is a phone before it is anything else.
_COUNTRY = re.compile(r"(?<!\w)\+(?:\d{1,3}[ .-]?)?\Z").search


def _apart(change: Callable[[Move, re.Match], str | None]) -> Callable[[Move, re.Match], str | None]:
    return lambda move, m: None if _COUNTRY(m.string, max(0, m.start() - 5), m.start()) else change(move, m)


_OTHERS: list[tuple[str, re.Pattern, Callable[[Move, re.Match], str | None]]] = [
    ("ssn", re.compile(r"(?<![\d-])(\d{3})-(\d{2})-(\d{4})(?![\d-])"), _ssn),
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"), _address),
    ("date", re.compile(r"(?<![\d-])(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})(?![\d-])"), _date("ymd")),
    ("date", re.compile(r"(?<![\d./])(?P<d>\d{2})(?P<s>[./])(?P<m>\d{2})(?P=s)(?P<y>\d{4})(?![\d/])"), _date("dmy")),
    ("date", re.compile(r"(?<![\d./])(?P<m>\d{2})(?P<s>/)(?P<d>\d{2})/(?P<y>\d{4})(?![\d/])"), _date("mdy")),
]
# Patterns of the formats, tried in this order; each looks only at what those before it have left.
FORMATS: list[tuple[str, re.Pattern | WithCountry, Callable[[Move, re.Match], str | None]]] = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), lambda move, m: mixed_radix(move, "email", m[0])),
    ("secret", re.compile(r"(?i:(?<=token = \")|(?<=token=\")|(?<=key = \")|(?<=key=\"))[0-9A-Za-z_-]{16,}(?=\")"), _secret),
    ("account", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"), _account),
    ("phone", WithCountry(COMPLETE), _phone),
    ("card", re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}(?:(?P=gap)\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"), _card),
    *((kind, pattern, _apart(change)) for kind, pattern, change in _OTHERS),
    ("phone", WithCountry(rf"{COMPLETE}|{GROUPS}"), _phone),
    ("phone", re.compile(r"(?P<country>(?<![\w+]))(?P<number>\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])"), _phone),
    *_OTHERS,
]
_SIGN = re.compile("[0-9@]").search


class Pseudonymiser:
    def __init__(self, key: bytes):
        permutation = Permutation(key)
        self.move = lru_cache(100_000)(permutation.forth)

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and ``(kind, start, length)`` of each in it, in code points."""
        if not text or not _SIGN(text):
            return text, []
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern, change in FORMATS:
            found, at = [], 0
            for start, end in [*((s, e) for s, e, _, _ in taken), (len(text), len(text))]:
                for m in pattern.finditer(text, at, start):
                    new = change(self.move, m)
                    if new is not None:
                        found.append((m.start(), m.end(), kind, new))
                at = end
            taken = sorted(taken + found)
        out, spans, at, size = [], [], 0, 0
        for start, end, kind, new in taken:
            out += [text[at:start], new]
            size += start - at
            spans.append((kind, size, len(new)))
            size, at = size + len(new), end
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and ``out_col``: an array of ``(kind, start, length)``."""

    @F.pandas_udf("text string, spans array<struct<kind: string, start: int, length: int>>")
    def changed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        act = Pseudonymiser(key.encode())
        for texts in batches:
            rows = [act(t) for t in texts]
            spans = [[{"kind": k, "start": s, "length": n} for k, s, n in found] for _, found in rows]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in rows], dtype=object), "spans": pd.Series(spans, dtype=object)})

    made, out_col = free_name(docs, "made"), free_name(docs, out_col)
    return docs.withColumn(made, changed(F.col(text_col))).select(
        *(F.col(made)["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns), F.col(made)["spans"].alias(out_col)
    )
