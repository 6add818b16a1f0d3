"""Personal data as format-preserving pseudonyms.

Addresses, numbers and dates are found by their form and validated (check digits,
ranges, calendar). A valid one is replaced by another of the same form: a keyed Feistel
network permutes the numbers of its kind, so equal values get equal pseudonyms in all
documents, different ones differ, and who holds the key can go back. Signs, spaces and
letter case of the original stay. Time goes with the length of the texts, also where an
address is very long.

* null and empty texts come back as empty, with no span
* every row is treated whole, repeated rows each and alike
* invalid numbers and dates are left as they are; where two forms overlap, the one that
  starts first is taken, then the longer one
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import math
import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.llm.common import map_texts

ROUNDS = 10
KINDS = ("email", "card", "iban", "phone", "ssn", "ip", "date")
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = {c: _DIGITS for c in _DIGITS} | {c: _LOWER for c in _LOWER + _LOWER.upper()}
#: What a worker remembers of values and forms; both come again and again.
VALUES, KEYED = 1 << 16, 1 << 12


@lru_cache(KEYED)
def _halves(size: int, key: bytes, kind: str) -> tuple[int, int, hashlib.blake2b]:
    """The sizes of the halves, and the hash that each turn goes on from."""
    left_size = math.isqrt(size - 1) + 1
    if size <= sys.float_info.max:
        # the root as a float may be larger; pseudonyms stay as they were made with it
        left_size = max(left_size, int(size**0.5))
    return left_size, -(-size // left_size), hashlib.blake2b(f"{kind}:{size}:".encode(), key=key, digest_size=16)


@lru_cache(VALUES)
def permuted(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """Where a keyed permutation of 0 .. size - 1 takes ``value``; ``back`` undoes it.

    A Feistel network over pairs of two nearly equal halves; a result beyond the range
    is permuted again until it is within.
    """
    if size < 2:
        return value
    left_size, right_size, keyed = _halves(size, key, kind)

    def turn(k: int, half: int, most: int) -> int:
        digest = keyed.copy()
        digest.update(b"%d:%d" % (k, half))
        return int.from_bytes(digest.digest()) % most

    while True:
        left, right = divmod(value, right_size)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * turn(k, left, right_size)) % right_size
            else:
                left = (left + sign * turn(k, right, left_size)) % left_size
        value = left * right_size + right
        if value < size:
            return value


def _permuted_places(values: list[int], sizes: list[int], key: bytes, kind: str, back: bool) -> list[int]:
    """The same for many small numbers at once, each below its size: the halves are those of the list."""
    half = len(values) // 2
    parts = [np.array(values[:half]), np.array(values[half:])]
    mosts = [np.array(sizes[:half]), np.array(sizes[half:])]
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = k % 2
        seed = hashlib.blake2b(f"{kind}:{k}:".encode() + parts[1 - side].astype("u1").tobytes(), key=key).digest()
        stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * len(parts[side])), "<u4").astype("i8")
        parts[side] = (parts[side] + (-stream if back else stream)) % mosts[side]
    return [*parts[0].tolist(), *parts[1].tolist()]


def permuted_text(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """Letters become letters of the same case, digits digits; all else stays.

    A text is one number; one of too many letters for a float, 218 and more, is a list of small ones.
    """
    places = [(i, a) for i, c in enumerate(text) if (a := _ALPHABETS.get(c))]
    # values of another form are other values, also if there are as many of them
    form = "".join("9" if a is _DIGITS else "a" for _, a in places)
    values = [a.index(text[i].lower()) for i, a in places]
    size = math.prod(len(a) for _, a in places[:sys.float_info.max_10_exp + 1])
    if size > sys.float_info.max:
        values = _permuted_places(values, [len(a) for _, a in places], key, f"{kind}:{form}", back)
    else:
        value = 0
        for (_, a), rest in zip(places, values, strict=True):
            value = value * len(a) + rest
        value = permuted(value, size, key, f"{kind}:{form}", back)
        for k in reversed(range(len(places))):
            value, values[k] = divmod(value, len(places[k][1]))
    out = list(text)
    for (i, a), rest in zip(places, values, strict=True):
        out[i] = a[rest].upper() if text[i].isupper() else a[rest]
    return "".join(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _placed(text: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in _DIGITS else c for c in text)


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 - k % 2)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _email(m: re.Match, key: bytes, back: bool) -> str | None:
    head, dot, top = m.group().rpartition(".")
    return permuted_text(head, key, "email", back) + dot + top


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = _digits(m.group())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = permuted_text(digits[:-1], key, "card", back)
    return _placed(m.group(), body + luhn_digit(body))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    plain = re.sub(r"[ ]", "", m.group())
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = permuted_text(plain[4:], key, "iban" + plain[:2], back)
    made = iter(plain[:2] + f"{98 - _mod97(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(made) for c in m.group())


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    text = m.group()
    if not 7 <= len(_digits(text)) <= 15:
        return None
    start = len(re.match(r"\+\d{1,3}(?=\D)|", text).group())  # the country stays
    digits = permuted_text(_digits(text[start:]), key, "phone" + _digits(text[:start]), back)
    return text[:start] + _placed(text[start:], digits)


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = 898  # 1 to 899 without 666
    place = area - 1 - (area > 666)
    value = permuted((place * 99 + group - 1) * 9999 + serial - 1, areas * 99 * 9999, key, "ssn", back)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = m.group().split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    value = permuted(int.from_bytes(bytes(map(int, parts))), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4)))


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = re.split(r"([-/.])", m.group())
    a, b, c = (int(parts[k]) for k in (0, 2, 4))
    year_first = len(parts[0]) == 4
    # the day stands before the month unless only the other order is a date
    orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        year, month, day = ((a, b, c)[k] for k in order)
        if FIRST_DAY.year <= year <= LAST_DAY.year and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]:
            break
    else:
        return None
    days = (LAST_DAY - FIRST_DAY).days + 1
    ambiguous = not year_first and orders.index(order) == 1
    value = (dt.date(year, month, day) - FIRST_DAY).days
    while True:
        value = permuted(value, days, key, "date", back)
        new = FIRST_DAY + dt.timedelta(days=value)
        # a pseudonym must be read in the same order as the original
        if not ambiguous or new.day > 12:
            break
    fields = {order[0]: new.year, order[1]: new.month, order[2]: new.day}
    widths = [len(parts[0]), len(parts[2]), len(parts[4])]
    texts = [f"{fields[k]:0{widths[k]}d}" for k in range(3)]
    return texts[0] + parts[1] + texts[1] + parts[3] + texts[2]


# The forms that are looked for. What may not stand before them is asked
# after their first sign, as a search passes over all other signs fast.
FORMS: dict[str, tuple[str, Callable]] = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}", _email),
    "card": (r"\d(?<![\d-]\d)(?<!\d\.\d)(?:\d{12,18}|\d{3}(?:[ -]\d{4}){3}|\d{3}[ -]\d{6}[ -]\d{5})(?![\d-])", _card),
    "iban": (r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "phone": (r"[+(\d](?<![\w+.-][+(\d])(?:(?<=\+)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?<=\()\d{3}\) ?\d{3}[ .-]\d{4}|(?<=\d)\d{2}[.-]\d{3}[.-]\d{4})(?![\d-])", _phone),
    "ssn": (r"\d(?<![\d-]\d)\d{2}-\d{2}-\d{4}(?![\d-])", _ssn),
    "ip": (r"\d(?<![\d.]\d)\d{0,2}(?:\.\d{1,3}){3}(?!\.?\d)", _ip),
    "date": (r"\d(?<![\d./-]\d)(?:\d{3}-\d{1,2}-\d{1,2}|\d?/\d{1,2}/\d{4}|\d?\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)", _date),
}
_FORMS = {kind: (re.compile(regex, re.ASCII), make) for kind, (regex, make) in FORMS.items()}
#: A text without any of these has no value.
_HINTS = "@" + _DIGITS


_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())


def _addresses(regex: re.Pattern, text: str) -> Iterator[re.Match]:
    """The matches of an address, looked for from each ``@``: a long run of letters is read once."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = regex.match(text, start) if start < at else None
        if m:
            end = m.end()
            yield m
        at = text.find("@", at + 1)


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and kind, start and end of each in the original."""
    if not any(sign in text for sign in _HINTS):
        return text, []
    found = []
    for order, (kind, (regex, make)) in enumerate(_FORMS.items()):
        if kind == "email" and "@" not in text:
            continue
        for m in (_addresses(regex, text) if kind == "email" else regex.finditer(text)):
            new = make(m, key, back)
            if new is not None:
                found.append((m.start(), -m.end(), order, kind, new))
    out, at, spans = [], 0, []
    for start, end, _, kind, new in sorted(found):
        if start >= at:
            out += [text[at:start], new]
            at = -end
            spans.append((kind, start, at))
    return "".join([*out, text[at:]]), spans


def protect(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, its ``text`` with pseudonyms, ``n_values``, ``spans``."""

    def run(texts: list[str]) -> dict[str, list]:
        done = [pseudonymised(t, key) for t in texts]
        return {
            "text": [t for t, _ in done],
            "n_values": [len(s) for _, s in done],
            "spans": [",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in done],
        }

    return map_texts(docs.select(*keep, F.col("text").alias("_text")), "_text", "text string, n_values bigint, spans string", run)
