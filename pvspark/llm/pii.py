"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Numbers that pass their check (Luhn, IBAN's mod 97, octets, calendar, digits of a phone number) and
e-mail addresses are mapped, within their own format, to other valid values. The map is a permutation
that depends on the key and the format alone, so equal values have equal pseudonyms in every document
and task, nothing has to be stored or exchanged, and the holder of the key can invert it.

Where a match fails its check, its shorter beginnings, the other kinds and the later starts are tried.
A text and its pseudonym must then be read alike, or the map could not be inverted: a value that would
make its neighbourhood read otherwise is permuted again. Each such step permutes the values that one
place can hold while all other places stay, so the steps, inverted from the last to the first, restore
the text.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

ROUNDS = 10
KINDS = ("email", "iban", "date", "phone", "card", "ip", "ssn")


class Permutation:
    """Keyed permutation of 0 .. size - 1: an alternating Feistel network on two digits, walked into range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.a = 1 << ((max(size - 1, 1).bit_length() + 1) // 2)
        self.b = -(-size // self.a)
        self.key = hashlib.blake2b(tweak.encode(), key=key[:64], digest_size=32).digest()

    def _f(self, k: int, x: int) -> int:
        h = hashlib.blake2b(x.to_bytes(40, "big") + bytes([k]), key=self.key, digest_size=32)
        return int.from_bytes(h.digest(), "big")

    def _step(self, x: int, backward: bool) -> int:
        hi, lo = divmod(x, self.a)
        for k in reversed(range(ROUNDS)) if backward else range(ROUNDS):
            sign = -1 if backward else 1
            if k % 2:
                hi = (hi + sign * self._f(k, lo)) % self.b
            else:
                lo = (lo + sign * self._f(k, hi)) % self.a
        return hi * self.a + lo

    def apply(self, x: int, backward: bool = False) -> int:
        while (x := self._step(x, backward)) >= self.size:
            pass
        return x


@functools.lru_cache(maxsize=4096)
def _permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


def _mixed(key: bytes, tweak: str, values: list[int], radices: list[int], backward: bool) -> list[int]:
    """Permute a number written with the given radices."""
    rank, size = 0, 1
    for v, r in zip(values, radices, strict=True):
        rank, size = rank * r + v, size * r
    rank = _permutation(key, f"{tweak}:{','.join(map(str, radices))}", size).apply(rank, backward)
    out = []
    for r in reversed(radices):
        rank, v = divmod(rank, r)
        out.append(v)
    return out[::-1]


def _digits(key: bytes, tweak: str, text: str, backward: bool, first: int = 0) -> str:
    """Permute a digit string; its first digit stays at or above ``first``."""
    values = [int(c) for c in text]
    radices = [10] * len(values)
    values[0], radices[0] = values[0] - first, 10 - first
    out = _mixed(key, tweak, values, radices, backward)
    out[0] += first
    return "".join(map(str, out))


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order, all else kept."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(key: bytes | None, s: str, backward: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or d[0] == "0":
        return None
    if key is None:
        return s
    # The sum with an odd number of digits behind stays too: longer runs around a card pass or fail as before.
    new, odd = d, luhn_digit(d)
    while True:
        body = _digits(key, "card", new[:-1], backward, first=1)
        new = body + luhn_digit(body)
        if luhn_digit(new) == odd:
            return _refill(s, new)


def _ssn(key: bytes | None, s: str, backward: bool) -> str | None:
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if not 0 < a < 900 or a == 666 or not g or not n:
        return None
    if key is None:
        return s
    a, g, n = _mixed(key, "ssn", [a - 1 - (a > 666), g - 1, n - 1], [898, 99, 9999], backward)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


def _phone(key: bytes | None, s: str, backward: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if s.startswith("+1") and len(d) != 11 or s.startswith("+") and not 8 <= len(d) <= 15:
        return None
    if key is None:
        return s
    if s.startswith("+1"):  # country code 1: ten digits follow, whatever the separators
        return _refill(s, "1" + _digits(key, "phone1", d[1:], backward))
    if s.startswith("+"):  # keeps the two digits that name the country
        return _refill(s, d[:2] + _digits(key, "phone" + d[:2], d[2:], backward))
    return _refill(s, _digits(key, "phone1", d, backward))


def _ip(key: bytes | None, s: str, backward: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    if key is None:
        return s
    least = [(0, 10, 100)[len(p) - 1] for p in parts]
    radix = [(10, 90, 156)[len(p) - 1] for p in parts]
    out = _mixed(key, "ip", [int(p) - m for p, m in zip(parts, least, strict=True)], radix, backward)
    return ".".join(str(v + m) for v, m in zip(out, least, strict=True))


_DAY0, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(key: bytes | None, s: str, backward: bool) -> str | None:
    sep = re.search(r"\D", s)[0]
    parts = s.split(sep)
    if len(parts[0]) == 4:
        orders = ((0, 1, 2),)
    else:  # month first behind slashes, else day first; the other order where that is no date
        orders = ((2, 0, 1), (2, 1, 0)) if sep == "/" else ((2, 1, 0), (2, 0, 1))
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
            break
        except ValueError:
            continue
    else:
        return None
    n = (day - _DAY0).days
    if not 0 <= n < _DAYS:
        return None
    if key is None:
        return s
    while True:  # days that tell the order apart stay such days
        n = _permutation(key, "date", _DAYS).apply(n, backward)
        new = _DAY0 + datetime.timedelta(n)
        if (new.day > 12) == (day.day > 12):
            break
    value = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
    return sep.join(value[i] for i in range(3))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _iban(key: bytes | None, s: str, backward: bool) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1 or not 2 <= int(plain[2:4]) <= 98:
        return None
    if key is None:
        return s
    radix = [10 if c.isdigit() else 26 for c in plain[4:]]
    values = [int(c) if c.isdigit() else ord(c) - 65 for c in plain[4:]]
    out = _mixed(key, "iban" + plain[:2], values, radix, backward)
    body = "".join(str(v) if r == 10 else chr(65 + v) for v, r in zip(out, radix, strict=True))
    new = iter(f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def _email(key: bytes | None, s: str, backward: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    values, radix = [], []
    for c in local:
        if c.isdigit() or c.isalpha():
            base, r = (48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26)
            values.append(ord(c) - base)
            radix.append(r)
    if not values:
        return None
    if key is None:
        return s
    out = iter(_mixed(key, "email@" + domain.lower(), values, radix, backward))
    return "".join((chr(next(out) + (48 if c.isdigit() else 65 if c.isupper() else 97)) if c.isalnum() else c)
                   for c in local) + "@" + domain


# Each gives None where the value fails its check, and the value itself without a key.
_PERMUTE: dict[str, Callable[[bytes | None, str, bool], str | None]] = {
    "email": _email, "iban": _iban, "date": _date, "phone": _phone, "card": _card, "ip": _ip, "ssn": _ssn}

_BODY = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "date": r"[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{2}(?P<s2>[-/.])[0-9]{2}(?P=s2)[0-9]{4}",
    "phone": r"\+[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}(?P<s3>[-.])[0-9]{3}(?P=s3)[0-9]{4}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,18}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# What may not stand before and behind; a card may stand among other digits with hyphens.
_EDGES = dict.fromkeys(KINDS, (r"(?<![\w.+-])", r"(?![\w-]|\.[0-9])")) | {
    "email": (r"(?<![A-Za-z0-9._%+-])", r"(?![A-Za-z0-9-])"), "iban": (r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"),
    "card": (r"(?:(?<![\w.+-])|(?<=[0-9]-))", r"(?!\w|-(?![0-9])|\.[0-9])")}
_WHOLE = {k: f"{_EDGES[k][0]}(?P<{k}>{_BODY[k]}){_EDGES[k][1]}" for k in KINDS}
_PATTERN = re.compile("|".join(_WHOLE[k] for k in KINDS), re.ASCII)
_AT = {k: re.compile(_WHOLE[k], re.ASCII) for k in KINDS}
_ONLY = {k: re.compile(_BODY[k], re.ASCII) for k in KINDS}
_MAYBE = re.compile(r"[0-9@]")
# Code points that a value with a check has at most, and that any value has at most.
_NUMBER, _LONGEST = 64, 640


def _value_at(text: str, start: int, kinds: tuple[str, ...]) -> tuple[str, int, int] | None:
    """The value that starts here: of the first kind, as long as possible."""
    for kind in kinds:
        m = _AT[kind].match(text, start)
        if m is None:
            continue
        check = _PERMUTE[kind]
        if check(None, m[0], False) is not None:
            return kind, start, m.end()
        if kind in ("iban", "phone", "card"):
            for end in range(m.end() - 1, start, -1):
                if (text[end - 1].isalnum() and not text[end].isalnum() and _ONLY[kind].fullmatch(text, start, end)
                        and check(None, text[start:end], False) is not None):
                    return kind, start, end
    return None


def _values(text: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the values in a text, from a position outside of them onwards."""
    while m := _PATTERN.search(text, at):
        first = next(i for i, k in enumerate(KINDS) if m[k] is not None)
        found = _value_at(text, m.start(), KINDS[first:])
        if found is None:
            at = m.start() + 1
        else:
            yield found
            at = found[2]


def pseudonymize(text: str, key: bytes, backward: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal data permuted (or, ``backward``, restored), and the count of each kind."""
    found: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, found
    values = list(_values(text))
    if not values:
        return text, found
    out = list(text)
    for i in reversed(range(len(values))) if backward else range(len(values)):
        kind, start, end = values[i]
        found[kind] = found.get(kind, 0) + 1
        # Read again from where no value that reaches this one can start.
        since, first = max(0, start - _NUMBER), i
        while first and values[first - 1][2] > since:
            first -= 1
            since = min(since, values[first][1])
        low = max(0, since - 2)  # what stands before counts
        left, right = "".join(out[low:start]), "".join(out[end:end + _LONGEST])
        want = [(k, a - low, b - low) for k, a, b in values[first:i + 1]]
        new = text[start:end]
        while True:
            new = _PERMUTE[kind](key, new, backward)
            if list(itertools.islice(_values(left + new + right, since - low), len(want))) == want:
                break
        out[start:end] = new
    return "".join(out), found


def _over_texts(documents: DataFrame, text_col: str, key: bytes, backward: bool, count: bool) -> DataFrame:
    fields = [f for f in documents.schema if not (count and f.name in {f"n_{k}" for k in KINDS})]
    rows = documents.select(*(F.col(f"`{f.name}`") for f in fields))
    counts = [f"n_{k}" for k in KINDS] if count else []
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = [], []
            for t in b.column(at).to_pylist():
                new, n = (None, {}) if t is None else pseudonymize(t, key, backward)
                texts.append(new)
                found.append(n)
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            cols += [pa.array([n.get(k[2:], 0) for n in found], pa.int64()) for k in counts]
            yield pa.record_batch(cols, names=[*b.schema.names, *counts])

    return rows.mapInArrow(run, StructType([*rows.schema, *(StructField(c, LongType()) for c in counts)]))


def pseudonymize_documents(documents: DataFrame, key: bytes, text_col: str = "text", count: bool = True) -> DataFrame:
    """``documents`` with personal data in ``text_col`` replaced by its pseudonyms.

    All columns stay; with ``count``, one column n_<kind> for each of KINDS follows (a column of that
    name in the input gives way). A null text stays null, an empty one empty; values that fail their
    check and all other text stay as they are. Equal values, written with any separators, have equal
    digits in every document, except where the numbers beside one would be read otherwise then. Every row
    stays, repeated ones with equal results; an empty table gives an empty result. ``key`` is the secret of
    the permutation: 1 to 64 bytes.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    return _over_texts(documents, text_col, key, False, count)


def restore_documents(documents: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Inverse of ``pseudonymize_documents`` for the holder of the key."""
    return _over_texts(documents, text_col, key, True, False)
