"""Format-preserving pseudonyms: validated numbers and dates are keyed-permuted within their format.

Each kind of value has a pattern, a validity check and a format: a mixed-radix domain that a Feistel
network with keyed BLAKE2 rounds permutes.  The result has the same format and passes the same check
(card check digit, date in the calendar, address in its block), and equal values get
equal pseudonyms in every document, so links stay.  The permutation can be undone with the key.

Kinds: e-mail addresses (letters and digits permute, the top-level domain stays), North American and
other international phone numbers, payment cards (Luhn), 13 to 19-digit numbers that fail it, social
security numbers, IBANs (mod 97), IPv4 addresses, ISO and slash dates, and secrets (``AKIA`` keys,
hexadecimal tokens after ``token``/``password``/``secret``/``key`` in any case and ``=`` or ``:``, with
or without blanks and quotes).

Null texts stay null, texts without matches are unchanged, other columns pass through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

ROUNDS = 10


def _round(key: bytes, tweak: bytes, r: int, value: int, size: int) -> int:
    data = b"%d|%d|%d|" % (r, value, size) + tweak
    return int.from_bytes(hashlib.blake2b(data, digest_size=16, key=key).digest(), "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes, undo: bool = False) -> int:
    """A keyed permutation of ``range(size)``: Feistel on two near-square halves, walking until inside."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a = a * 2 if a * a * 4 <= size else a + max(1, a // 16)
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        if undo:
            for r in range(ROUNDS - 1, -1, -1):
                if r % 2:
                    right = (right - _round(key, tweak, r, left, b)) % b
                else:
                    left = (left - _round(key, tweak, r, right, a)) % a
        else:
            for r in range(ROUNDS):
                if r % 2:
                    right = (right + _round(key, tweak, r, left, b)) % b
                else:
                    left = (left + _round(key, tweak, r, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def _symbols(text: str, key: bytes, tweak: bytes, undo: bool, classes: tuple[str, ...]) -> str:
    """Permutes the characters of ``text`` that lie in one of the classes, each within its class."""
    kinds = [next((c for c in classes if ch in c), "") for ch in text]
    value = size = 0
    size = 1
    for ch, c in zip(text, kinds, strict=True):
        if c:
            value, size = value * len(c) + c.index(ch), size * len(c)
    if size < 2:
        return text
    shape = "".join(ch if not c else "\\0" + str(classes.index(c)) for ch, c in zip(text, kinds, strict=True))
    value = permute(value, size, key, tweak + shape.encode("utf-8", "replace"), undo)
    out = []
    for ch, c in zip(reversed(text), reversed(kinds), strict=True):
        if c:
            value, at = divmod(value, len(c))
            ch = c[at]
        out.append(ch)
    return "".join(reversed(out))


DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _fill(shape: str, digits: str) -> str:
    """``digits`` put where ``shape`` has digits."""
    it = iter(digits)
    return "".join(next(it) if ch.isdigit() else ch for ch in shape)


def card(text: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    valid = luhn(digits)
    # the issuer's first digit stays; the last makes the check hold, or fail as it failed
    body, n = digits[1:-1], len(digits) - 2
    new = digits[0] + str(permute(int(body), 10**n, key, b"card%d%d" % (n, valid), undo)).zfill(n)
    check = next(c for c in DIGITS if luhn(new + c))
    if not valid:
        was = int(next(c for c in DIGITS if luhn(digits[:-1] + c)))
        check = str((int(check) + int(digits[-1]) - was) % 10)
    return _fill(text, new + check)


def phone(text: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    national = digits[-10:]
    area, line = national[:3], national[3:]
    # area and exchange keep a first digit of 2-9 where they had one
    free = lambda s: (8 if s[0] in "23456789" else 2) * 100
    base = lambda s: 200 if s[0] in "23456789" else 0
    sizes, bases = (free(area), free(line), 10_000), (base(area), base(line), 0)
    parts = [int(area), int(line[:3]), int(line[3:])]
    value = 0
    for p, s, b in zip(parts, sizes, bases, strict=True):
        value = value * s + p - b
    value = permute(value, sizes[0] * sizes[1] * sizes[2], key, b"phone%d%d" % sizes[:2], undo)
    out = []
    for s, b, w in zip(reversed(sizes), reversed(bases), (4, 3, 3), strict=True):
        value, p = divmod(value, s)
        out.append(str(p + b).zfill(w))
    return _fill(text, digits[:-10] + "".join(reversed(out)))


def ssn(text: str, key: bytes, undo: bool) -> str | None:
    a, g, s = text.split("-")
    if a in ("000", "666") or a[0] == "9" or g == "00" or s == "0000":
        return None
    area = int(a) - 1 - (int(a) > 666)
    value = permute((area * 99 + int(g) - 1) * 9999 + int(s) - 1, 898 * 99 * 9999, key, b"ssn", undo)
    value, s_ = divmod(value, 9999)
    area, g_ = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{g_ + 1:02d}-{s_ + 1:04d}"


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def _mod97(text: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in text)) % 97


def _iban_end(text: str) -> int:
    """The last end of a word up to which ``text`` passes the check, or 0: words that follow may look like groups."""
    for end in [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] == " ")]:
        flat = text[:end].replace(" ", "")
        if _IBAN.fullmatch(text, 0, end) and _mod97(flat[4:] + flat[:4]) == 1:
            return end
    return 0


def iban(text: str, key: bytes, undo: bool) -> str | None:
    """The pseudonym of as much of ``text`` as passes the check."""
    end = _iban_end(text)
    if not end:
        return None
    new = text[:end]
    while True:
        flat = new.replace(" ", "")
        body = _symbols(flat[4:], key, b"iban" + flat[:2].encode(), undo, (DIGITS, UPPER))
        it = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
        new = "".join(ch if ch == " " else next(it) for ch in new)
        if _iban_end(new + text[end:]) == end:  # walks until it is read to the same end, that it can be undone
            return new


def ipv4(text: str, key: bytes, undo: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    first = [x for x in range(1, 224) if x not in (10, 127)]
    low = (parts[1] * 256 + parts[2]) * 256 + parts[3]
    if parts[0] in first:
        value = permute(first.index(parts[0]) << 24 | low, len(first) << 24, key, b"ipv4", undo)
        head = first[value >> 24]
    else:  # a reserved block stays that block
        head = parts[0]
        value = permute(low, 1 << 24, key, b"ipv4-%d" % head, undo)
    return f"{head}.{value >> 16 & 255}.{value >> 8 & 255}.{value & 255}"


def world_phone(text: str, key: bytes, undo: bool) -> str | None:
    """The country's first two digits stay."""
    at = [i for i, ch in enumerate(text) if ch.isdigit()][2]
    return text[:at] + _symbols(text[at:], key, b"world" + text[:at].encode(), undo, (DIGITS,))


#: Dates permute among the days of these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _day(y: int, m: int, d: int, key: bytes, undo: bool) -> datetime.date | None:
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    return datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date", undo))


def iso_date(text: str, key: bytes, undo: bool) -> str | None:
    sep = text[4]
    new = _day(int(text[:4]), int(text[5:7]), int(text[8:]), key, undo)
    return new and f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"


@cache
def _late_days() -> list[int]:
    """The days after a month's twelfth."""
    return [n for n in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(n).day > 12]


def day_first_date(text: str, key: bytes, undo: bool) -> str | None:
    sep = text[2]
    a, b, y = int(text[:2]), int(text[3:5]), int(text[6:])
    # read as month/day where that is a date, else as day/month; permuting within the twelfths keeps the reading
    month_first = sep == "/" and a <= 12
    new = _day(y, a, b, key, undo) if month_first else _day(y, b, a, key, undo)
    if new is None:
        return None
    if sep == "/" and not month_first:  # day/month with a day over 12 stays so, that it is read alike
        late = _late_days()
        at = bisect_left(late, datetime.date(y, b, a).toordinal())
        new = datetime.date.fromordinal(late[permute(at, len(late), key, b"late date", undo)])
    m, d = new.month, new.day
    return f"{m:02d}{sep}{d:02d}{sep}{new.year:04d}" if month_first else f"{d:02d}{sep}{m:02d}{sep}{new.year:04d}"


def email(text: str, key: bytes, undo: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    host, dot, top = domain.rpartition(".")
    return _symbols(local, key, b"email", undo, (DIGITS, LOWER, UPPER)) + "@" + _symbols(host, key, b"host", undo, (DIGITS, LOWER, UPPER)) + dot + top


def secret_hex(text: str, key: bytes, undo: bool) -> str | None:
    classes = (HEX,) if text == text.lower() else (DIGITS, HEX[10:], HEX[10:].upper())
    return "".join(_symbols(text[i : i + 64], key, b"hex", undo, classes) for i in range(0, len(text), 64))


def access_key(text: str, key: bytes, undo: bool) -> str | None:
    return text[:4] + _symbols(text[4:], key, b"akia", undo, (DIGITS + UPPER,))


Kind = tuple[str, str, Callable[[str, bytes, bool], "str | None"]]
#: Name, pattern, pseudonym (None: not valid, left as it is).  The first that matches at a place wins.
KINDS: tuple[Kind, ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])", email),
    ("access_key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", access_key),
    ("iban", _IBAN.pattern, iban),
    ("date", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})(?![\d/-])", iso_date),
    ("date", r"(?<![\d/.-])(?:\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])", day_first_date),
    ("phone", r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", phone),
    ("phone", r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?){2,6}(?![\w])", world_phone),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("ipv4", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", ipv4),
    ("card", r"(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\w-])", card),
)
_ALL = re.compile("|".join(f"(?P<k{i}>{pattern})" for i, (_, pattern, _) in enumerate(KINDS)))
#: Every match has a digit, an address sign or ``AKIA``; what comes before the first of them has no white space in it.
#: A run of hexadecimal digits after ``=`` or ``:`` is a secret if a word for one comes before.
_HINT = re.compile(r"[0-9@A:=](?:(?<=[0-9@])[0-9@]*|(?<=A)KIA|(?<=[:=])[:=]*>?\s*\\?[\"'`]?(?P<hex>[0-9A-Fa-f]{16,})(?![0-9A-Za-z]))")
_SECRET = re.compile(r"(?i:password|secret|token|key)[\"'`\]\\]{0,4}\Z")
_EMAIL = re.compile(KINDS[0][1])


def _named_secret(text: str, at: int) -> bool:
    """Whether a word for a secret comes before ``at``."""
    while at and text[at - 1].isspace():
        at -= 1
    return _SECRET.search(text, max(0, at - 12), at) is not None


def pseudonymize_text(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans ``(start, end, kind)`` replaced, in the old text."""
    out, last, spans = [], 0, []
    for hint in _HINT.finditer(text):
        at, end = hint.span("hex" if hint["hex"] else 0)
        if end <= last:
            continue
        if hint["hex"] and at >= last and _named_secret(text, hint.start()) and not _EMAIL.match(text, at):
            out += [text[last:at], secret_hex(hint["hex"], key, undo)]
            last = end
            spans.append((at, end, "secret"))
            continue
        first = at
        while first > last and at - first < 70 and not text[first - 1].isspace():
            first -= 1
        for place in range(max(first, last), end):
            m = _ALL.match(text, place)
            if m:
                name, _, f = KINDS[int(m.lastgroup[1:])]
                new = f(m[0], key, undo)
                if new is not None:
                    out += [text[last:place], new]
                    last = place + len(new) if name == "iban" else m.end()
                    spans.append((place, last, name))
                    break
    return "".join([*out, text[last:]]) if spans else text, spans


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = None, undo: bool = False) -> DataFrame:
    """Replaces ``text_col``; ``spans_col`` adds ``array<struct<start,end,kind>>`` of what was found, in characters of the old text."""
    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).schema
    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if spans_col:
        out = out.drop(spans_col)
        schema = out.withColumn(spans_col, F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind")))).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            at = batch.schema.get_field_index(text_col)
            done = [(None, []) if t is None else pseudonymize_text(t, key, undo) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([d[0] for d in done], pa.string())
            names = list(batch.schema.names)
            if spans_col:
                columns.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in d[1]] for d in done], kind))
                names.append(spans_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(common.tidy(run), schema)
