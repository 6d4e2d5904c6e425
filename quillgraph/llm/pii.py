"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their format's checks are permuted, under a secret key,
within that format: a card number becomes another number of its length with a valid
check digit, a date another date written the same way. The permutation is one to
one, so equal values stay equal across documents, and the key's holder can undo it.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgraph.llm.common import bounded_batches, others, quoted

ROUNDS = 8
YEARS = range(1900, 2100)
#: Dates are permuted within a class of months and a class of days, so that any way of writing one
#: keeps its widths, the order in which it reads, and whether its month's name is a short one.
MONTHS = (range(5, 6), (1, 2, 3, 4, 6, 7, 8, 9), range(10, 13))
DAYS = (range(1, 10), range(10, 13), range(13, 32))
NAMES = [x.lower() for x in calendar.month_name], [x.lower() for x in calendar.month_abbr]


class Feistel:
    """A keyed permutation of range(size), for each tweak and size: a balanced
    Feistel network over the next even number of bits, walked until it lands inside."""

    def __init__(self, key: bytes):
        self.key = key

    def run(self, value: int, size: int, tweak: str, backwards: bool = False) -> int:
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        order = range(ROUNDS - 1, -1, -1) if backwards else range(ROUNDS)
        while True:
            left, right = value >> half, value & mask
            for k in order:
                if backwards:
                    left, right = right ^ self.round(k, left, size, tweak, width, mask), left
                else:
                    left, right = right, left ^ self.round(k, right, size, tweak, width, mask)
            value = left << half | right
            if value < size:
                return value

    def round(self, k: int, part: int, size: int, tweak: str, width: int, mask: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{size}|{k}|{part}".encode(), key=self.key, digest_size=min(64, width))
        return int.from_bytes(h.digest(), "big") & mask

    def digits(self, text: str, tweak: str, alphabet: str = "0123456789", backwards: bool = False) -> str:
        value, base = 0, len(alphabet)
        for c in text:
            value = value * base + alphabet.index(c)
        value = self.run(value, base ** len(text), tweak, backwards)
        out = []
        for _ in text:
            value, d = divmod(value, base)
            out.append(alphabet[d])
        return "".join(reversed(out))


def luhn(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refill(shape: str, new: str, kind: Callable[[str], bool] = str.isdigit) -> str:
    """shape with its characters of the kind replaced, in order, by those of new."""
    it = iter(new)
    return "".join(next(it) if kind(c) else c for c in shape)


def only(text: str, kind: Callable[[str], bool] = str.isdigit) -> str:
    return "".join(c for c in text if kind(c))


def card(text: str, f: Feistel, back: bool) -> str | None:
    d = only(text)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn(d[:-1]) != d[-1]:
        return None
    payload = f.digits(d[:-1], "card", backwards=back)
    return refill(text, payload + luhn(payload))


def iban(text: str, f: Feistel, back: bool) -> str | None:
    d = text.replace(" ", "")
    rest = d[4:]

    def number(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s))

    if not 15 <= len(d) <= 34 or number(rest + d[:4]) % 97 != 1:
        return None
    new = refill(rest, f.digits(only(rest), "iban" + d[:2], backwards=back))
    return refill(text, d[:2] + f"{98 - number(new + d[:2] + '00') % 97:02d}" + new, str.isalnum)


def phone(text: str, f: Feistel, back: bool) -> str | None:
    d = only(text)
    code = len(re.match(r"\+?(\d{1,3}(?=[ .(-]))?", text, re.A)[1] or "") if text.startswith("+") else 0
    if not 7 <= len(d) - code or len(d) > 15:
        return None
    return refill(text, d[:code] + f.digits(d[code:], "phone" + d[:code], backwards=back))


def ssn(text: str, f: Feistel, back: bool) -> str | None:
    """Valid: area 001-899 but 666, group 01-99, serial 0001-9999; the permutation stays there."""
    a, g, s = (int(x) for x in text.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and s):
        return None
    value = f.run(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn", back)
    value, s = divmod(value, 9999)
    a, g = divmod(value, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def address(text: str, f: Feistel, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    value = 0
    for x in parts:
        value = value << 8 | int(x)
    value = f.run(value, 1 << 32, "ip", back)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def moved(f: Feistel, year: int, month: int, day: int, back: bool) -> datetime.date | None:
    """The image of a date, the same however the date is written."""
    try:
        datetime.date(year, month, day)
    except ValueError:
        return None
    if year not in YEARS:
        return None
    months = next(m for m in MONTHS if month in m)
    days = next(d for d in DAYS if day in d)
    size = len(YEARS) * len(months) * len(days)
    value = ((year - YEARS[0]) * len(months) + months.index(month)) * len(days) + days.index(day)
    while True:  # past the days that their month does not have
        value = f.run(value, size, f"date{months[0]}-{days[0]}", back)
        rest, d = divmod(value, len(days))
        y, m = divmod(rest, len(months))
        if days[d] <= calendar.monthrange(YEARS[y], months[m])[1]:
            return datetime.date(YEARS[y], months[m], days[d])


def date(text: str, f: Feistel, back: bool) -> str | None:
    """Year first, or year last with the day before the month unless only the other order is a date."""
    a, sep, b, _, c = re.match(r"(\d+)([-/.])(\d+)([-/.])(\d+)$", text, re.A).groups()
    if len(a) == 4:
        new = moved(f, int(a), int(b), int(c), back)
        return new and f"{new.year}{sep}{new.month:0{len(b)}d}{sep}{new.day:0{len(c)}d}"
    if int(b) <= 12:
        new = moved(f, int(c), int(b), int(a), back)
        return new and f"{new.day:0{len(a)}d}{sep}{new.month:0{len(b)}d}{sep}{new.year}"
    new = moved(f, int(c), int(a), int(b), back)
    return new and f"{new.month:0{len(a)}d}{sep}{new.day:0{len(b)}d}{sep}{new.year}"


def spelled_date(text: str, f: Feistel, back: bool) -> str | None:
    """Day before month or month before day, the month by its English name or the three letters of it."""
    name, number = re.search(r"[A-Za-z]+", text)[0], re.search(r"\d{1,2}(?!\d)", text, re.A)[0]
    kind = next(k for k in NAMES if name.lower() in k)
    new = moved(f, int(text[-4:]), kind.index(name.lower()), int(number), back)
    if not new:
        return None
    written = kind[new.month]
    written = written.upper() if name.isupper() else written if name.islower() else written.title()
    day = f"{new.day:0{len(number)}d}"
    parts = {name: written, number: day, text[-4:]: str(new.year)}
    return re.sub(r"[A-Za-z]+|\d+", lambda m: parts[m[0]], text, flags=re.A)


def email(text: str, f: Feistel, back: bool) -> str | None:
    """Letters a-z and digits of the part before @ are permuted; case and marks stay."""
    local, at, host = text.partition("@")
    letters, digits = (lambda c: c.isascii() and c.isalpha()), (lambda c: c.isascii() and c.isdigit())
    new = refill(local, f.digits(only(local, letters).lower(), "mail", "abcdefghijklmnopqrstuvwxyz", back), letters)
    new = refill(new, f.digits(only(local, digits), "mail", backwards=back), digits)
    return "".join(n.upper() if o.isupper() else n for n, o in zip(new, local, strict=True)) + at + host


def secret(text: str, f: Feistel, back: bool) -> str | None:
    """A long hexadecimal value."""
    up = text.upper() == text
    new = f.digits(text.lower(), "hex", "0123456789abcdef", back)
    return new.upper() if up else new


#: The longer names first: a short one begins them.
MONTH = "(?i:" + "|".join([*NAMES[0][1:], *NAMES[1][1:]]) + ")"
#: In this order: what an earlier pattern takes is not seen by a later one. Digits, letters and
#: word characters are ASCII's.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("secret", r"(?<![A-Za-z0-9])(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])", secret),
    ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-])", date),
    ("spelled_date", rf"(?<!\w)(?:\d{{1,2}} {MONTH}|{MONTH} \d{{1,2}},?) \d{{4}}(?!\w)", spelled_date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("card", r"(?<![\d+])(?:\d[ -]?){12,18}\d(?!\d)", card),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", phone),
)
HINT = re.compile(r"[0-9@]")
#: Kinds whose values may stand beside other numbers or capitals that their pattern takes as well, and the runs of characters that they lie in.
BESIDE = {"iban": re.compile(r"[A-Z0-9](?: ?[A-Z0-9])*"), "card": re.compile(r"[0-9](?:[ -]?[0-9])*")}


@functools.lru_cache(1)
def compiled() -> tuple:
    return tuple((name, re.compile(p, re.A), change) for name, p, change in KINDS)


def valid_spans(text: str, start: int, end: int, pattern: re.Pattern, valid: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Values in text[start:end], from left to right: at each start the longest valid
    one that ends with its match or before a space or hyphen in it."""
    spans, at = [], start
    while (m := pattern.search(text, at)) and m.start() < end:
        a = m.start()
        ends = [m.end(), *(i for i in range(m.end() - 1, a, -1) if text[i] in " -" and text[i - 1] not in " -")]
        b = next((b for b in ends if pattern.fullmatch(text, a, b) and valid(text[a:b])), None)
        if b:
            spans.append((a, b))
        at = b or a + 1
    return spans


def replaced_beside(text: str, run: re.Pattern, pattern: re.Pattern, change: Callable[[str], str | None], valid: Callable[[str], bool]) -> list[tuple[int, int, str]]:
    """(start, end, new) of the values in text. The values of a run are changed on
    until the new ones are found at the same places, so the way back finds them too."""
    out = []
    for m in run.finditer(text):
        spans = valid_spans(text, m.start(), m.end(), pattern, valid)
        now = text
        while spans:
            for a, b in spans:
                now = now[:a] + change(now[a:b]) + now[b:]
            if valid_spans(now, m.start(), m.end(), pattern, valid) == spans:
                break
        out += [(a, b, now[a:b]) for a, b in spans]
    return out


def pseudonymised(text: str, f: Feistel, backwards: bool = False) -> tuple[str, list[str]]:
    """text with its validated values replaced, and the kinds of these values."""
    if not HINT.search(text):
        return text, []
    parts: list[tuple[str, bool]] = [(text, False)]
    kinds = []
    for name, pattern, change in compiled():
        out: list[tuple[str, bool]] = []
        for part, done in parts:
            if done or not HINT.search(part):
                out.append((part, done))
                continue
            at = 0
            if name in BESIDE:
                found = replaced_beside(part, BESIDE[name], pattern, lambda v, change=change: change(v, f, backwards), lambda v, change=change: change(v, f, False) is not None) if pattern.search(part) else []
            else:
                found = [(m.start(), m.end(), change(m[0], f, backwards)) for m in pattern.finditer(part)]
            for a, b, new in found:
                if new is None:
                    continue
                kinds.append(name)
                out += [(part[at:a], False), (new, True)]
                at = b
            out.append((part[at:], False))
        parts = out
    return "".join(p for p, _ in parts), kinds


def pseudonymise(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text", backwards: bool = False) -> DataFrame:
    """docs with the personal values in text_col replaced by keyed pseudonyms.

    Adds n_replaced and kinds (one entry for each value, in the order of KINDS);
    they and text_col replace input columns so named, any other column stays. A
    number that fails its check (Luhn, mod 97, octets, calendar) is left as it is, as is
    one in other digits than 0-9; of a card or IBAN beside other numbers or capitals the
    part that passes is replaced. A date has one pseudonym in all its spellings; where
    day and month could change places, the day stands first.
    backwards=True undoes the replacement under the same key. Null texts stay null
    with n_replaced 0; rows, ids and repeated rows are kept as they are. Texts of any
    length are read whole, a batch of them of bounded bytes at a time. One pass, no
    shuffle.
    """
    bounded_batches(docs.sparkSession)
    extra = others(docs, [text_col, "n_replaced", "kinds"])
    rows = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(extra)], quoted(text_col).cast("string").alias("text"))
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in extra), T.StructField(text_col, T.StringType()), T.StructField("n_replaced", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            found = [pseudonymised(t, f, backwards) if t is not None else (None, []) for t in batch[len(extra)].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in range(len(extra))), pa.array([t for t, _ in found], pa.string()), pa.array([len(k) for _, k in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.string()))], schema.names)

    return rows.mapInArrow(run, schema)
