"""Replace personal numbers and dates by pseudonyms of the same format.

Every validated value is permuted by a keyed Feistel network within the set of values of
its kind, so the pseudonym is valid too, equal values get equal pseudonyms in every
document, and nobody without the key can go back. A value outside the wanted set is
permuted again until it falls inside (cycle walking), which keeps it a permutation.

Kinds: payment cards (Luhn), IBANs (mod 97), telephone numbers, dates, IPv4 addresses,
mail addresses (the local part), access keys, and values named as a password, token or key. Separators, letter case and field widths
stay. A number that does not validate as any kind stays as it is: of a card or IBAN that runs
on into further groups the longest valid start counts, and the search goes on within what did
not validate, but takes no part of it for a telephone number unless it is several numbers.

Null texts stay null with 0 replacements.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ADDED = "n_replaced long, replaced array<struct<kind: string, start: int, end: int>>"
KEY = b"lexiflow: replace by a secret of your own"
ROUNDS = 8
# Fixed formats.
PHONE = re.compile(
    r"(?<![\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w]|-\d)", re.VERBOSE | re.ASCII
)
VALUE = re.compile(
    r"""(?P<mail>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)
    |(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|(?:api|access|auth|private)[_-]?key)["']?[ ]?[:=][ ]?["']?)(?P<secret>[A-Za-z0-9_+/.-]{8,})
    |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<date>(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w-]|\.\d))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
    |(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d))
    |(?P<phone>"""
    + PHONE.pattern
    + ")",
    re.VERBOSE | re.ASCII,
)
# Every value holds one of these.
LIKELY = re.compile(r"[0-9@:=]|AKIA|ASIA")
# Digits grouped like those of a card are one number, valid or not.
CARD_GROUPS = re.compile(r"(?<!\d)\d{4}([ -])(?:\d{4}\1\d{4}\1\d{1,4}|\d{6}\1\d{4,5})(?!\d)", re.ASCII)


def permute(value: int, size: int, key: bytes, kind: str, valid: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the valid numbers below size."""
    half = max(1, (max(2, size) - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    tweak = f"{kind}/{size}".encode()
    while True:
        left, right = value >> half, value & mask
        for number in range(ROUNDS):
            data = number.to_bytes(1, "big") + right.to_bytes(half + 7 >> 3, "big") + tweak
            mixed = int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=16).digest(), "big")
            left, right = right, left ^ mixed & mask
        value = left << half | right
        if value < size and valid(value):
            return value


def refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in text)


def luhn_digit(digits: str) -> int:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    body = len(digits) - 1
    first = int(digits[0]) * 10 ** (body - 1)  # the first digit names the scheme
    moved = first + permute(int(digits[1:-1]), 10 ** (body - 1), key, f"card{digits[0]}")
    stem = str(moved).zfill(body)
    return refill(text, stem + str(luhn_digit(stem)))


def _characters(text: str, key: bytes, kind: str) -> str:
    """Permute letters and digits among those of their class; other characters stay."""
    spans = [(ord("0"), 10) if c.isdigit() else (ord("A"), 26) if c.isupper() else (ord("a"), 26) for c in text if c.isalnum()]
    value, size = 0, 1
    for c, (base, n) in zip((c for c in text if c.isalnum()), spans):
        value, size = value * n + ord(c) - base, size * n
    value = permute(value, size, key, kind)
    out = []
    for base, n in reversed(spans):
        value, at = divmod(value, n)
        out.append(chr(base + at))
    given = reversed(out)
    return "".join(next(given) if c.isalnum() else c for c in text)


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != int(plain[2:4]):
        return None
    account = _characters(plain[4:], key, "iban" + plain[:2])
    given = iter(plain[:2] + f"{_iban_check(plain[:2], account):02d}" + account)
    return "".join(c if c == " " else next(given) for c in text)


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(text: str, key: bytes) -> str | None:
    """Dates from 1900 to 2099; a day-first or month-first date stays readable either way."""
    parts = re.split(r"[-/.]", text)
    mark = text[len(parts[0])]
    year_first = len(parts[0]) == 4
    year, middle, last = (parts if year_first else (parts[2], parts[1], parts[0]))
    orders = [(int(middle), int(last))] if year_first or mark == "." else [(int(last), int(middle)), (int(middle), int(last))]
    for month, day in orders:
        try:
            ordinal = datetime.date(int(year), month, day).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= ordinal <= LAST_DAY:
            continue
        wide = len(last) == 2 and len(middle) == 2

        def fits(n: int) -> bool:
            d = datetime.date.fromordinal(n + FIRST_DAY)
            return wide or len(str(d.day)) == len(str(day)) and len(str(d.month)) == len(str(month))

        moved = datetime.date.fromordinal(permute(ordinal - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, f"date{wide}", fits) + FIRST_DAY)
        month_text, day_text = (f"{moved.month:02d}", f"{moved.day:02d}") if wide else (str(moved.month), str(moved.day))
        if year_first:
            return mark.join((str(moved.year), month_text, day_text))
        day_first = (month, day) == (int(middle), int(last))
        return mark.join((day_text, month_text, str(moved.year)) if day_first else (month_text, day_text, str(moved.year)))
    return None


def ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def phone(text: str, key: bytes) -> str | None:
    code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    head = code.group() if code else ""
    rest = text[len(head) :]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 12:
        return None
    american = len(digits) == 10 and head in ("", "+1") and digits[0] > "1" and digits[3] > "1"

    def fits(n: int) -> bool:
        moved = str(n).zfill(len(digits))
        return not american or moved[0] > "1" and moved[3] > "1"

    moved = permute(int(digits), 10 ** len(digits), key, f"phone{american}", fits)
    return head + refill(rest, str(moved).zfill(len(digits)))


def mail(text: str, key: bytes) -> str:
    local, host = text.split("@", 1)
    return _characters(local, key, "mail") + "@" + host


def access_key(text: str, key: bytes) -> str:
    return text[:4] + _characters(text[4:], key, "key")


def secret(text: str, key: bytes) -> str:
    return _characters(text, key, "secret")


REPLACE = {"mail": mail, "key": access_key, "secret": secret, "iban": iban, "date": date, "ip": ip, "card": card, "phone": phone}


def _valid_start(kind: str, found: str, key: bytes) -> tuple[str, int] | None:
    """The replacement of the longest valid start of a card or IBAN, up to a space, and its length."""
    for space in reversed([i for i, c in enumerate(found) if c == " "] if kind in ("card", "iban") else []):
        start = found[:space]
        if kind == "card" and sum(c.isdigit() for c in start) < 13:
            return None
        if (new := REPLACE[kind](start, key)) is not None:
            return new, space
    return None


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and (kind, start, end) of each in the old text."""
    if not LIKELY.search(text):
        return text, []
    out, spans, done = [], [], 0
    at = one_number = 0  # where the search goes on; the end of the last number that did not validate
    while match := VALUE.search(text, at):
        kind = match.lastgroup
        start, end = match.span(kind)
        at = match.start() + 1
        if kind == "phone" and start < one_number:
            continue
        new = REPLACE[kind](match.group(kind), key)
        if new is None:
            if shorter := _valid_start(kind, match.group(kind), key):
                new, end = shorter[0], start + shorter[1]
            elif kind != "card" or CARD_GROUPS.search(match.group(kind)):
                one_number = max(one_number, end)
            elif start >= one_number and (number := PHONE.match(text, start)):
                kind, end = "phone", number.end()
                new = phone(number.group(), key)
        if new is not None:
            out += [text[done:start], new]
            at = done = end
            spans.append((kind, start, end))
    return "".join([*out, text[done:]]), spans


def pseudonymise_texts(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with text replaced, n_replaced, and replaced: kind, start and end in the old text.

    Columns of docs with the names of the two new ones are replaced by them.
    """
    names = [c for c in docs.columns if c not in ("n_replaced", "replaced")]
    at = names.index("text")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else t.decode("utf-8", "replace") for t in batch.column(at).to_pylist()]
            done = [(None, []) if t is None else pseudonymise(t, key) for t in texts]
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for _, x in done]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            columns += [pa.array([len(x) for x in found], pa.int64()), pa.array(found, spans)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_replaced", "replaced"])

    schema = StructType([*docs.select(*names).schema, *StructType.fromDDL(ADDED)])
    return docs.select(*names).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)
