"""Format-preserving Feistel pseudonyms for personal data.

A value that passes its format's check is permuted within that format by a keyed
Feistel network over its characters, digit for digit and letter for letter. The
permutation depends on key, format and length only, so equal values stay equal
in all documents, different ones stay different, and the key restores them.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstwell.llm.shared import texts_of
from karstwell.llm.words import bounded, raw_bytes, slices

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Feistel:
    """Keyed permutations of mixed-radix numbers; each half in turn is shifted by a keyed hash of the other."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back

    def permute(self, value: int, left: int, right: int, tweak: str) -> int:
        """Of 0 <= value < left * right."""
        a, b = divmod(value, right)
        for i in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            other = b if i % 2 == 0 else a
            shift = int.from_bytes(hashlib.blake2b(f"{tweak}:{left}:{right}:{i}:{other}".encode(), key=self.key, digest_size=32).digest(), "big")
            shift = -shift if self.back else shift
            if i % 2 == 0:
                a = (a + shift) % left
            else:
                b = (b + shift) % right
        return a * right + b

    def number(self, value: int, size: int, tweak: str) -> int:
        """Of 0 <= value < size: walks on until the result is in range again."""
        left = max(1, int(size**0.5))
        right = -(-size // left)
        while True:
            value = self.permute(value, left, right, tweak)
            if value < size:
                return value

    def symbols(self, text: str, tweak: str) -> str:
        """Digits to digits, small letters to small letters, capitals to capitals; other characters stay."""
        kinds = ["0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else "" for c in text]
        at = [i for i, k in enumerate(kinds) if k]
        if not at:
            return text
        sizes = [1, 1]
        value = 0
        for n, i in enumerate(at):
            sizes[n >= (len(at) + 1) // 2] *= len(kinds[i])
            value = value * len(kinds[i]) + kinds[i].index(text[i])
        value = self.permute(value, sizes[0], sizes[1], tweak + "".join(k[0] for k in kinds if k))
        out = list(text)
        for i in reversed(at):
            value, digit = divmod(value, len(kinds[i]))
            out[i] = kinds[i][digit]
        return "".join(out)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit for ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(text: str, f: Feistel) -> str | None:
    d = _digits(text)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = f.symbols(d[:-1], "card")
    if len(set(body)) == 1:  # would not be taken for a number again
        body = f.symbols(body, "card")
    return _fill(text, body + str(luhn(body)))


def _phone(text: str, f: Feistel) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    code = 0 if not text.startswith("+") else 1 if d[0] in "17" else 2
    return _fill(text, d[:code] + f.symbols(d[code:], "phone"))


def _social(text: str, f: Feistel) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = _digits(text)
    if not valid(d):
        return None
    while not valid(d := f.symbols(d, "social")):
        pass
    return _fill(text, d)


def _address(text: str, f: Feistel) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = f.number(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country) + '00') % 97:02d}"


def _iban(text: str, f: Feistel) -> str | None:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(body) <= 30 or _iban_check(country, body) != check:
        return None
    body = f.symbols(body, "iban" + country)
    rest = iter(country + _iban_check(country, body) + body)
    return "".join(c if c == " " else next(rest) for c in text)


def _date(order: str) -> Callable[[str, Feistel], str | None]:
    """Dates written in ``order`` (of y, m, d), permuted among the dates that are written in as many characters.

    Month-first dates are those that day-first can't be (a day over 12), and
    stay so; a date of one form never becomes one of another.
    """

    def run(text: str, f: Feistel) -> str | None:
        groups, marks = re.split(r"[-/.]", text), re.findall(r"[-/.]", text)
        value = {k: int(g) for k, g in zip(order, groups, strict=True)}
        width = {k: len(g) for k, g in zip(order, groups, strict=True)}
        if not (FIRST_DAY.year <= value["y"] <= LAST_DAY.year and 1 <= value["m"] <= 12):
            return None
        if not 1 <= value["d"] <= calendar.monthrange(value["y"], value["m"])[1]:
            return None

        def fits(day: datetime.date) -> bool:
            return all(n < 10 or width[k] == 2 for k, n in (("m", day.month), ("d", day.day))) and (order != "mdy" or day.day > 12)

        day = datetime.date(value["y"], value["m"], value["d"])
        if not fits(day):
            return None
        while True:  # walks on until the result can be written so
            day = FIRST_DAY + datetime.timedelta(f.number((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "date"))
            if fits(day):
                break
        out = [f"{n:0{width[k]}d}" for k, n in ((k, {"y": day.year, "m": day.month, "d": day.day}[k]) for k in order)]
        return out[0] + marks[0] + out[1] + marks[1] + out[2]

    return run


def _email(text: str, f: Feistel) -> str | None:
    local, _, domain = text.partition("@")
    return f.symbols(local, "email") + "@" + domain


def _credential(text: str, f: Feistel) -> str | None:
    if text.startswith("AKIA"):
        return "AKIA" + f.symbols(text[4:], "credential")
    at = re.search(r"[0-9A-Za-z]+\W*$", text).start()
    return text[:at] + f.symbols(text[at:], "credential")


#: Formats in the order in which they are tried; what one has taken is not seen by the next. Digits are ASCII digits.
FORMATS: tuple[tuple[str, re.Pattern, Callable[[str, Feistel], str | None]], ...] = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    ("credential", re.compile(
        r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api_key)[ \t]*[=:][ \t]*\"?[0-9a-zA-Z]{12,}\b"), _credential),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)\b"), _iban),
    ("card", re.compile(
        r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"), _card),
    ("date", re.compile(r"(?<![0-9./-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9/-])"), _date("ymd")),
    ("date", re.compile(r"(?<![0-9./-])[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?![0-9/-])"), _date("dmy")),
    ("date", re.compile(r"(?<![0-9./-])[0-9]{1,2}([-/])[0-9]{2}\1[0-9]{4}(?![0-9/-])"), _date("mdy")),
    ("social", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _social),
    ("ipv4", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _address),
    ("phone", re.compile(
        r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}(?![0-9])"
        r"|(?<![0-9(+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])"), _phone),
)


#: What every value of every format has.
_TRIGGER = re.compile(r"[0-9@=:]|AKIA")
_WORTH = np.zeros(256, bool)
_WORTH[list(b"0123456789@=:")] = True


def _in_line(text: str, begin: int, end: int, f: Feistel) -> list[tuple[int, int, str, str]]:
    found: list[tuple[int, int, str, str]] = []
    line = text[begin:end]
    for kind, pattern, change in FORMATS:
        if kind == "email" and "@" not in line:
            continue
        new, starts = [], [x[0] for x in found]
        for m in pattern.finditer(line):
            a, b = begin + m.start(), begin + m.end()
            at = bisect_right(starts, a)  # what is found lies in order and apart
            if (not at or found[at - 1][1] <= a) and (at == len(found) or found[at][0] >= b) and (to := change(m[0], f)) is not None:
                new.append((a, b, kind, to))
        found = sorted(found + new)
    return found


def replace_private(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and length of each in the text it had before."""
    found: list[tuple[int, int, str, str]] = []
    at = 0
    while (m := _TRIGGER.search(text, at)) is not None:  # no format spans lines
        begin, at = text.rfind("\n", at, m.start()) + 1 or at, text.find("\n", m.end())
        at = len(text) if at < 0 else at
        found += _in_line(text, begin, at, f)
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, to in found:
        out += [text[at:a], to]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b - a) for a, b, kind, _ in found]


def pseudonymise(documents: DataFrame, *, key: str, restore: bool = False) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format.

    ``documents``: doc_id, text and any other columns (ignored). Formats: card
    numbers (Luhn), IBANs (mod 97), social security numbers, phone numbers, IPv4
    addresses, dates from 1900 to 2099 (year first, day first, or month first
    where that is the only reading; one or two digits), e-mail names, and
    credentials (``password=``, ``token=`` and the like, access key ids). Digits
    are ASCII digits. Numbers that fail their check stay. ``restore`` undoes it
    with the same key.

    Returns doc_id, text, n_private, private (array of kind, start, length in
    the characters of the text before).

    Null text: null and 0. Text without such data is unchanged. Null doc_id and
    repeated rows are rows like any other; equal texts give equal results. An
    empty table gives an empty result. Very long texts and lines are scanned
    whole, in time about linear in their length.
    """

    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key.encode(), restore)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for part, text in slices(batch):
                data, off = raw_bytes(text)
                some = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_WORTH[data], out=some[1:])
                worth = (np.diff(some[off]) > 0) | pc.match_substring(text, "AKIA").to_numpy(zero_copy_only=False)
                texts = part.column("text").to_pylist()
                spans: list = [[]] * len(texts)
                for i in np.flatnonzero(worth):
                    texts[i], own = replace_private(texts[i], f)
                    spans[i] = [{"kind": k, "start": a, "length": n} for k, a, n in own]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], ["doc_id", "text", "n_private", "private"])

    texts = texts_of(documents)
    return texts.mapInArrow(run, "doc_id long, text string, n_private long, private array<struct<kind:string,start:bigint,length:bigint>>")
