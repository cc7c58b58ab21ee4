"""Format-preserving pseudonyms: a keyed Feistel network permutes valid numbers and dates within their format.

Equal values of a kind get equal pseudonyms in every document, so they stay linked; a pseudonym is valid in its kind
again (a card number keeps its check digit right, a date stays a date). Values that don't validate are left alone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_YEAR, LAST_YEAR = 1900, 2099
FIRST_DAY, LAST_DAY = datetime.date(FIRST_YEAR, 1, 1).toordinal(), datetime.date(LAST_YEAR, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A permutation of 0..size-1: a balanced Feistel network over enough bits, walked until it is within the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            seen = left if back else right
            mixed = hashlib.blake2b(seen.to_bytes(width, "big"), key=key, person=bytes([r]), salt=hashlib.blake2b(tweak.encode(), digest_size=16).digest(), digest_size=min(64, width + 8)).digest()
            mixed = int.from_bytes(mixed, "big") & mask
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The digit that makes `digits` with it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _numeral(digits: str, radix: int = 10) -> int:
    return int(digits, radix)


def _refill(shape: str, digits: str, of: str = "0123456789") -> str:
    """The characters of a shape with those of the alphabet replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c in of else c for c in shape)


def _card(s: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", s)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    n, body = len(digits) - 1, digits[:-1]
    while True:  # all zeros would not be a card again
        body = str(permute(_numeral(body), 10**n, key, f"card{n}", back)).zfill(n)
        if body.strip("0"):
            return _refill(s, body + luhn_digit(body))


#: Country calling codes of two digits, fixed values; 1 and 7 are the codes of one digit, all others have three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def calling_code(digits: str) -> int:
    """How many of an international number's digits are its country's."""
    return 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in _TWO_DIGIT_CODES else 3


def _phone(s: str, key: bytes, back: bool) -> str | None:
    """The country's digits stay. A number without `+` is one of country 1, so that both forms are linked."""
    digits = re.sub(r"[^0-9]", "", s)
    country = calling_code(digits) if s[0] == "+" else 0
    own = digits[country:]
    if not 8 <= len(digits) <= 15 or len(own) < 6:
        return None
    n = len(own)
    return _refill(s, digits[:country] + str(permute(_numeral(own), 10**n, key, f"phone{digits[:country] or 1}:{n}", back)).zfill(n))


#: The least octet of one, two and three digits, and how many there are.
_OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _address(s: str, key: bytes, back: bool) -> str | None:
    """Octets keep their numbers of digits."""
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    value, size = 0, 1
    for p in parts:
        least, many = _OCTETS[len(p)]
        value, size = value * many + int(p) - least, size * many
    value = permute(value, size, key, "ipv4" + "".join(str(len(p)) for p in parts), back)
    out = []
    for p in reversed(parts):
        least, many = _OCTETS[len(p)]
        value, at = divmod(value, many)
        out.append(str(least + at))
    return ".".join(reversed(out))


def _social(s: str, key: bytes, back: bool) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = s.replace("-", "")
    if not valid(digits):
        return None
    while True:
        digits = str(permute(int(digits), 10**9, key, "social", back)).zfill(9)
        if valid(digits):
            return _refill(s, digits)


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """All days from the 13th of a month on, in order; the other days are twelve in each month."""
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(d).day > 12]


def _moved_day(day: datetime.date, key: bytes, back: bool) -> datetime.date:
    """The same for all formats. Days up to the 12th stay such days and later ones later, so that a date whose order of day and month shows by its numbers shows it again."""
    if day.day <= 12:
        years = LAST_YEAR - FIRST_YEAR + 1
        at = permute(((day.year - FIRST_YEAR) * 12 + day.month - 1) * 12 + day.day - 1, years * 144, key, "date:12", back)
        return datetime.date(FIRST_YEAR + at // 144, at // 12 % 12 + 1, at % 12 + 1)
    late = _late_days()
    return datetime.date.fromordinal(late[permute(bisect_left(late, day.toordinal()), len(late), key, "date:31", back)])


def _date(s: str, key: bytes, back: bool) -> str | None:
    a, mark, b, _, c = re.split(r"([-./])", s)
    order = "ymd" if len(a) == 4 else "dmy" if mark != "/" or int(a) > 12 else "mdy"
    part = dict(zip(order, map(int, (a, b, c))))
    try:
        day = datetime.date(part["y"], part["m"], part["d"])
    except ValueError:
        return None
    if not FIRST_YEAR <= day.year <= LAST_YEAR:
        return None
    new = _moved_day(day, key, back)
    value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(value[x] for x in order)


def _iban(s: str, key: bytes, back: bool) -> str | None:
    plain = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    digits = "".join(c for c in plain[4:] if c.isdigit())
    moved = str(permute(_numeral(digits or "0"), 10 ** max(1, len(digits)), key, f"iban{plain[:2]}{len(digits)}", back)).zfill(len(digits))
    account = _refill(plain[4:], moved)
    return _refill_any(s, f"{plain[:2]}{98 - number(account + plain[:2] + '00') % 97:02d}{account}")


def _refill_any(shape: str, characters: str) -> str:
    rest = iter(characters)
    return "".join(c if c == " " else next(rest) for c in shape)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz")


def _mail(s: str, key: bytes, back: bool) -> str | None:
    """Digits and ASCII letters of the local part, each within its class; letters keep their case, so that spellings in other cases are linked; the domain and other characters stay."""
    local, _, domain = s.rpartition("@")
    low = [c.lower() if c.isascii() else c for c in local]
    kinds = [next((k for k in _CLASSES if c in k), None) for c in low]
    value, size = 0, 1
    for c, k in zip(low, kinds):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    if size == 1:
        return None
    value = permute(value, size, key, "mail" + "".join("x" if k is None else k[0] for k in kinds), back)
    out = []
    for c, k in zip(reversed(local), reversed(kinds)):
        if k:
            value, at = divmod(value, len(k))
            c = k[at].upper() if c.isupper() else k[at]
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


def _secret(s: str, key: bytes, back: bool) -> str | None:
    if s.isdigit() or s.isalpha():
        return None
    moved = s
    while True:  # digits or letters alone would not be told as a secret again
        moved = f"{permute(int(moved, 16), 16 ** len(s), key, f'hex{len(s)}', back):0{len(s)}{'X' if s.upper() == s else 'x'}}"
        if not (moved.isdigit() or moved.isalpha()):
            return moved


#: Kinds in the order in which they claim a stretch; each pattern is bounded or can't start inside its own match.
KINDS: dict[str, tuple[re.Pattern, Callable[[str, bytes, bool], str | None]]] = {
    "hex": (re.compile(r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)"), _secret),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    "date": (re.compile(r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![\w-]|\.\d)"), _date),
    "ipv4": (re.compile(r"(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\w|\.\d)"), _address),
    "social": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _social),
    "phone": (re.compile(r"(?<![\w+.-])[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}(?![\w-]|\.\d)|(?<![\w+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?|\([0-9]{3}\))(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)"), _phone),
    "card": (re.compile(r"(?<![\w+])[0-9](?:[ -]?[0-9]){12,18}(?![\w])"), _card),
}
_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[\w.+-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?!\w)")


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @, so that long runs of letters are not searched again and again."""
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if local and domain:
            yield at - len(local[0]), domain.end()
        at = text.find("@", at + 1)


def find(text: str) -> list[tuple[int, int, str]]:
    """Candidates (begin, end, kind) that don't overlap, by place; whether they validate is seen when they are permuted."""
    found = [(b, e, "mail") for b, e in _mails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), kind) for kind, (pattern, _) in KINDS.items() for m in pattern.finditer(text)]
    return sorted(found, key=lambda f: f[0])


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The permuted value, or None if it doesn't validate as its kind; `back` undoes it."""
    return (_mail if kind == "mail" else KINDS[kind][1])(value, key, back)


_remembered = lru_cache(maxsize=100_000)(pseudonym)
_PLACE = {kind: k for k, kind in enumerate(["mail", *KINDS])}


def replace_all(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans that were replaced, by their places in the original."""
    taken: list[tuple[int, int, str, str]] = []
    for begin, end, kind in sorted(find(text), key=lambda f: (_PLACE[f[2]], f[0])):
        new = _remembered(kind, text[begin:end], key)
        if new is not None:
            taken.append((begin, end, kind, new))
    out, spans, at = [], [], 0
    for begin, end, kind, new in sorted(taken, key=lambda t: (t[0], _PLACE[t[2]])):
        if begin >= at:
            out += [text[at:begin], new]
            spans.append((begin, end, kind))
            at = end
    return "".join(out) + text[at:], spans


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's `keep` columns with text (pseudonyms in place) and found array<struct<begin,end,kind>> (code points).

    One row for each input row, repeated rows too; a null text stays null, with nothing found. Where candidates
    overlap the first in the text is taken, of those at one place the first kind in the order mail, KINDS. The key
    is 16 to 64 bytes; equal keys give equal pseudonyms in every run.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")
    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                new, found = replace_all(text, key) if text else (text, [])
                texts.append(new)
                spans.append([{"begin": b, "end": e, "kind": k} for b, e, k in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(spans, span_type)], [*(f"k{i}" for i in range(len(keep))), "text", "found"])

    out = inner.mapInArrow(replaced, f"{fields}, text string, found array<struct<begin:int,end:int,kind:string>>")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "found")
