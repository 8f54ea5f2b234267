"""Personal data replaced by format-preserving pseudonyms: a keyed Feistel permutation inside each format."""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
DAY_FROM, DAYS = dt.date(1800, 1, 1).toordinal(), dt.date(2200, 1, 1).toordinal() - dt.date(1800, 1, 1).toordinal()
SHORT_FROM = dt.date(1969, 1, 1).toordinal()  # two-digit years are 1969 to 2068
SHORT_DAYS = dt.date(2069, 1, 1).toordinal() - SHORT_FROM
MONTHS = "January February March April May June July August September October November December".split()


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """Bijection of ``range(size)``: a balanced Feistel network over the next even number of bits, walked into range."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            message = b"%d|%s|" % (i, kind.encode()) + right.to_bytes(width, "big") + size.to_bytes((size.bit_length() + 7) // 8, "big")
            digest = hashlib.blake2b(message, key=key, digest_size=min(64, width + 8)).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = left << half | right
        if value < size:
            return value


_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def permute_text(text: str, key: bytes, kind: str) -> str:
    """``text`` with its letters and digits permuted as one number; each stays in its class, all else in place."""
    sets = [next((c for c in _CLASSES if x in c), None) for x in text]
    value, size = 0, 1
    for x, c in zip(text, sets):
        if c:
            value, size = value * len(c) + c.index(x), size * len(c)
    layout = "".join(str(_CLASSES.index(c)) if c else x for x, c in zip(text, sets))
    value, out = permute(value, size, key, f"{kind}:{layout}"), []
    for x, c in zip(reversed(text), reversed(sets)):
        if c:
            value, at = divmod(value, len(c))
            x = c[at]
        out.append(x)
    return "".join(reversed(out))


def _fill(text: str, digits: str) -> str:
    """``text`` with its digits replaced, separators kept."""
    rest = iter(digits)
    return "".join(next(rest) if "0" <= x <= "9" else x for x in text)


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _luhn(digits: str) -> int:
    """Check digit that completes ``digits``."""
    total = sum(sum(divmod(2 * int(x), 10)) if i % 2 == 0 else int(x) for i, x in enumerate(reversed(digits)))
    return -total % 10


def card(m: re.Match, key: bytes) -> str | None:
    digits = _digits(m[0])
    if not 13 <= len(digits) <= 19 or _luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2  # the first digit names the network and stays
    body = digits[0] + str(permute(int(digits[1:-1]), 10**n, key, f"card{n}")).zfill(n)
    return _fill(m[0], body + str(_luhn(body)))


def ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    at = area - 1 - (area > 666)
    at, serial = divmod(permute((at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(at, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(m: re.Match, key: bytes) -> str | None:
    """North American numbers keep country code; others keep their first two digits."""
    text, digits = m[0], _digits(m[0])
    abroad = text.startswith("+") and not (digits[0] == "1" and len(digits) == 11)
    if abroad:
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 2
        return _fill(text, digits[:2] + str(permute(int(digits[2:]), 10**n, key, f"phone{digits[:2]}:{n}")).zfill(n))
    lead, own = digits[:-10], digits[-10:]
    if len(own) < 10 or lead not in ("", "1") or text.isdigit():
        return None
    if own[0] in "01" or own[3] in "01":  # not assigned; only a country code shows that it is meant as a number
        if not text.startswith("+"):
            return None
        at = int(own)
        while True:  # walked on until it is one of the unassigned again
            at = permute(at, 10**10, key, "phone0")
            new = str(at).zfill(10)
            if new[0] in "01" or new[3] in "01":
                return _fill(text, lead + new)
    at = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
    at, line = divmod(permute(at, 800 * 800 * 10_000, key, "phone1"), 10_000)
    area, exchange = divmod(at, 800)
    return _fill(text, f"{lead}{area + 200}{exchange + 200}{line:04d}")


def ip_address(m: re.Match, key: bytes) -> str | None:
    try:
        address = ipaddress.ip_address(m[0])
    except ValueError:
        return None
    return str(type(address)(permute(int(address), 1 << address.max_prefixlen, key, f"ip{address.version}")))


def _mod97(text: str) -> int:
    return int("".join(str(int(x, 36)) for x in text)) % 97


def iban(m: re.Match, key: bytes) -> str | None:
    compact = m[0].replace(" ", "")
    if not 15 <= len(compact) <= 34 or _mod97(compact[4:] + compact[:4]) != 1:
        return None
    body = permute_text(compact[4:], key, f"iban{compact[:2]}")
    rest = iter(f"{compact[:2]}{98 - _mod97(body + compact[:2] + '00'):02d}{body}")
    return "".join(x if x == " " else next(rest) for x in m[0])


def _day(day: dt.date, key: bytes) -> dt.date | None:
    """The pseudonym of a day. Days that a two-digit year can name stay among themselves, so two digits name the new one too."""
    at, n = day.toordinal(), SHORT_DAYS
    if 0 <= at - SHORT_FROM < n:
        return dt.date.fromordinal(SHORT_FROM + permute(at - SHORT_FROM, n, key, "date2"))
    if not 0 <= at - DAY_FROM < DAYS:
        return None
    at = DAY_FROM + permute(at - DAY_FROM - (n if at >= SHORT_FROM else 0), DAYS - n, key, "date4")
    return dt.date.fromordinal(at + n if at >= SHORT_FROM else at)


def _year(text: str) -> int:
    return int(text) + (0 if len(text) == 4 else 2000 if int(text) < 69 else 1900)


def _as_written(year: int, old: str) -> str:
    return f"{year % 100:02d}" if len(old) == 2 else str(year)


def numeric_date(m: re.Match, key: bytes) -> str | None:
    """``2024-03-05 2024/3/5`` and ``05.03.2024 3/5/24``; with a dot or a first number over 12, day first."""
    first, sep, second, last = m[1], m[2], m[3], m[4]
    year_first = len(first) == 4
    day_first = not year_first and (sep == "." or int(first) > 12)
    y, month, d = (first, second, last) if year_first else (last, second, first) if day_first else (last, first, second)
    try:
        new = _day(dt.date(_year(y), int(month), int(d)), key)
    except ValueError:
        return None
    if new is None:
        return None
    padded = len(month) == len(d) == 2
    year, month, d = _as_written(new.year, y), *(f"{x:02d}" if padded or old[0] == "0" else str(x) for x, old in ((new.month, month), (new.day, d)))
    return sep.join((year, month, d) if year_first else (d, month, year) if day_first else (month, d, year))


def _month(name: str) -> int:
    return next(i for i, x in enumerate(MONTHS, 1) if x[:3].lower() == name[:3].lower())


def written_date(m: re.Match, key: bytes) -> str | None:
    """``March 5, 2024``, ``5 March 2024``, ``Mar. 5th 2024``, ``5-Mar-24`` and the like, kept in their form."""
    month_first = m["m"] is not None
    name, d, suffix, y = (m["m"], m["d"], m["o"], m["y"]) if month_first else (m["m2"], m["d2"], m["o2"], m["y2"])
    digits = y.lstrip("'\u2019")
    try:
        day = dt.date(_year(digits), _month(name), int(d))
    except ValueError:
        return None
    if (new := _day(day, key)) is None:
        return None
    month = MONTHS[new.month - 1]
    if len(name) <= 4 and name.lower() not in ("may", "june", "july") or name.lower() == "may" and (m["s1"] or m["s4"]).startswith("."):
        month = month[:3]
    month = month.upper() if name.isupper() else month.lower() if name.islower() else month
    number = f"{new.day:02d}" if d[0] == "0" else str(new.day)
    if suffix:
        ending = "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        number += ending.upper() if suffix.isupper() else ending
    year = y[: len(y) - len(digits)] + _as_written(new.year, digits)
    return f"{month}{m['s1']}{number}{m['s2']}{year}" if month_first else f"{number}{m['s3']}{month}{m['s4']}{year}"


def email(m: re.Match, key: bytes) -> str | None:
    return permute_text(m[1], key, "email@" + m[2].lower()) + "@" + m[2]


def secret(m: re.Match, key: bytes) -> str | None:
    n = len(m[2])
    if re.fullmatch("[0-9a-f]+", m[2]):
        return m[1] + format(permute(int(m[2], 16), 16**n, key, f"hex{n}"), "x").zfill(n)
    return m[1] + permute_text(m[2], key, "secret")


_NAMES = "|".join([*MONTHS, "Sept", *(x[:3] for x in MONTHS)])
_WRITTEN = rf"""\b(?:
    (?P<m>{_NAMES})(?P<s1>\.?\s{{1,3}}|\.|-)(?P<d>\d{{1,2}})(?P<o>st|nd|rd|th)?(?P<s2>,?\s{{1,3}}|,|-)(?P<y>\d{{4}}|['\u2019]\d{{2}}|(?<=,\s)\d{{2}}(?![:%]|[.,]\d))
  | (?P<d2>\d{{1,2}})(?P<o2>st|nd|rd|th)?(?P<s3>\.?\s{{1,3}}(?:of\s{{1,3}})?|[-/.]?)(?P<m2>{_NAMES})(?P<s4>\.?,?\s{{1,3}}|[-/.,]?)(?P<y2>\d{{4}}|['\u2019]?\d{{2}}(?![:%]|[.,]\d))
)(?!\w)"""
#: kind, a text without it cannot match, pattern, validated replacement; earlier kinds win where spans overlap
KINDS: list[tuple[str, str, re.Pattern, Callable[[re.Match, bytes], str | None]]] = [
    ("secret", "", re.compile(r"(\b(?i:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9+/_.~-]{8,})", re.ASCII), secret),
    ("secret", "AKIA", re.compile(r"\b(AKIA)([0-9A-Z]{16})\b", re.ASCII), secret),
    ("email", "@", re.compile(r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9._%+-]{0,63})@((?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![\w-])", re.ASCII), email),
    ("iban", "", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII), iban),
    ("ip", ":", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])", re.ASCII), ip_address),
    ("ip", ".", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.ASCII), ip_address),
    ("card", "", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", re.ASCII), card),
    ("ssn", "-", re.compile(r"(?<![\d-])(\d{3})-(\d{2})-(\d{4})(?![\d-])", re.ASCII), ssn),
    ("date", "", re.compile(r"(?<![\d./-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![\d/-]|\.\d)", re.ASCII), numeric_date),
    ("date", "", re.compile(r"(?<![\d./-])(\d{1,2})([-./])(\d{1,2})\2(\d{4})(?![\d/-]|\.\d)", re.ASCII), numeric_date),
    ("date", "", re.compile(r"(?<![\w./-])(\d{1,2})([-./])(\d{1,2})\2(\d{2})(?![\w/-]|\.\d)", re.ASCII), numeric_date),
    ("date", "", re.compile(_WRITTEN, re.ASCII | re.IGNORECASE | re.VERBOSE), written_date),
    ("phone", "", re.compile(r"(?<![\w+.-])(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![\w-]|\.\d)", re.ASCII), phone),
    ("phone", "", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])", re.ASCII), phone),
]
_SIGN = re.compile(r"[0-9]|@|(?i:token|secret|password|passwd|key)|::")


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, and the kinds replaced in text order. Null stays null."""
    if not text or not _SIGN.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []  # disjoint and in text order
    for kind, sign, pattern, replace in KINDS:
        if sign not in text:
            continue
        for m in pattern.finditer(text):
            place = bisect.bisect_left(found, m.end(), key=lambda x: x[0])  # of the spans before, the last ends last
            if place and found[place - 1][1] > m.start():
                continue
            if (new := replace(m, key)) is not None:
                found.insert(place, (m.start(), m.end(), kind, new))
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [x[2] for x in found]


def pseudonyms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and ``pii_kinds``, the kinds of the values replaced in text order.

    Card numbers (Luhn), IBANs (mod 97), social security and phone numbers, IP addresses, e-mail addresses, keys and
    dates are replaced by another valid value of the same format. The permutation depends on the key and the kind
    alone, so equal values have equal pseudonyms in all documents, different values different ones, and a date has one
    pseudonym however it is written: numbers of one or two digits, years of two (1969 to 2068) or four, English month
    names and their abbreviations, ordinals; the written form is kept. Numbers that fail validation stay. Work is row by row, nothing is shuffled. Null
    texts stay null, an existing ``pii_kinds`` column is replaced.
    """
    secret_key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
    def replaced(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pseudonymise(x, secret_key) for x in texts], columns=["text", "kinds"])

    done = docs.withColumn("__pii", replaced(F.col(text_col)))
    return done.withColumns({text_col: F.col("__pii.text"), "pii_kinds": F.col("__pii.kinds")}).drop("__pii")
