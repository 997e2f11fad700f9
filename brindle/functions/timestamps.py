"""Timestamps of many spellings to one UTC instant.

Each value is reduced to a mask of character classes (digits, month names, weekday names, zone letters and so on).
Every distinct mask is compiled to a parser once; as all values of one mask have the same width, a parser reads its
fields as columns of a two-dimensional character array. Wall-clock times without zone are converted through a table of
the zone's transitions, which is built once per zone and version of the zone data. The version that the driver has is part
of the column: a worker with another one fails instead of giving other instants.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timezone
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English month and weekday names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# Hours east of UTC of common zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
    "AEST": 10, "AEDT": 11, "ACST": 9.5, "ACDT": 10.5, "AWST": 8, "NZST": 12, "NZDT": 13, "JST": 9, "KST": 9, "IST": 5.5,
}

MISSING = np.iinfo(np.int64).min
_DAY = 86_400
_FIRST, _LAST = -2_208_988_800, 4_102_444_800  # 1900-01-01 to 2100-01-01: span of the transition tables
_COMMENT = re.compile(r" ?\([^()]*\)$")
_DASHES = re.compile("[\u2010-\u2015\u2212]")
#: Characters from which on a mask is compiled without being kept.
LONG = 100
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Za-z]+")
_DIGITS = str.maketrans("0123456789", "9" * 10)
_NAMES = {w[:n]: "M" for w in MONTHS for n in (3, len(w))} | {"sept": "M"} | {w[:n]: "W" for w in WEEKDAYS for n in (3, len(w))} | {"tues": "W", "thur": "W", "thurs": "W"}
_MONTH_OF = {w[:3]: i + 1 for i, w in enumerate(MONTHS)}


@lru_cache(maxsize=256)
def _zone_table(zone: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(wall-clock second at which each new offset starts to count, offsets) of an IANA zone in a version of the zone data.

    The offset before a change holds until the later of the two readings of the change: so a repeated hour gets its
    earlier instant, and a skipped time the offset before the change.
    """
    from zoneinfo import ZoneInfo

    if version != zone_data_version():
        raise RuntimeError(f"zone data {zone_data_version()} here, {version} asked for")
    try:
        info = ZoneInfo(zone)
    except Exception:
        return None

    def offset(t: int) -> int:
        return int(datetime.fromtimestamp(t, timezone.utc).astimezone(info).utcoffset().total_seconds())

    at, offsets = [], [offset(_FIRST)]
    step = 5 * _DAY
    for low in range(_FIRST, _LAST, step):
        a, b = offset(low), offset(low + step)
        if a == b:
            continue
        lo, hi = low, low + step
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if offset(mid) == a else (lo, mid)
        at.append(hi + max(a, b))
        offsets.append(b)
    return np.array(at, np.int64), np.array(offsets, np.int64)


@lru_cache(maxsize=1)
def zone_data_version() -> str:
    """Version of the zone data that the transition tables are built from."""
    import zoneinfo

    for folder in zoneinfo.TZPATH:
        listing = Path(folder, "tzdata.zi")
        if listing.exists():
            with listing.open() as f:
                return f.readline().replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def wall_to_utc(seconds: np.ndarray, zone: str, version: str | None = None) -> np.ndarray:
    """Wall-clock seconds of a zone to UTC seconds; ``MISSING`` if there is no such zone. Times before 1900 take the offset
    of that year, times after 2099 that of its end. Another ``version`` of the zone data than the present one is an error."""
    found = _zone_table(zone, version or zone_data_version())
    if found is None:
        return np.full(len(seconds), MISSING)
    starts, offsets = found
    return seconds - offsets[np.searchsorted(starts, seconds, side="right")]


def shape(value: str) -> str:
    """Mask of a value, as long as the value: 9 digit, M month, W weekday, P half of day, T, Z, G zone name, E exponent, a other letters."""

    def kind(m: re.Match) -> str:
        word = m.group()
        low = word.lower()
        if low in _NAMES:
            return _NAMES[low] * len(word)
        if low in ("am", "pm"):
            return "PP"
        if word in ("T", "Z", "E", "e"):
            return word.upper()
        return ("G" if word.upper() in ABBREVIATIONS else "a") * len(word)

    return _WORDS.sub(kind, value).translate(_DIGITS)


_DATE = (
    r"(?:W+\.?,? ?)?(?:(?P<y1>9999)[-/.](?P<m1>99?)[-/.](?P<d1>99?)|(?P<c>99999999)(?=T|$)"
    r"|(?P<p>99?)[-/.](?P<q>99?)[-/.](?P<y2>9999|99)|(?P<d3>99?)\.?[ -](?P<m3>M+)\.?,?[ -](?P<y3>9999|99)|(?P<m4>M+)\.? (?P<d4>99?),? (?P<y4>9999))"
)
_TIME = r"(?:(?P<H>99?):(?P<I>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?|(?P<ct>999999|9999)(?:[.,](?P<cf>9+))?)(?: ?(?P<half>PP))?"
_ZONE = r"(?: ?(?P<z>Z|G+))?(?: ?(?P<sign>[+-])(?P<oh>99?):?(?P<om>99)?)?(?: ?(?P<ab>a{2,5}))?(?:\[[^\]]*\])?(?: \([^)]*\))?"
_MOMENT = re.compile(_DATE + r"(?:T|,? (?:aa )?)" + _TIME + _ZONE)
_NUMBER = re.compile(r"[+-]?9+(?:\.9*)?(?:E[+-]?9+)?")


@lru_cache(maxsize=4096)
def _parser(mask: str) -> dict[str, tuple[int, int]] | str | None:
    """The parser of a mask: places of the fields, ``"number"`` for epoch counts, or None for no instant."""
    if _NUMBER.fullmatch(mask):
        return "number"
    m = _MOMENT.fullmatch(mask)
    return {k: m.span(k) for k in m.groupdict() if m.group(k) is not None} if m else None


def _epoch(values: list[str]) -> np.ndarray:
    """Epoch counts to microseconds. The unit follows from the magnitude; digits are cut, not rounded."""
    out = np.full(len(values), MISSING)
    for i, v in enumerate(values):
        if v.isdigit() and len(v) < 19:
            n, fraction = int(v), None
        else:
            from decimal import Decimal

            fraction = Decimal(v)
            if abs(fraction) >= 10**19:
                continue
            n = int(fraction)
        size = abs(n)
        if fraction is None:
            us = n * 1_000_000 if size < 10**11 else n * 1000 if size < 10**14 else n if size < 10**17 else n // 1000
        else:
            per = 1_000_000 if size < 10**11 else 1000 if size < 10**14 else 1
            us = (fraction * per).__floor__() if size < 10**17 else (fraction / 1000).__floor__()
        if us:
            out[i] = us
    return out


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of dates, and which of them exist."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    ok &= d <= after - first
    return first + d - 1, ok


def _moments(values: list[str], fields: dict[str, tuple[int, int]], zones: np.ndarray, orders: np.ndarray, version: str | None) -> np.ndarray:
    """Values of one mask to microseconds."""
    width = len(values[0])
    chars = np.array(values, dtype=f"U{width}").view(np.uint32).reshape(len(values), width)

    def number(name: str, default: int = 0) -> np.ndarray:
        if name not in fields:
            return np.full(len(values), default, np.int64)
        a, b = fields[name]
        return (chars[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    def text(name: str) -> list[str]:
        a, b = fields[name]
        return [v[a:b] for v in values]

    if "c" in fields:
        whole = number("c")
        y, m, d = whole // 10_000, whole // 100 % 100, whole % 100
    elif "p" in fields:
        y, first, second = number("y2"), number("p"), number("q")
        month_first = (orders == "mdy") & (first <= 12) | (second > 12)
        m, d = np.where(month_first, first, second), np.where(month_first, second, first)
    elif "m1" in fields:
        y, m, d = number("y1"), number("m1"), number("d1")
    else:
        k = "3" if "m3" in fields else "4"
        y, d = number("y" + k), number("d" + k)
        m = np.array([_MONTH_OF[t[:3].lower()] for t in text("m" + k)], np.int64)
    y = np.where(y < 100, y + 2000, y)
    if "ct" in fields:
        whole, long = number("ct"), fields["ct"][1] - fields["ct"][0] == 6
        hour, minute, second = (whole // 10_000, whole // 100 % 100, whole % 100) if long else (whole // 100, whole % 100, whole * 0)
    else:
        hour, minute, second = number("H"), number("I"), number("S")
    days, ok = _days(y, m, d)
    if "half" in fields:
        late = np.array([t[0] in "pP" for t in text("half")])
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * late
    ok &= (hour < 24) & (minute < 60) & (second <= 60)
    wall = days * _DAY + hour * 3600 + minute * 60 + second
    part = "f" if "f" in fields else "cf"
    micro = np.zeros(len(values), np.int64)
    if part in fields:
        a, b = fields[part]
        fields = {**fields, part: (a, min(b, a + 6))}
        micro = number(part) * 10 ** (6 - min(6, b - a))

    if "sign" in fields:
        a, b = fields["oh"]
        east = number("oh") * 3600 + number("om") * 60
        utc = wall - np.where(chars[:, fields["sign"][0]] == ord("-"), -1, 1) * east
        ok &= east <= 18 * 3600
    elif "z" in fields:
        utc = wall - np.array([ABBREVIATIONS[t.upper()] * 3600 for t in text("z")]).astype(np.int64)
    elif "ab" in fields:
        return np.full(len(values), MISSING)
    else:
        utc = np.full(len(values), MISSING)
        for zone in set(zones[ok]):
            if zone:
                own = zones == zone
                utc[own] = wall_to_utc(wall[own], zone, version)
        ok &= utc != MISSING
    return np.where(ok, utc * 1_000_000 + micro, MISSING)


def plain(value: str) -> str:
    """A value without outer and repeated white space and a closing comment in brackets. Spaces, dashes and
    characters of other widths become those of ASCII, invisible ones go; digits of other scripts are left."""
    if not value.isascii():
        value = _DASHES.sub("-", unicodedata.normalize("NFKC", value))
        value = "".join(c for c in value if unicodedata.category(c) != "Cf")
    return _COMMENT.sub("", _SPACES.sub(" ", value).strip())


def to_utc_us(values: list[str | None], zones: list[str | None], orders: list[str | None], version: str | None = None) -> np.ndarray:
    """Microseconds since 1970 UTC of each value, ``MISSING`` where it denotes no instant.

    Null, empty and blank values, words such as "pending", dates without time, times that don't exist, unknown zone
    names and zero counts give ``MISSING``; so do values without zone where the row's zone is null or unknown. Values may be
    of any length; see ``plain``. ``version``: that of the zone data, if a certain one is asked for.
    """
    out = np.full(len(values), MISSING)
    groups: dict[str, list[int]] = {}
    clean: list[str] = []
    for i, v in enumerate(values):
        v = plain(v) if v else ""
        clean.append(v)
        if v:
            groups.setdefault(shape(v), []).append(i)
    zone_of, order_of = np.array([z or "" for z in zones], object), np.array([(o or "").lower() for o in orders], object)
    for mask, rows in groups.items():
        parser = _parser(mask) if len(mask) <= LONG else _parser.__wrapped__(mask)
        if parser is None:
            continue
        own = [clean[i] for i in rows]
        out[rows] = _epoch(own) if parser == "number" else _moments(own, parser, zone_of[rows], order_of[rows], version)
    return out


def utc_us(value: Column | str, zone: Column | str, date_order: Column | str) -> Column:
    """Column form of ``to_utc_us``, with the version of the driver's zone data; null where a value denotes no instant."""
    version = zone_data_version()

    @F.pandas_udf(T.LongType())
    def run(value: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
        text = lambda s: [x if isinstance(x, str) else None for x in s]
        us = to_utc_us(text(value), text(zone), text(order), version)
        return pd.Series(us, dtype="Int64").mask(us == MISSING)

    return run(value, zone, date_order)
