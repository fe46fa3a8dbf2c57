"""Readings of a time text: every valid interpretation, with its UTC instant."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EAT": 180, "CAT": 120, "WAT": 60, "SAST": 120, "IST": 330, "NPT": 345, "PKT": 300,
    "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780, "CHAST": 765, "CHADT": 825, "NST": -210, "NDT": -150,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
}
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}

_EPOCH = dt.datetime(1970, 1, 1)
_NUMBER = re.compile(r"([+-]?\d+)(?:[.,](\d+))?$")
_BRACKET = re.compile(r"\s*\[([A-Za-z0-9_+\-/]+)\]$")
_OFFSET = re.compile(r"\s*(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?$", re.I)
_NAME = re.compile(r"(?<=[\d\sM.])\s*([A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+|[A-Za-z]{1,5})$", re.I)
_HALF = re.compile(r"\s*([AP])\.?M\.?$", re.I)
_CLOCK = re.compile(r"(?:[T\s,]+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?$", re.I)
_CLOCK_TIGHT = re.compile(r"(?<=\d)(?:T|\s+)(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,12}))?)?$", re.I)
_ISO = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$")
_TIGHT = re.compile(r"(\d{4})(\d{2})(\d{2})$")
_NUMERIC = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$")
_DAY_MONTH = re.compile(r"(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})[\s\-.]+([A-Za-z]{3,9})\.?[\s\-,]+(\d{4}|\d{2})$")
_MONTH_DAY = re.compile(r"(?:[A-Za-z]{3,9}\.?,?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$")


_ZONES: dict[str, ZoneInfo | None] = {}  # a plain dict: kernels travel by value


def zone(name: str) -> ZoneInfo | None:
    if name not in _ZONES:
        if len(_ZONES) > 4096:
            _ZONES.clear()
        try:
            _ZONES[name] = ZoneInfo(name)
        except Exception:
            _ZONES[name] = None
    return _ZONES[name]


def _us(local: dt.datetime) -> int:
    d = local - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def to_utc(local: dt.datetime, tz: ZoneInfo, received: int | None) -> list[tuple[int, bool]]:
    """The UTC instants of a wall-clock time, each with whether it is against the rule of arrival. A time that occurs
    twice has two: the rule is the latest not after ``received``, else the first; it comes first. Of unknown arrival
    neither is against it. A skipped time is read with the offset from before the change."""
    off0 = local.replace(tzinfo=tz, fold=0).utcoffset()
    off1 = local.replace(tzinfo=tz, fold=1).utcoffset()
    base = _us(local)
    a = base - (off0.days * 86400 + off0.seconds) * 1_000_000
    if off0 <= off1:  # usual, or skipped (then fold 0 has the offset before)
        return [(a, False)]
    b = base - (off1.days * 86400 + off1.seconds) * 1_000_000
    if received is None:
        return [(a, False), (b, False)]
    return [(b, False), (a, True)] if b <= received else [(a, False), (b, True)]


def _make(y: int, m: int, d: int, clock: tuple[int, int, int, int]) -> dt.datetime | None:
    try:
        return dt.datetime(2000 + y if y < 100 else y, m, d, *clock)
    except ValueError:
        return None


_FIRST, _LAST = _us(dt.datetime(1, 1, 1)), _us(dt.datetime(9999, 12, 31, 23, 59, 59, 999999))
UNITS = {"epoch_s": 6, "epoch_ms": 3, "epoch_us": 0}  # digits of a microsecond that the unit leaves to the fraction


def interpretations(text: str | None, tz: ZoneInfo | None, received: int | None) -> list[tuple[str, int, bool]]:
    """``(form, UTC microseconds, against the rule of arrival)`` of each valid reading; forms ``epoch_s, epoch_ms,
    epoch_us, ymd4, named, dmy, mdy, ymd``. A plain number has a reading in each unit in which it lies in the years 1 to
    9999.

    A zone in the text holds, else ``tz``; without any zone a wall-clock time has no instant.
    """
    if text is None:
        return []
    s = text.strip()
    if not s:
        return []
    if m := _NUMBER.fullmatch(s):
        whole, part = m[1], m[2] or ""
        if len(whole) > 20:
            return []
        sign = -1 if whole[0] == "-" else 1
        ways = [(form, int(whole) * 10**n + sign * int((part + "000000")[:n] or 0), False) for form, n in UNITS.items()]
        return [w for w in ways if _FIRST <= w[1] <= _LAST]
    offset, named = None, None
    if m := _BRACKET.search(s):
        named, s = m[1], s[: m.start()]
    if ":" in s or "T" in s.upper():
        if (m := _OFFSET.search(s)) and (":" in s[: m.start()] or re.search(r"\d[T\s]\d{4,6}(?:[.,]\d+)?$", s[: m.start()], re.I)):
            minutes = int(m[2]) * 60 + int(m[3] or 0)
            if int(m[2]) > 18 or int(m[3] or 0) > 59:
                return []
            offset, s = (minutes * 60 + int(m[4] or 0)) * (-1 if m[1] == "-" else 1), s[: m.start()]
        elif not _HALF.search(s) and (m := _NAME.search(s)):
            word = m[1]
            if word.upper() in ABBREVIATIONS:
                offset, s = ABBREVIATIONS[word.upper()] * 60, s[: m.start()]
            elif "/" in word and zone(word):
                named, s = word, s[: m.start()]
            else:
                return []
    if named and offset is None:
        if named.upper() in ABBREVIATIONS:
            offset = ABBREVIATIONS[named.upper()] * 60
        elif (tz := zone(named)) is None:
            return []
    half = None
    if m := _HALF.search(s):
        half, s = m[1].upper(), s[: m.start()]
    s = s.strip()
    m = _CLOCK.search(s) or _CLOCK_TIGHT.search(s)
    if not m:
        return []
    hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
    if half:
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + (12 if half == "P" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return []
    clock = (hour, minute, second, int(((m[4] or "") + "000000")[:6]))
    day = s[: m.start()].strip().rstrip(",")
    dates: list[tuple[str, int, int, int]] = []
    if d := _ISO.fullmatch(day):
        dates = [("ymd4", int(d[1]), int(d[3]), int(d[4]))]
    elif d := _TIGHT.fullmatch(day):
        dates = [("ymd4", int(d[1]), int(d[2]), int(d[3]))]
    elif d := _NUMERIC.fullmatch(day):
        a, b, c = int(d[1]), int(d[3]), int(d[4])
        dates = [("dmy", c, b, a), ("mdy", c, a, b)]
        if len(d[4]) == 2:
            dates.append(("ymd", a, b, c))
    elif d := _DAY_MONTH.fullmatch(day):
        if mon := MONTHS.get(d[2][:3].lower()):
            dates = [("named", int(d[3]), mon, int(d[1]))]
    elif d := _MONTH_DAY.fullmatch(day):
        if mon := MONTHS.get(d[1][:3].lower()):
            dates = [("named", int(d[3]), mon, int(d[2]))]
    out = []
    for form, y, mon, d in dates:
        local = _make(y, mon, d, clock)
        if local is None:
            continue
        if offset is not None:
            out.append((form, _us(local) - offset * 1_000_000, False))
        elif tz is not None:
            out += [(form, t, against) for t, against in to_utc(local, tz, received)]
    return out
