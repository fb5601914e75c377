"""PostgreSQL date and time: functions, EXTRACT fields and interval literals."""

from __future__ import annotations

import re

from ..errors import SqlError

FUNCTIONS = {
    "now": lambda: "current_timestamp()",
    "current_timestamp": lambda: "current_timestamp()",
    "transaction_timestamp": lambda: "current_timestamp()",
    "clock_timestamp": lambda: "current_timestamp()",
    "statement_timestamp": lambda: "current_timestamp()",
    "current_date": lambda: "current_date()",
    "current_time": lambda: "current_time()",
    "localtime": lambda: "current_time()",
    "localtimestamp": lambda: "localtimestamp()",
    "age": lambda a, b=None: age("current_date()", a) if b is None else age(a, b),
    "make_date": lambda y, m, d: f"make_date({y}, {m}, {d})",
    "date_trunc": lambda unit, x: f"date_trunc({unit}, {x})",
    "make_interval": lambda years="0", months="0", weeks="0", days="0", hours="0", mins="0", secs="0": f"make_interval({years}, {months}, {weeks}, {days}, {hours}, {mins}, {secs})",
}


def extract(part: str, x: str, kind: str) -> str:
    """EXTRACT as a double; ``kind`` is the argument's Spark type."""
    part = part.lower().strip("'")
    if kind.startswith("interval"):
        return _of_interval(part, x, kind)
    if part == "epoch":
        stamp = f"to_utc_timestamp(CAST({x} AS timestamp), 'UTC')" if kind == "date" else f"CAST({x} AS timestamp)"
        return f"(unix_micros({stamp}) / 1000000D)"
    forms = {
        "dow": f"(dayofweek({x}) - 1)",
        "isodow": f"(weekday({x}) + 1)",
        "doy": f"dayofyear({x})",
        "decade": f"floor(year({x}) / 10)",
        "century": f"CASE WHEN year({x}) > 0 THEN ceil(year({x}) / 100) ELSE floor(year({x}) / 100) END",
        "millennium": f"CASE WHEN year({x}) > 0 THEN ceil(year({x}) / 1000) ELSE floor(year({x}) / 1000) END",
        "isoyear": f"extract(YEAROFWEEK FROM {x})",
        "milliseconds": f"(extract(SECOND FROM {x}) * 1000)",
        "microseconds": f"(extract(SECOND FROM {x}) * 1000000)",
    }
    plain = ("year", "month", "day", "hour", "minute", "second", "week", "quarter")
    if part not in forms and part not in plain:
        raise SqlError("22023", f"unit {part!r} is not supported")
    return f"CAST({forms.get(part) or f'extract({part.upper()} FROM {x})'} AS double)"


def calendar(x: str, kind: str) -> str:
    """An interval of any kind as one of months, days and microseconds."""
    if kind == "interval":
        return x
    x = _whole(x, kind)
    if _by_months(kind):
        return f"make_interval(0, CAST(extract(YEAR FROM {x}) * 12 + extract(MONTH FROM {x}) AS int))"
    return f"make_interval(0, 0, 0, CAST(extract(DAY FROM {x}) AS int), CAST(extract(HOUR FROM {x}) AS int), CAST(extract(MINUTE FROM {x}) AS int), extract(SECOND FROM {x}))"


def mixed(a: str, b: str) -> bool:
    """Whether intervals of these kinds have no common kind but that of calendars."""
    return a != b and (_by_months(a) != _by_months(b) or "interval" in (a, b))


def _by_months(kind: str) -> bool:
    return kind.startswith(("interval year", "interval month"))


def _whole(x: str, kind: str) -> str:
    """An interval with all fields of its kind, as only they can be extracted."""
    return x if kind == "interval" else f"CAST({x} AS INTERVAL {'YEAR TO MONTH' if _by_months(kind) else 'DAY TO SECOND'})"


def _of_interval(part: str, x: str, kind: str) -> str:
    months, days = ("year", "month", "quarter", "decade", "century", "millennium"), ("day", "hour", "minute", "second", "milliseconds", "microseconds")
    if part not in (*months, *days, "epoch"):
        raise SqlError("22023", f"unit {part!r} is not supported for an interval")
    x = _whole(x, kind)
    has_months, has_days = _by_months(kind) or kind == "interval", not _by_months(kind)
    field = lambda f: f"CAST(extract({f} FROM {x}) AS double)"
    if part == "epoch":
        sums = [f"{field('YEAR')} * 31557600 + {field('MONTH')} * 2592000"] * has_months
        sums += [f"{field('DAY')} * 86400 + {field('HOUR')} * 3600 + {field('MINUTE')} * 60 + {field('SECOND')}"] * has_days
        return f"({' + '.join(sums)})"
    if not (has_months if part in months else has_days):
        return f"CASE WHEN {x} IS NOT NULL THEN 0D END"
    forms = {
        "quarter": f"(floor({field('MONTH')} / 3) + 1)", "decade": f"floor({field('YEAR')} / 10)", "century": f"floor({field('YEAR')} / 100)", "millennium": f"floor({field('YEAR')} / 1000)",
        "milliseconds": f"({field('SECOND')} * 1000)", "microseconds": f"({field('SECOND')} * 1000000)",
    }
    return f"CAST({forms.get(part) or field(part.upper())} AS double)"


def age(later: str, earlier: str) -> str:
    """Years, months, days and time from one moment to a later one, as one counts them on a calendar."""
    a, b = f"CAST({later} AS timestamp_ntz)", f"CAST({earlier} AS timestamp_ntz)"
    months = f"CAST(months_between({a}, {b}) AS int)"
    rest = f"({a} - ({b} + make_ym_interval(0, {months})))"
    return f"(make_interval(0, {months}) + {calendar(rest, 'interval day to second')})"


_PART = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)|([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", re.I)
_UNIT = {
    **dict.fromkeys(("y", "yr", "yrs", "year", "years"), ("months", 12)),
    **dict.fromkeys(("mon", "mons", "month", "months"), ("months", 1)),
    **dict.fromkeys(("decade", "decades"), ("months", 120)),
    **dict.fromkeys(("century", "centuries"), ("months", 1200)),
    **dict.fromkeys(("w", "week", "weeks"), ("days", 7)),
    **dict.fromkeys(("d", "day", "days"), ("days", 1)),
    **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), ("seconds", 3600)),
    **dict.fromkeys(("m", "min", "mins", "minute", "minutes"), ("seconds", 60)),
    **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), ("seconds", 1)),
    **dict.fromkeys(("ms", "millisecond", "milliseconds"), ("seconds", 0.001)),
}


def interval(text: str) -> tuple[int, int, float]:
    """Months, days and seconds of an interval literal."""
    parts = {"months": 0.0, "days": 0.0, "seconds": 0.0}
    ago, rest = text.strip().lower().endswith("ago"), re.sub(r"ago\s*$|^@", "", text.strip(), flags=re.I)
    found = False
    for m in _PART.finditer(rest):
        found = True
        if m[2]:
            if m[2].lower() not in _UNIT:
                raise SqlError("22007", f"invalid input syntax for type interval: {text!r}")
            unit, times = _UNIT[m[2].lower()]
            parts[unit] += float(m[1]) * times
        else:
            sign = -1 if m[3] == "-" else 1
            parts["seconds"] += sign * (int(m[4]) * 3600 + int(m[5]) * 60 + float(m[6] or 0))
    if not found:
        raise SqlError("22007", f"invalid input syntax for type interval: {text!r}")
    months, days = int(parts["months"]), parts["days"] + (parts["months"] % 1) * 30
    seconds = parts["seconds"] + (days - int(days)) * 86400
    sign = -1 if ago else 1
    return sign * months, sign * int(days), sign * seconds


def interval_sql(text: str) -> str:
    """An interval literal: a day-time or year-month interval where it is one, else a calendar interval."""
    months, days, seconds = interval(text)
    if months and not days and not seconds:
        return f"INTERVAL '{months}' MONTH"
    if not months:
        micros = round(seconds * 1_000_000)
        if not micros:
            return f"INTERVAL '{days}' DAY"
        total = days * 86_400_000_000 + micros
        sign, total = ("-" if total < 0 else ""), abs(total)
        return f"INTERVAL '{sign}{total // 1_000_000}.{total % 1_000_000:06d}' SECOND"
    return f"make_interval(0, {months}, 0, {days}, 0, 0, {seconds:.6f})"
