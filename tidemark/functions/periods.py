"""Calendar periods as column expressions (no zone conversion, no UDF).

Frequencies carry pandas' names: seconds, minutes, hours, days, weeks ending on
any weekday (``W-SAT``), months, quarters and years ending in any month
(``Q-MAR``, ``Y-JUN``). A period is represented by its first day (``DateType``;
first instant as ``timestamp_ntz`` below a day). ``period_index`` maps that to
a whole number such that the difference of two indexes is the number of periods
between them, which is what pandas' ``Period - Period`` gives (``.n``) and what
SQL ``DATEDIFF('month', a, b)`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted frequency names: pandas aliases and plain words.
FREQUENCIES = {
    "S": "second", "SECOND": "second",
    "T": "minute", "MIN": "minute", "MINUTE": "minute",
    "H": "hour", "HOUR": "hour",
    "D": "day", "DAY": "day",
    "W": "week", "WEEK": "week",
    "M": "month", "ME": "month", "MS": "month", "MONTH": "month",
    "Q": "quarter", "QE": "quarter", "QS": "quarter", "QUARTER": "quarter",
    "Y": "year", "YE": "year", "YS": "year", "A": "year", "YEAR": "year",
}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}
_LABELS = {"second": "yyyy-MM-dd HH:mm:ss", "minute": "yyyy-MM-dd HH:mm",
           "hour": "yyyy-MM-dd HH:mm", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def parse_freq(freq: str) -> tuple[str, int]:
    """(unit, anchor) of a frequency name. The anchor of a week is the weekday
    it starts on (Monday 0), of a quarter or year the number of months from its
    year's end to December."""
    name, _, anchor = freq.upper().partition("-")
    unit = FREQUENCIES.get(name)
    if unit == "week" and (not anchor or anchor in WEEKDAYS):
        return unit, (WEEKDAYS.index(anchor or "SUN") + 1) % 7
    # Start-anchored names (QS-, YS-) name a first month, so they have no anchor here.
    if name in ("Q", "QE", "Y", "YE", "A") and anchor in MONTHS:
        return unit, 11 - MONTHS.index(anchor)
    if unit is None or anchor:
        raise ValueError(f"unsupported period frequency {freq!r}")
    return unit, 0


def normalize_freq(freq: str) -> str:
    return parse_freq(freq)[0]


def as_date(col: Column) -> Column:
    """Calendar day of a timestamp, timestamp_ntz, date or ISO string column."""
    return F.to_date(col)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(col: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), col.cast("timestamp_ntz"))


def _months(day: Column, shift: int) -> Column:
    """Months since year 0, moved so that the anchored year ends in December."""
    return F.year(day) * 12 + F.month(day) - 1 + F.lit(shift)


def _first_of(months: Column, shift: int) -> Column:
    real = months - F.lit(shift)
    return F.make_date(F.floor(real / 12).cast("int"), (F.pmod(real, F.lit(12)) + 1).cast("int"), F.lit(1))


def period_start(col: Column, freq: str) -> Column:
    """First day (below a day: first instant) of the period holding ``col``."""
    unit, anchor = parse_freq(freq)
    if unit in _MICROS:
        micros = _micros(col)
        return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, F.lit(_MICROS[unit])), _epoch())
    day = as_date(col)
    if unit == "day":
        return day
    if unit == "week":
        # 1970-01-05 (day 4) is a Monday.
        return F.date_sub(day, F.pmod(F.unix_date(day) + F.lit(3 - anchor), F.lit(7)))
    if not anchor:
        return F.trunc(day, unit)
    months = _months(day, anchor)
    return _first_of(months - F.pmod(months, F.lit(12 if unit == "year" else 3)), anchor)


def period_index(start: Column, freq: str) -> Column:
    """Whole-number position of a period given by its first day."""
    unit, anchor = parse_freq(freq)
    if unit in _MICROS:
        return F.floor(_micros(start) / F.lit(_MICROS[unit])).cast("long")
    if unit == "day":
        return F.unix_date(start).cast("long")
    if unit == "week":
        return F.floor((F.unix_date(start) + F.lit(3 - anchor)) / F.lit(7)).cast("long")
    months = _months(start, anchor)
    size = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.floor(months / F.lit(size)).cast("long")


def period_label(start: Column, freq: str) -> Column:
    """Text of the period as pandas prints a ``Period`` of that frequency; an
    anchored quarter or year is named by the year it ends in."""
    unit, anchor = parse_freq(freq)
    if unit == "week":
        return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                        F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    if unit in _LABELS:
        return F.date_format(start, _LABELS[unit])
    months = _months(start, anchor)
    year = F.floor(months / 12).cast("string")
    if unit == "year":
        return year
    return F.concat(year, F.lit("Q"), F.floor(F.pmod(months, F.lit(12)) / 3 + 1).cast("string"))


def month_start(col: Column) -> Column:
    """DATE_TRUNC('month', ts) as a zone-free timestamp_ntz."""
    return F.trunc(as_date(col), "month").cast("timestamp_ntz")
