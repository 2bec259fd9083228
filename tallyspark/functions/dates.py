"""Date expressions."""

import re

from pyspark.sql import Column, functions as F

from tallyspark.functions.sqltext import quoted

#: Patterns tried in order when no layout names the format: month before day,
#: day first only where the month-first reading fails.
MIXED = ["yyyy-M-d", "yyyy/M/d",
         "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M/d/yy", "d/M/yy", "M-d-yy", "d-M-yy",
         "d-MMM-yyyy", "d MMM yyyy", "d-MMM-yy", "d MMM yy", "MMM d yyyy", "MMM d, yyyy",
         "d MMMM yyyy", "MMMM d, yyyy", "yyyyMMdd"]

DAY_FIRST = [p for p in MIXED if not p.startswith("M/") and not p.startswith("M-")]


#: Fixed value: a time of day after a date, with optional seconds, fraction, AM/PM and zone.
TIME_OF_DAY = (r"(?<=[0-9])[ T]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?( ?[AaPp][Mm])?"
               r"( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?$")


def day_of(text: str, pattern: str, day: str | None = None) -> str:
    """SQL of the text that a pattern reads: without its time of day (``day``, if it is at
    hand), unless the pattern has one."""
    if "H" in pattern:
        return f"trim({text})"
    if day:
        return day
    return f"regexp_replace(trim({text}), {quoted(TIME_OF_DAY)}, '')"


#: What the letters of a pattern may read: never less than the parser takes.
_FIELDS = {"yyyy": "[+-]?[0-9]{4,}", "yy": "[0-9]{2}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+",
           "MM": "[0-9]{2}", "dd": "[0-9]{2}", **dict.fromkeys("MdHms", "0*[0-9]{1,2}")}


def shape(pattern: str) -> str:
    """A regex that holds for every text a date pattern reads. A text of another shape costs a
    search; left to the parser, it would cost an exception."""
    return "^" + re.sub(r"([A-Za-z])\1*", lambda m: _FIELDS[m[0]], pattern) + "$"


def read_as(text: str, pattern: str) -> str:
    """SQL of the timestamp that a pattern reads from a text, else null."""
    return (f"case when {text} rlike {quoted(shape(pattern))} "
            f"then try_to_timestamp({text}, {quoted(pattern)}) end")


def without_time(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), TIME_OF_DAY, "")


def parse_date(text: Column, pattern: str) -> Column:
    day = F.trim(text) if "H" in pattern else without_time(text)
    return _read(day, pattern).cast("date")


def _read(day: Column, pattern: str) -> Column:
    return F.when(day.rlike(shape(pattern)), F.try_to_timestamp(day, F.lit(pattern)))


def _tried(day_first: bool) -> list[str]:
    return DAY_FIRST + [p for p in MIXED if p not in DAY_FIRST] if day_first else MIXED


def parse_mixed(text: Column, day_first: bool = False, stripped: bool = False) -> Column:
    """Each value by the first pattern that fits it; ``stripped`` if its time of day is gone."""
    day = text if stripped else without_time(text)
    return F.coalesce(*[_read(day, p).cast("date") for p in _tried(day_first)])


def mixed_day(day: str, day_first: bool = False) -> str:
    """SQL of :func:`parse_mixed` of a text without its time of day."""
    return "coalesce(" + ", ".join(f"cast({read_as(day, p)} as date)"
                                   for p in _tried(day_first)) + ")"
