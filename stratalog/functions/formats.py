"""Texts of times, durations and percentages; times are epoch seconds in UTC, durations are seconds."""

from __future__ import annotations

import calendar
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY, WEEK, MONTH, YEAR = 60, 3600, 86_400, 604_800, 2_592_000, 31_536_000
_UNITS = [(YEAR, "yr"), (MONTH, "mt"), (WEEK, "wk"), (DAY, "d"), (HOUR, "hr"), (MINUTE, "min"), (1, "sec")]


def format_date(kind: str, seconds: Column) -> Column:
    """kind: naive, rfc2822 or rfc3339; in UTC, whatever the session's time zone."""
    day, second = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int")), F.pmod(seconds.cast("long"), F.lit(DAY))
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(second / HOUR)), two(F.floor(second % HOUR / MINUTE)), two(second % MINUTE))
    date, between, zone = {"naive": (day.cast("string"), " ", ""), "rfc2822": (F.date_format(day, "EEE, d MMM yyyy"), " ", " +0000"), "rfc3339": (day.cast("string"), "T", "+00:00")}[kind]
    return F.when(seconds.isNotNull(), F.concat(date, F.lit(between), clock, F.lit(zone)))


def format_duration(seconds: Column) -> Column:
    """The largest unit that isn't zero and, if not zero, the next one: 1yr 2mt, 3wk, 5min 0sec.

    A unit counts what the larger ones leave. Minutes and seconds are always both given where nothing is larger.
    """
    parts, rest = [], seconds.cast("long")
    for size, name in _UNITS:
        parts.append((F.floor(rest / size).cast("long"), name))
        rest = rest % size
    text = F.concat(parts[5][0].cast("string"), F.lit("min "), parts[6][0].cast("string"), F.lit("sec"))
    for k in range(4, -1, -1):
        (n, unit), (m, smaller) = parts[k], parts[k + 1]
        head = F.concat(n.cast("string"), F.lit(unit))
        text = F.when(n != 0, F.when(m != 0, F.concat(head, F.lit(" "), m.cast("string"), F.lit(smaller))).otherwise(head)).otherwise(text)
    return F.when(seconds.isNotNull(), text)


def spelt_duration(seconds: Column) -> Column:
    """All units that aren't zero, in words and without blanks between: 2 years3 days. A year has twelve months of 30 days."""
    parts, rest = [], seconds.cast("long")
    for size, name in ((12 * MONTH, "years"), (MONTH, "months"), (DAY, "days"), (HOUR, "hours"), (MINUTE, "minutes"), (1, "seconds")):
        n, rest = F.floor(rest / size).cast("long"), rest % size
        parts.append(F.when(n == 0, "").otherwise(F.concat(n.cast("string"), F.lit(f" {name}"))))
    return F.when(seconds == 0, "0 seconds").otherwise(F.concat(*parts))


def percent_text(value: Column) -> Column:
    """With a percent sign; values above 100 are kept as they are."""
    return F.concat(value.cast("string"), F.lit("%"))


def joined(array: Column, separator: str = " ") -> Column:
    return F.array_join(array, separator)


def quoted(text: Column) -> Column:
    """In double quotes, with those inside doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def timestamp(year: int, month: int | str, day: int = 1) -> int:
    """Epoch seconds of a midnight in UTC; the month by number or English name."""
    if isinstance(month, str):
        month = list(calendar.month_name).index(month.capitalize())
    return int(datetime(year, month, day, tzinfo=timezone.utc).timestamp())


def duration(years: int = 0, months: int = 0, weeks: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> int:
    """Seconds; a month has 30 days and a year 365."""
    return years * YEAR + months * MONTH + weeks * WEEK + days * DAY + hours * HOUR + minutes * MINUTE + seconds
