"""Column expressions over dates that are kept as strings, year first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def date_prefix(text: Column) -> Column:
    """The leading yyyy/MM/dd, or null."""
    found = F.regexp_extract(F.trim(text), r"^(\d{4}/\d{2}/\d{2})", 1)
    return F.when(found != "", found)


def named_date(text: Column) -> Column:
    """`8 May, 2023` within a text as 2023/05/08, months in any case and also by their first three letters (and Sept); an unknown month gives 00; other texts stay."""
    pattern = r"(\d{1,2})\s+(\w+),?\s+(\d{4})"
    day, month, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    number = F.lit("00")
    for k, name in enumerate(MONTHS, 1):
        number = F.when(F.lower(month).isin(name.lower(), name[:3].lower(), *(["sept"] if k == 9 else [])), f"{k:02d}").otherwise(number)
    return F.when(year != "", F.concat_ws("/", year, number, F.lpad(day, 2, "0"))).otherwise(text)


def edge_time(session_time: Column, timestamp: Column, session_times: Column) -> Column:
    """The first time an edge has, as a date with slashes."""
    given = F.coalesce(F.nullif(session_time, F.lit("")), F.nullif(timestamp, F.lit("")), F.array_max(F.filter(session_times, lambda x: x != "")), F.lit(""))
    return F.translate(F.split(given, " ")[0], "-", "/")


def parsed(text: Column) -> Column:
    return F.try_to_date(text, "yyyy/M/d")


def day_gap(a: Column, b: Column) -> Column:
    """Days between two dates; 0 where either is missing or isn't a date."""
    return F.coalesce(F.abs(F.datediff(parsed(a), parsed(b))), F.lit(0)).cast("double")


def question_day(text: Column) -> Column:
    return F.substring(F.split(F.coalesce(text, F.lit("")), " ")[0], 1, 10)


def decay(gap: Column, median: Column, power: float) -> Column:
    """exp(-(gap / median)^power), the median being one day at least."""
    return F.exp(-F.pow(gap / F.greatest(median, F.lit(1.0)), F.lit(power)))
