"""Month and day keys, and parsing of raw export fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as they stand in the raw exports, January first.
MONTHS = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")


def month_key(period: Column) -> Column:
    """Months since year 0: neighbours differ by one."""
    return F.year(period) * 12 + F.month(period) - 1


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def parse_period(raw: Column) -> Column:
    """'август 2024' -> 2024-08-01; NULL if it is no such text."""
    name = F.lower(F.regexp_extract(F.trim(raw), r"^(.*) \S+$", 1))
    year = F.regexp_extract(F.trim(raw), r" ([0-9]{4})$", 1).try_cast("int")
    number = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    return F.when(number > 0, F.make_date(year, number, F.lit(1)))


def parse_queries(raw: Column) -> Column:
    """'997 977' -> 997977; only digits and ASCII spaces, else NULL."""
    bare = F.replace(F.trim(raw), F.lit(" "), F.lit(""))
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("bigint"))


def parse_share(raw: Column) -> Column:
    """'0,0115' -> 0.0115."""
    bare = F.trim(raw)
    return F.when(bare.rlike("^[0-9]+(,[0-9]+)?$"), F.replace(bare, F.lit(","), F.lit(".")).try_cast("double"))


def parse_day(raw: Column) -> Column:
    """'23.06.2026' -> date, else NULL."""
    return F.when(F.trim(raw).rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.try_to_timestamp(F.trim(raw), F.lit("dd.MM.yyyy")).cast("date"))


def extract_phrase(title: Column) -> Column:
    """What stands between the first « and the next »; '' if nothing does."""
    return F.regexp_extract(title, "«([^»]*)»", 1)


def lead_time_months(weeks: int | Column) -> Column:
    w = F.lit(weeks) if isinstance(weeks, int) else weeks
    return F.ceil(w * F.lit(12) / F.lit(52)).cast("int")


def shift_months(period: Column, months: int) -> Column:
    return F.add_months(period, months)


def default_window(today: Column, months: int = 60) -> tuple[Column, Column]:
    """First and last day of the full past months up to the last one."""
    first = F.trunc(today, "MM")
    return F.add_months(first, -months), F.date_sub(first, 1)


def window_is_valid(start: Column, end: Column, today: Column, least: int = 3, most: int = 60) -> Column:
    """Request window rule: from <= to, not before 2018, not after today, 3 to 60 months."""
    months = month_key(end) - month_key(start) + 1
    return (start <= end) & (start >= F.make_date(F.lit(2018), F.lit(1), F.lit(1))) & (end <= today) & months.between(least, most)
