"""Calendar of dekads, three to a month, as Column expressions.

A dekad is YYYYKK with KK in 1..36, or raw: dekads since 1900, 1900-01-01 being 1.
Season values ("pheno") count dekads from the first of the year before the current
one (1..108), or from the current year (-35..72, "natural").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return c.cast("int")


def of_year(date: Column) -> Column:
    """KK of a date; the third dekad of a month takes all its last days."""
    return _int((F.month(date) - 1) * 3 + F.least(F.lit(3), F.floor((F.dayofmonth(date) - 1) / 10) + 1))


def from_date(date: Column) -> Column:
    return _int(F.year(date) * 100 + of_year(date))


def to_raw(dekad: Column) -> Column:
    return _int((F.floor(dekad / 100) - 1900) * 36 + dekad % 100)


def from_raw(raw: Column) -> Column:
    return _int((F.floor((raw - 1) / 36) + 1900) * 100 + F.pmod(raw - 1, F.lit(36)) + 1)


def raw_of_date(date: Column) -> Column:
    return to_raw(from_date(date))


def start(dekad: Column) -> Column:
    """First day of a dekad."""
    kk = dekad % 100
    return F.make_date(_int(F.floor(dekad / 100)), _int(F.ceil(kk / 3)), _int((kk - 1) % 3 * 10 + 1))


def shift(dekad: Column, n: Column | int) -> Column:
    return from_raw(to_raw(dekad) + n)


def last_day(dekad: Column) -> Column:
    return F.date_sub(start(shift(dekad, 1)), 1)


def days(dekad: Column) -> Column:
    """Length of a dekad, 8 to 11 days."""
    return _int(F.datediff(start(shift(dekad, 1)), start(dekad)))


def add(date: Column, months: int = 0, dekads: int = 0) -> Column:
    """Months are added first, then dekads; the result is the first day of its dekad."""
    return start(shift(from_date(F.add_months(date, months)), dekads))


def from_pheno(pheno: Column, year: Column | int, natural: bool = False) -> Column:
    """The dekad of a season value; null outside of its bounds."""
    low, high, base = (-35, 72, 0) if natural else (1, 108, 36)
    year = F.lit(year) if isinstance(year, int) else year
    return F.when(pheno.between(low, high), from_raw((year - 1900) * 36 + pheno - base))


def to_pheno(dekad: Column, year: Column | int, natural: bool = False) -> Column:
    year = F.lit(year) if isinstance(year, int) else year
    return _int(to_raw(dekad) - (year - 1900) * 36 + (0 if natural else 36))


def fold(pheno: Column) -> Column:
    """Season value 1..108 folded to the dekad of the year, 1..36; null outside."""
    return F.when(pheno.between(1, 108), _int(F.pmod(pheno - 1, F.lit(36)) + 1))


def mmdd(kk: Column) -> Column:
    return F.format_string("%02d%02d", _int(F.ceil(kk / 3)), _int((kk - 1) % 3 * 10 + 1))


def from_mmdd(text: Column) -> Column:
    """KK of an MMDD string; day 31 belongs to the third dekad."""
    return _int((F.substring(text, 1, 2).cast("int") - 1) * 3 + F.least(F.lit(3), F.floor((F.substring(text, 3, 2).cast("int") - 1) / 10) + 1))


def parse(text: Column, pattern: str = "yyyyMMdd") -> Column:
    return from_date(F.to_date(text, pattern))


def format(dekad: Column, pattern: str = "yyyyMMdd") -> Column:
    return F.date_format(start(dekad), pattern)


def month_of(kk: Column) -> Column:
    return _int(F.ceil(kk / 3))


def season_index(month: Column, sos: int) -> Column:
    """Months from the start of season, from 1; a season whose start and end month coincide has 12."""
    return _int(F.pmod(month - sos, F.lit(12)) + 1)


def season_length(sos: int, eos: int) -> int:
    return (eos - sos) % 12 + 1


def in_season(month: Column, sos: int, eos: int) -> Column:
    return season_index(month, sos) <= season_length(sos, eos)


def season_year(date: Column, sos: int, eos: int) -> Column:
    """The year in which the season ends; in a season that wraps, months after its end belong to the next."""
    y = F.year(date)
    return _int(F.when(F.month(date) > eos, y + 1).otherwise(y)) if sos > eos else _int(y)


def issue_month(month: Column) -> Column:
    return _int(F.pmod(month, F.lit(12)) + 1)


def parsed(text: Column, pattern: str) -> Column:
    """A date, or null where the text is none."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def current() -> Column:
    """The dekad of today."""
    return from_date(F.current_date())


def calendar(spark, sos: int, eos: int):
    """The season's months: month_index from 1, month, and how much of the season is over at the month's end, in percent."""
    n = season_length(sos, eos)
    idx = spark.range(1, n + 1).select(F.col("id").cast("int").alias("month_index"))
    return idx.select("month_index", (F.pmod(F.col("month_index") + sos - 2, F.lit(12)) + 1).cast("int").alias("month"), (F.col("month_index") * 100.0 / n).alias("progress"))
