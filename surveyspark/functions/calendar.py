"""Dates of interviews, imaging windows and calendar conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
MINUTE_TEXTS = {
    "300+": 300.0, "500+": 500.0, "500 +": 500.0, "995+": 500.0,
    "on premises": 0.0, "less than  minute": 1.0, "one day or longer": 900.0, "more than 12 hours": 720.0,
}
LAST_SAFE_DAY = 28
ETHIOPIAN_EPOCH = 1723856  # Julian day number at which the Ethiopian era is counted from
JULIAN_DAY_OF_1970 = 2440588
# ----------------------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def survey_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Date with days after the 28th set to the 28th, so that it exists in every month."""
    y, m, d = (_c(x).try_cast("double").cast("int") for x in (year, month, day))
    valid = y.between(1, 9999) & m.between(1, 12) & (d >= 1)
    return F.when(valid, F.make_date(y, m, F.least(d, F.lit(LAST_SAFE_DAY))))


def month_number(col: Column | str) -> Column:
    """Month from a name or a number written as text."""
    c = F.lower(F.trim(_c(col).cast("string")))
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), c.try_cast("double").cast("int"))


def full_year(col: Column | str) -> Column:
    """Two-digit years 93 to 99 belong to the twentieth century."""
    y = _c(col).try_cast("double").cast("int")
    return F.when(y.between(93, 99), y + 1900).otherwise(y)


def minutes(col: Column | str) -> Column:
    """Minutes from a number or one of the known texts."""
    c = _c(col).cast("string")
    texts = F.create_map(*[F.lit(x) for pair in MINUTE_TEXTS.items() for x in pair])
    return F.coalesce(F.try_element_at(texts, c), F.trim(c).try_cast("double"))


def ethiopian_to_gregorian(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Gregorian date by day counting: 365 days a year, one leap day in four years, months of 30 days."""
    y, m, d = (_c(x).cast("int") for x in (year, month, day))
    jdn = F.lit(ETHIOPIAN_EPOCH) + 365 * y + F.floor(y / 4) + 30 * m + d - 31
    days = (jdn - F.lit(JULIAN_DAY_OF_1970)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def add_span(date: Column | str, amount: int, unit: str) -> Column:
    """Calendar offset in months or years, clamped at the month end."""
    months = {"m": 1, "y": 12}[unit] * amount
    return F.add_months(_c(date), months)


def imaging_window(year: Column | str) -> tuple[Column, Column]:
    """First and last day used for optical images: a fixed window before 2016, else the year."""
    y = _c(year).cast("int")
    start = F.when(y < 2016, F.make_date(F.lit(2015), F.lit(6), F.lit(1))).otherwise(F.make_date(y, F.lit(1), F.lit(1)))
    end = F.when(y < 2016, F.make_date(F.lit(2016), F.lit(7), F.lit(1))).otherwise(F.make_date(y, F.lit(12), F.lit(31)))
    return start, end


def night_light_year(year: Column | str) -> Column:
    return F.greatest(F.least(_c(year).cast("int"), F.lit(2022)), F.lit(2013))


def imaging_period(year: Column | str) -> Column:
    """``yyyyMMdd-yyyyMMdd`` of the imaging window, as used in tile names."""
    start, end = imaging_window(year)
    return F.concat_ws("-", F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd"))


def month_ends(first: Column, last: Column) -> Column:
    """Array of month-end dates between two dates."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.filter(F.transform(months, F.last_day), lambda d: (d >= first) & (d <= last))


def cluster_gregorian_year(df: DataFrame, keys: list[str], year: str, month: str, day: str) -> DataFrame:
    """Most frequent Gregorian year per group, each row converted on its own; ties take the earlier year."""
    rows = df.withColumn("__y", F.year(ethiopian_to_gregorian(year, month, day)))
    counts = rows.groupBy(*keys, "__y").agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(
        F.max_by("__y", F.struct(F.col("__n"), -F.col("__y"))).alias("gregorian_year")
    )
