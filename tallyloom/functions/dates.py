"""Birth columns and day arithmetic, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(c: Column) -> Column:
    """dd-MM-yyyy as a date; null for anything else."""
    return F.when(c.rlike("^\\d{2}-\\d{2}-\\d{4}$"), F.try_to_timestamp(c, F.lit("dd-MM-yyyy")).cast("date"))


def parse_any(c: Column) -> Column:
    """d/m/yyyy with -, / or . at the start of a text; null where that is no date."""
    p = "^(\\d{1,2})[-/.](\\d{1,2})[-/.](\\d{4})"
    iso = F.concat_ws("-", F.regexp_extract(c, p, 3), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 1))
    return F.when(c.rlike(p), F.try_to_timestamp(iso, F.lit("y-M-d")).cast("date"))


def birth(dob: Column | None, age: Column | None, as_on: Column | None) -> Column:
    """struct(birth_date, birth_year, birth_exact, age_only): a date of birth is exact unless it is a first of January; else
    the year follows from an age and the year or date (dd-MM-yyyy) it holds for."""
    null = F.lit(None)
    day = parse_day(dob) if dob is not None else null.cast("date")
    exact = F.coalesce(day.isNotNull() & ~((F.month(day) == 1) & (F.dayofmonth(day) == 1)), F.lit(False))
    year = F.year(day)
    aged = null.cast("int")
    if age is not None:
        text = as_on.cast("string")
        aged = F.coalesce(F.year(parse_day(text)), text.try_cast("int")) - age.cast("int")
    return F.struct(
        F.when(exact, day).alias("birth_date"), F.coalesce(year, aged).cast("long").alias("birth_year"), exact.alias("birth_exact"),
        (year.isNull() & aged.isNotNull()).alias("age_only"),
    )


def full_years(birth_: Column, day: Column) -> Column:
    """Full years of age on a day; null where either is null."""
    md = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    return F.year(day) - F.year(birth_) - F.when(md(birth_) > md(day), 1).otherwise(0)
