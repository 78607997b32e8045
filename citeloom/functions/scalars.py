"""Scalar functions as Column expressions; all are null-safe and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_parse(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts: a month or day of 0 or null is 1; a null year or an impossible date gives null."""

    def part(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(c).cast("int")

    return F.when(year.isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), part(month), part(day)), "yyyy-MM-dd"))


def extract_year(text: Column) -> Column:
    """The year of a partial ISO date (YYYY, YYYY-MM, YYYY-MM-DD), else null."""
    return F.when(text.rlike(r"^\d{4}(-\d{2}){0,2}$"), F.substring(text, 1, 4).try_cast("int"))


def extract_month(text: Column) -> Column:
    """The month of a partial ISO date, null where the text has none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.substring(text, 6, 2).try_cast("int"))


def iso_date(text: Column) -> Column:
    """A full ISO date as a date, null for partial and impossible ones."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def iso_interval(text: Column) -> Column:
    """A signed ISO-8601 duration such as -P1Y2M3DT4H5M6.5S as struct(months, days, seconds); null for null and other texts."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    days_part, time_part = F.split_part(text, F.lit("T"), F.lit(1)), F.split_part(text, F.lit("T"), F.lit(2))

    def part(of: Column, unit: str, number: str = r"\d+", kind: str = "int") -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(of, rf"({number}){unit}", 1), F.lit("")).try_cast(kind), F.lit(0))

    months, days = sign * (part(days_part, "Y") * 12 + part(days_part, "M")), sign * (part(days_part, "W") * 7 + part(days_part, "D"))
    seconds = sign * (part(time_part, "H") * 3600 + part(time_part, "M") * 60 + part(time_part, "S", r"\d+(?:[.,]\d+)?", "double"))
    good = text.rlike(r"^-?P(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")
    return F.when(good, F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), seconds.cast("double").alias("seconds")))


def substring_match(text: Column, pattern: str) -> Column:
    """The first match of a pattern (or of its group), null where there is none."""
    group = 1 if "(" in pattern.replace(r"\(", "").replace("(?:", "") else 0
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def concat_skip_null(*parts: Column) -> Column:
    """The parts one after the other, nulls left out."""
    return F.concat_ws("", *parts)


def author_key(last: Column, first: Column) -> Column:
    """Last name and first initial in lower case."""
    return F.lower(F.concat_ws("", F.trim(last), F.substring(F.trim(first), 1, 1)))


def page_count(text: Column) -> Column:
    """The number in a page count such as 12p, null for anything else."""
    return F.rtrim(text, F.lit("p.")).try_cast("int")


def class_code(text: Column) -> Column:
    """A four-digit class code; of a code with a trailing list the first, null for other lengths."""
    first = F.when(text.rlike("[0-9];"), F.substring(text, 1, 4)).otherwise(text)
    return F.when(F.length(first) == 4, first)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def dois(text: Column) -> Column:
    """All DOIs in a text."""
    return F.regexp_extract_all(text, F.lit(r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"), F.lit(1))


def row_stats(*values: Column) -> dict[str, Column]:
    """sum, mean and population deviation over the columns of a row; nulls are left out."""
    every = F.filter(F.array(*(v.cast("double") for v in values)), lambda x: x.isNotNull())
    total = F.aggregate(every, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, F.size(every))
    squares = F.aggregate(every, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return {"sum": total, "mean": mean, "std": F.sqrt(F.try_divide(squares, F.size(every)))}
