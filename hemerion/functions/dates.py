"""Dates in slugs and pages, and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemerion.functions.text import plain

#: Month names; one month has two spellings.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9,
    "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}


def spanish_date(day: Column, month: Column, year: Column) -> Column:
    """A date from its parts; null for an unknown month or an impossible day."""
    number = F.create_map(*[x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))])[month]
    padded = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(number.isNotNull(), F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")).cast("date"))


def date_of_slug(slug: Column) -> Column:
    """The date that a slug ends with; null when it can't be read."""
    text = plain(F.regexp_extract(slug, "^([^?]*)", 1))
    pattern = "-del?-([0-9]{1,2})-de-([a-z]+)-(?:de-)?([0-9]{4})"
    return spanish_date(*[F.regexp_extract(text, pattern, k) for k in (1, 2, 3)])


def date_in_text(text: Column) -> Column:
    """The first date written out in a text."""
    pattern = "([0-9]{1,2}) de ([a-z]+) (?:de |del )?([0-9]{4})"
    return spanish_date(*[F.regexp_extract(plain(text), pattern, k) for k in (1, 2, 3)])


def date_in_page(heading: Column, place_line: Column) -> Column:
    """The first readable date of the heading, else of the line with place and date."""
    return F.coalesce(date_in_text(heading), date_in_text(place_line))


def _month_name(day: Column) -> Column:
    names = {n: m for m, n in MONTHS.items() if m != "setiembre"}
    return F.create_map(*[x for n, m in names.items() for x in (F.lit(n), F.lit(m))])[F.month(day)]


def long_date(day: Column) -> Column:
    """``5 de marzo de 2025``."""
    return F.concat_ws(" de ", F.dayofmonth(day).cast("string"), _month_name(day), F.year(day).cast("string"))


def month_label(day: Column) -> Column:
    """``mar 25``."""
    return F.concat(F.left(_month_name(day), F.lit(3)), F.lit(" "), F.date_format(day, "yy"))


def weekdays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row ``fecha`` for each Monday to Friday."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("fecha"))
    return days.where(F.weekday("fecha") < 5)


def settled_date(content: Column, slug: Column) -> Column:
    """struct(fecha, coincide): the content's date goes first; null when either is missing."""
    return F.struct(F.coalesce(content, slug).alias("fecha"), (content == slug).alias("coincide"))
