"""Partial publication dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyyMMdd"]
#: The shape a text must have before a format is tried on it.
_SHAPES = [r"^\d{4}-\d{2}-\d{2}", r"^\d{4}/\d{2}/\d{2}$", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", r"^\d{1,2} [A-Za-z]{4,} \d{4}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^\d{8}$"]


def parse_date(x: Column) -> Column:
    """struct(date, year): a whole date, or a null date and the year the text names. Missing parts are never made up."""
    t = F.trim(x)
    tries = [F.when(t.rlike(shape), F.try_to_date(F.substring(t, 1, 10) if form == "yyyy-MM-dd" else t, form)) for form, shape in zip(FORMATS, _SHAPES)]
    day = F.coalesce(*tries)
    year = F.coalesce(F.year(day), F.regexp_extract(t, r"(1[0-9]{3}|20[0-9]{2})", 1).try_cast("int"))
    return F.struct(day.alias("date"), year.alias("year"))


def guarded(parsed: Column, as_of_year: int, first: int = 1450, ahead: int = 2) -> Column:
    """The parsed struct with both parts null if the year lies before printing or more than `ahead` years ahead."""
    ok = parsed["year"].between(first, as_of_year + ahead)
    return F.struct(F.when(ok, parsed["date"]).alias("date"), F.when(ok, parsed["year"]).alias("year"))
