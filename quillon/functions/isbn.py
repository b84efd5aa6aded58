"""ISBNs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_isbn(x: Column) -> Column:
    """The 13 digits, or the 10 characters, of an ISBN however written; null for anything else. No check digit test."""
    d = F.upper(F.regexp_replace(x, "[^0-9Xx]", ""))
    return F.when(d.rlike(r"^\d{13}$") | (F.length(d) == 10), d)


def isbn10_to_13(x: Column) -> Column:
    """The ISBN-13 of a 10-character ISBN; null if its first nine are not digits."""
    core = F.concat(F.lit("978"), F.substring(x, 1, 9))
    total = sum((F.substring(core, i + 1, 1).try_cast("int") * (1 if i % 2 == 0 else 3) for i in range(12)), F.lit(0))
    return F.when((F.length(x) == 10) & core.rlike(r"^\d{12}$"), F.concat(core, ((10 - total % 10) % 10).cast("string")))


def isbn_valid(x: Column) -> Column:
    """Whether the check digit of a normalised ISBN is right."""
    digit = lambda i: F.substring(x, i + 1, 1).try_cast("int")
    sum13 = sum((digit(i) * (1 if i % 2 == 0 else 3) for i in range(13)), F.lit(0))
    last = F.when(F.substring(x, 10, 1) == "X", 10).otherwise(digit(9))
    sum10 = sum((digit(i) * (10 - i) for i in range(9)), F.lit(0)) + last
    return F.coalesce(F.when(F.length(x) == 13, sum13 % 10 == 0).when(F.length(x) == 10, sum10 % 11 == 0), F.lit(False))


def split_isbns(values: Column) -> Column:
    """struct(isbn13, isbn10): the first of each kind in a mixed list, the 13 derived where only a 10 is there."""
    found = F.filter(F.transform(values, normalize_isbn), lambda x: x.isNotNull())
    of = lambda n: F.try_element_at(F.filter(found, lambda x: F.length(x) == n), F.lit(1))
    return F.struct(F.coalesce(of(13), isbn10_to_13(of(10))).alias("isbn13"), of(10).alias("isbn10"))


def repaired(isbn13: Column, isbn10: Column) -> Column:
    """struct(isbn13, isbn10) of two fields as reported: a 10 in the 13 field moves over (and wins), a 13 in the 10
    field moves over, a missing 13 is derived."""
    a, b = normalize_isbn(isbn13), normalize_isbn(isbn10)
    ten = F.when(F.length(a) == 10, a).when(F.length(b) == 10, b)
    thirteen = F.when(F.length(a) == 13, a).when(F.length(b) == 13, b)
    return F.struct(F.coalesce(thirteen, isbn10_to_13(ten)).alias("isbn13"), ten.alias("isbn10"))
