import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, isbn, text, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, folded",
    [("Hale, Margaret", "margaret hale"), ("Dr. Margaret Hale PhD", "margaret hale"), ("  MARGARET   HALE ", "margaret hale"), ("Núñez, José", "jose nunez"), ("O'Hara, Finn", "finn o hara"), ("", ""), (None, None)],
)
def test_person(spark, raw, folded):
    assert one(spark, text.normalize_person(F.col("a")), a=raw) == folded


@pytest.mark.parametrize("raw, key", [("Margaret Hale", "hale:m"), ("Hale", "hale"), ("", ""), ("Dr. ", "")])
def test_block_key(spark, raw, key):
    assert one(spark, text.person_block_key(F.col("a")), a=raw) == key


@pytest.mark.parametrize("raw, key", [("The Quiet Sea!", "quiet sea"), ("A Tale of the Sea", "tale of the sea"), ("An Ode", "ode"), ("Théâtre", "theatre"), ("the", "the")])
def test_title(spark, raw, key):
    assert one(spark, text.normalize_title(F.col("a")), a=raw) == key


@pytest.mark.parametrize("raw, clean", [("<p>home <b>x</b>.</p>", "home x."), ("a&nbsp;&amp;&nbsp;b", "a & b"), ("( x )", "(x)"), ("   ", None), (None, None), ("&amp;lt;", "<")])
def test_clean(spark, raw, clean):
    assert one(spark, text.clean_text(F.col("a")), a=raw) == clean


def test_emails_in_order(spark):
    assert one(spark, text.extract_emails(F.col("a")), a="B@x.org a@y.net b@X.org") == ["b@x.org", "a@y.net"]
    assert one(spark, text.extract_emails(F.col("a")), a=None) == []


def test_shared_inboxes_stay_only_on_their_own_domain(spark):
    keep = text.keep_email(F.col("e"), F.col("u"))
    assert one(spark, keep, e="info@hale.example", u="https://www.hale.example/about")
    assert not one(spark, keep, e="info@shop.example", u="https://www.hale.example/about")
    assert one(spark, keep, e="margaret@shop.example", u="https://www.hale.example/about")


@pytest.mark.parametrize("raw, names", [("by Ann Ray and Bo Lind", ["Ann Ray", "Bo Lind"]), ("Ray, Ann", ["Ray, Ann"]), ("Ann Ray, Bo Lind, Cy Orr", ["Ann Ray", "Bo Lind", "Cy Orr"]), ("Written by Ann Ray; B", ["Ann Ray"])])
def test_byline(spark, raw, names):
    from quillon.sources.html import byline

    assert one(spark, text.split_byline(F.col("a")), a=raw) == names == byline(raw)


def test_isbn(spark):
    assert one(spark, isbn.isbn10_to_13(F.col("a")), a="0306406152") == "9780306406157"
    assert one(spark, isbn.isbn10_to_13(F.col("a")), a="12345X7890") is None
    assert one(spark, isbn.normalize_isbn(F.col("a")), a="ISBN 978-0-306-40615-7") == "9780306406157"
    assert one(spark, isbn.normalize_isbn(F.col("a")), a="12") is None
    assert one(spark, isbn.isbn_valid(F.col("a")), a="9780306406157") is True
    assert one(spark, isbn.isbn_valid(F.col("a")), a="0306406153") is False
    both = one(spark, isbn.split_isbns(F.col("a")), a=["x", "0-306-40615-2"])
    assert (both["isbn13"], both["isbn10"]) == ("9780306406157", "0306406152")
    moved = one(spark, isbn.repaired(F.col("a"), F.col("b")), a="0306406152", b="080442957X")
    assert (moved["isbn13"], moved["isbn10"]) == ("9780306406157", "0306406152")


@pytest.mark.parametrize("raw, day, year", [("2024", None, 2024), ("March 3, 2024", "2024-03-03", 2024), ("2024-02-30", None, 2024), ("forthcoming", None, None), (None, None, None), ("3 Mar 2024", "2024-03-03", 2024)])
def test_partial_dates(spark, raw, day, year):
    d = one(spark, dates.parse_date(F.col("a")), a=raw)
    assert (str(d["date"]) if d["date"] else None, d["year"]) == (day, year)


def test_guard(spark):
    d = one(spark, dates.guarded(dates.parse_date(F.col("a")), 2026), a="1200-01-01")
    assert d["date"] is None and d["year"] is None


def test_urls(spark):
    assert one(spark, urls.registrable(urls.host(F.col("a"))), a="https://shop.books.example.com:81/x") == "example.com"
    assert one(spark, urls.authority(F.col("a")), a="https://A.example:81/x") == "a.example:81"
    assert one(spark, urls.host(F.col("a")), a="no url") is None
    kind = urls.link_kind(F.col("a"), F.col("b"), ["twitter.com"])
    assert one(spark, kind, a="https://twitter.com/x", b="https://a.example") == "social"
    assert one(spark, urls.social_profiles(F.col("a")), a="see https://x.com/hale_m and https://www.instagram.com/hale.m") == {"twitter": "https://x.com/hale_m", "instagram": "https://www.instagram.com/hale.m"}
    assert one(spark, urls.slug_words(F.col("a")), a="https://a.example/b/the-quiet_sea.html") == "the quiet sea"


def test_numbers(spark):
    assert one(spark, text.parse_count(F.col("a")), a="1,234 reviews") == 1234
    assert one(spark, text.to_number(F.col("a")), a="$23.54") == 23.54
    assert one(spark, text.TRANSFORMS["int"](F.col("a")), a="about 1,200 pages") == 1200
