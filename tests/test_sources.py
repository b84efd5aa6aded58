import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillon.operators.normalize import normalize_books
from quillon.sources import api, html, landing
from quillon.streaming import ingest as stream


def land(tmp_path, payload):
    path = tmp_path / "r.json"
    path.write_text(json.dumps(payload))
    return str(path)


def test_open_library(spark, tmp_path):
    doc = {"key": "/works/W1", "title": "A <i>Sea</i>", "author_name": ["Ann Ray", "Bo Lind"], "author_key": ["K1"], "isbn": ["0306406152"], "first_publish_year": 1999, "publisher": ["P &amp; Q"], "cover_i": 5, "subject": [str(i) for i in range(20)], "ratings_average": 4.5}
    a, b = api.read_source(spark, "openlibrary", land(tmp_path, {"numFound": 2, "docs": [doc, {"key": "/works/W2", "title": "B"}]})).orderBy("external_id").collect()
    assert (a["title"], a["isbn13"], a["published_date"], a["publisher"], len(a["categories"])) == ("A Sea", "9780306406157", "1999", "P & Q", 12)
    assert [(x["name"], x["external_id"]) for x in a["authors"]] == [("Ann Ray", "K1"), ("Bo Lind", None)]
    assert b["authors"] == [] and b["isbn13"] is None and b["url"] == "https://openlibrary.org/works/W2"


def test_google_books(spark, tmp_path):
    info = {"title": "Sea", "authors": ["Ann Ray"], "publishedDate": "2020-05", "description": "<p>Big</p> sea.", "industryIdentifiers": [{"type": "ISBN_10", "identifier": "0306406152"}], "imageLinks": {"thumbnail": "t"}, "infoLink": "i", "pageCount": 9}
    r = api.read_source(spark, "googlebooks", land(tmp_path, {"totalItems": 1, "items": [{"id": "g", "volumeInfo": info}]})).first()
    assert (r["description"], r["isbn13"], r["url"], r["page_count"], r["cover_url"]) == ("Big sea.", "9780306406157", "i", 9, "t")


def test_crossref(spark, tmp_path):
    item = {"DOI": "d", "URL": "u", "title": ["Sea"], "author": [{"given": "Ann", "family": "Ray", "ORCID": "o", "affiliation": [{"name": "X"}, {"name": "Y"}]}, {"name": "The Guild"}, {}], "issued": {"date-parts": [[2020, 5]]}, "abstract": "<jats:p>Hi</jats:p>"}
    r = api.read_source(spark, "crossref", land(tmp_path, {"message": {"total-results": 1, "items": [item]}})).first()
    assert [(a["name"], a["bio"]) for a in r["authors"]] == [("Ann Ray", "X; Y"), ("The Guild", None)]
    assert (r["published_date"], r["description"]) == ("2020-5", "Hi")


def test_open_alex(spark, tmp_path):
    work = {"id": "w", "doi": "", "display_name": "Sea", "publication_year": 2020, "cited_by_count": 7, "authorships": [{"author": {"id": "a", "display_name": "Ann Ray"}, "institutions": [{"display_name": "U"}]}], "primary_location": {"landing_page_url": "l", "source": {"display_name": "Journal"}}, "concepts": [{"display_name": "C"}, {}]}
    r = api.read_source(spark, "openalex", land(tmp_path, {"results": [work]})).first()
    assert (r["url"], r["published_date"], r["publisher"], r["ratings_count"], r["categories"]) == ("l", "2020", "Journal", 7, ["C"])


def test_unknown_source_and_malformed_response(spark, tmp_path):
    with pytest.raises(ValueError):
        api.read_source(spark, "nowhere", "x")
    (tmp_path / "bad.json").write_text("{not json")
    assert api.read_source(spark, "openalex", str(tmp_path / "bad.json")).count() == 0


LD = """<html><head><script type="application/ld+json">{broken</script><script type="application/ld+json">
{"@graph": [{"@type": "Organization", "name": "Shop"}, {"@type": ["Product", "Book"], "name": "Sea", "author": [{"name": "Ann Ray"}], "isbn": "978-0-306-40615-7", "numberOfPages": "1,200", "aggregateRating": {"ratingValue": "4.5", "ratingCount": "1,234"}, "offers": {"price": "9.99"},}]}
</script></head><body></body></html>"""
META = '<meta property="og:type" content="book"><meta property="og:title" content="Hill"><meta property="book:author" content="Bo Lind">'
SELECT = '<div class="card big"><h2>Gate</h2><p class="by">by Cy Orr and Di Poe</p><a class="buy" href="/b/1#x">more</a><span>ISBN 9780306406157'


def test_pages(spark):
    pages = spark.createDataFrame([("https://a.example/1", LD), ("https://a.example/2", META), ("https://a.example/3", "<p>nothing"), ("https://a.example/1", LD), (None, None)], "url string, html string")
    got = {r["title"]: r for r in html.books_of_pages(pages).collect()}
    assert set(got) == {"Sea", "Hill"}
    assert (got["Sea"]["isbn13"], got["Sea"]["page_count"], got["Sea"]["ratings_count"], got["Sea"]["average_rating"], got["Sea"]["price"]) == ("9780306406157", 1200, 1234, 4.5, "9.99")
    assert got["Hill"]["authors"] == ["Bo Lind"]


def test_recipe(spark):
    recipe = html.Recipe("s", {"title": {"css": "div.card > h2"}, "authors": {"css": ".by", "byline": True, "many": True}, "isbn13": {"css": "span", "regex": r"(\d{13})"}, "publisher": {"const": "P"}, "cover_url": {"css": "a.buy", "attr": "href"}, "language": {"css": "i", "default": "en"}})
    page = spark.createDataFrame([("https://a.example/p", SELECT)], "url string, html string")
    r = html.books_of_pages(page, recipe).first()
    assert (r["title"], r["authors"], r["isbn13"], r["publisher"], r["cover_url"], r["language"]) == ("Gate", ["Cy Orr", "Di Poe"], "9780306406157", "P", "https://a.example/b/1#x", "en")
    assert html.books_of_pages(page, html.Recipe("s", {}, permitted=False)).count() == 0
    with pytest.raises(ValueError):
        html.Recipe("s", {"title": {"xpath": "//h1"}})
    with pytest.raises(ValueError):
        html.Recipe("s", {"title": {"regex": "x"}})


def test_links_and_next_page(spark):
    page = '<a href="/p?page=3">3</a><a href="?page=2">2</a><a href="#top">top</a><a href="/b/1">B</a><a href="https://o.example/n">next</a>'
    pages = spark.createDataFrame([("https://a.example/p", page), ("https://a.example/q", '<link rel="next" href="https://o.example/q2">')], "url string, html string")
    links = {r["link"] for r in html.links_of_pages(pages).where("url like '%/p'").collect()}
    assert links == {"https://a.example/p?page=3", "https://a.example/p?page=2", "https://a.example/b/1", "https://o.example/n"}
    assert {r["url"]: r["next_url"] for r in html.next_pages(pages).collect()} == {"https://a.example/p": "https://a.example/p?page=2", "https://a.example/q": "https://o.example/q2"}


def test_sitemap(spark):
    maps = spark.createDataFrame([("https://a/s.xml", "<loc>https://a/s2.xml</loc><loc> https://a/book/1 </loc><loc>https://a/x</loc>"), ("https://a/s2.xml", "<loc>https://a/book/2?a=1&amp;b=2</loc>")], "url string, xml string")
    assert {r["url"] for r in html.crawl_sitemap(maps, "/book/").collect()} == {"https://a/book/1", "https://a/book/2?a=1&b=2"}


def test_classify_and_statistics(spark):
    df = spark.createDataFrame([("Self-Publish with us: 1,234 ratings, 56 reviews",), (None,)], "t string")
    rules = [("vanity", "self-publish", 0.9), ("review", "review", 0.5)]
    a, b = df.select(html.classify(F.col("t"), rules).alias("c"), html.statistics(F.col("t")).alias("s")).collect()
    assert a["c"]["category"] == "vanity" and (a["s"]["ratings"], a["s"]["reviews"], a["s"]["editions"]) == (1234, 56, None)
    assert b["c"]["category"] == "community_listed"


def test_landing(spark, tmp_path):
    rows = [{"url": "u", "status": 200, "body": "old", "stored_at": "2025-01-01T00:00:00Z"}, {"url": "u", "status": 200, "body": "new", "stored_at": "2025-01-05T00:00:00Z"}, {"url": "v", "status": 500, "body": "x", "stored_at": "2025-01-05T00:00:00Z"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    got = landing.fresh(landing.read_landing(spark, str(tmp_path / "l.json")), "2025-01-07", 168).collect()
    assert [(r["url"], r["body"]) for r in got] == [("u", "new")]


def test_csv_applies_suppression(spark, tmp_path):
    from quillon import sinks

    rows = spark.createDataFrame([(1, "a@x.org", "Ann", ["p", "q"]), (2, "b@y.org", "Bo, \"B\"", None)], "id int, email string, name string, tags array<string>")
    lists = spark.createDataFrame([("email", "a@x.org")], "kind string, value string")
    out = str(tmp_path / "o.csv")
    sinks.write_single_csv(rows, lists, out, ["email"], "name")
    data = open(out, "rb").read()
    assert data.startswith(b"\xef\xbb\xbf") and b"a@x.org" not in data and b'""B""' in data


def test_stream_equals_batch(spark, data, tmp_path):
    books = spark.read.parquet(f"{data}/raw_book.parquet")
    src = str(tmp_path / "in")
    books.where("raw_id % 2 = 0").write.parquet(src)
    run = lambda: stream.ingest(stream.read_reports(spark, src, books.schema), str(tmp_path / "out"), str(tmp_path / "cp"), 2026).awaitTermination()
    run()
    books.where("raw_id % 2 = 1 or raw_id = 2").write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = normalize_books(books, 2026)
    assert got.select("raw_id").distinct().count() == got.count()
    assert got.count() == want.count()
    counts = stream.reports_per_window(spark.createDataFrame([("s", datetime(2025, 1, 1, 5)), ("s", datetime(2025, 1, 1, 9))], "source_id string, fetched_at timestamp"))
    assert counts.first()["reports"] == 2


def test_pages_without_anything(spark):
    """Null and empty pages, and null addresses, give no rows or empty values, never an error."""
    from quillon.sources import pageparts as parts

    pages = spark.createDataFrame([(None, None), ("", ""), ("https://a.example/1", None), ("https://a.example/2", "<p>Nothing"), (None, "<a href=x>y</a>")], "url string, html string")
    shops = spark.createDataFrame([("a.example", "A")], "domain string, name string")
    assert html.structured_books(pages).count() == 0 and html.crawl_recipe(pages, html.Recipe.load("source_id: x")).count() == 0
    assert parts.author_blocks(pages).count() == 0 and parts.contact_pages(pages).count() == 0 and parts.author_links(pages).count() == 0
    assert parts.site_names(pages).where("site_name is not null").count() == 0 and parts.bookish_pages(pages).where("bookish").count() == 0
    assert {tuple(r["shops"]) for r in parts.shop_links(pages, shops).collect()} == {(), ("A",)}
    assert parts.listing_survey(pages).where("books > 0").count() == 0


def test_microdata_items_keep_their_own_values():
    root = html.Tree('<div itemscope itemtype="Store"><b itemprop="name">Shop</b></div><div itemscope><i itemprop="name">Sea</i><i itemprop="isbn">9780306406157</i></div>').root
    assert [b["title"] for b in html.from_microdata(root)] == ["Sea"] and html.from_meta(root)["title"] == "Sea"


def test_recipe_details_and_listing_fields(spark):
    recipe = html.Recipe.load("{source_id: s, items: li, links: a, item_fields: {title: {css: b}}, fields: {publisher: {css: .p, transforms: [strip, upper]}}}")
    pages = spark.createDataFrame([("https://a.example/", '<li><a href="/1">x</a><b>Sea</b></li><li><a href="/2">x</a><b>Hill</b></li><li><a href="/3">x</a><b>Gone</b></li>'), ("https://a.example/1", '<p class="p"> hall </p>'), ("https://a.example/2", "<h1>Other</h1>")], "url string, html string")
    got = {r["url"]: (r["title"], r["publisher"]) for r in html.crawl_recipe(pages, recipe, pages.limit(1)).collect()}
    assert got == {"https://a.example/1": ("Sea", "HALL"), "https://a.example/2": ("Hill", None)}
    assert html.crawl_recipe(pages, html.Recipe("s", {}, permitted=False)).count() == 0
    with pytest.raises(ValueError):
        html.Recipe.load("fields: {}")


def test_addresses_of_a_numbered_listing():
    assert html.listing_addresses("https://a.example/?p={page}", 2, 3, 3) == ["https://a.example/?p=2", "https://a.example/?p=5", "https://a.example/?p=8"]
    assert html.listing_addresses("https://a.example/") == ["https://a.example/"]


def test_numbers_beyond_int_leave_the_other_fields(spark):
    item = '<div itemscope itemtype="https://schema.org/Store"><b itemprop="name">Shop</b></div><div itemscope><i itemprop="name">{}</i><i itemprop="author">Ann</i><i itemprop="numberOfPages">{}</i></div>'
    counts = {"a": str(2**31 - 1), "b": str(2**31), "c": str(10**30), "d": "9" * 400 + " pages", "e": "212 pages", "f": "many"}
    pages = spark.createDataFrame([(f"https://a.example/{t}", item.format(t, n)) for t, n in counts.items()], "url string, html string")
    got = {r["title"]: (r["page_count"], r["authors"]) for r in html.structured_books(pages).collect()}
    assert got == {t: (n, ["Ann"]) for t, n in {"a": 2**31 - 1, "b": None, "c": None, "d": None, "e": 212, "f": None}.items()}
    ld = '<script type="application/ld+json">{"@type": "Book", "name": "Sea", "aggregateRating": {"ratingCount": 3000000000, "ratingValue": 4.5}}</script>'
    books = html.books_of_pages(spark.createDataFrame([("https://a.example/", ld)], "url string, html string")).collect()
    assert [(b["title"], b["ratings_count"], b["average_rating"]) for b in books] == [("Sea", None, 4.5)]
