"""Queries of sources and page extraction: responses and pages are landed from the columns of raw_book, read back by the
sources, and compared with SQL over the same columns. Every row of raw_book is landed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import clean_text
from quillon.operators import crawlplan
from quillon.plans.catalogue_queries import _clean, _isbn, _to13
from quillon.session import table
from quillon.sources import api, html, landing, pageparts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- landed responses -------------------------------------------------------------------------------------------

_SPLIT = f"WITH n AS (SELECT *, {_isbn('isbn13')} AS a, {_isbn('isbn10')} AS b FROM raw_book), m AS (SELECT *, CASE WHEN length(a) = 10 THEN a WHEN length(b) = 10 THEN b END AS ten, CASE WHEN length(a) = 13 THEN a WHEN length(b) = 13 THEN b END AS thirteen FROM n), s AS (SELECT * EXCLUDE (isbn13, isbn10), coalesce(thirteen, {_to13('ten')}) AS isbn13 FROM m)"
_N_AUTHORS = "coalesce(len(authors), 0)"


def _responses(spark: SparkSession, sf: str, schema: str, item: Callable[[], Column], wrap: Callable[[Column], Column]) -> DataFrame:
    """One response per row of raw_book, as text and parsed again by the source's schema."""
    rows = table(spark, sf, "raw_book").select(F.to_json(wrap(F.array(item()))).alias("j"))
    return rows.select(F.from_json("j", schema).alias("r")).select("r.*")


def _names() -> Column:
    return F.transform(F.coalesce("authors", F.array().cast(api.AUTHOR.join(("array<", ">")))), lambda a: a["name"])


def _isbns() -> Column:
    return F.filter(F.array("isbn13", "isbn10"), lambda x: x.isNotNull())


@query(f"{_SPLIT} SELECT '/works/' || raw_id AS external_id, {_clean('title')} AS title, isbn13, {_clean('publisher')} AS publisher, language, page_count, ratings_count, average_rating, {_N_AUTHORS} AS n_authors, least(coalesce(len(categories), 0), 12) AS n_categories FROM s")
def open_library_books(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda: F.struct(F.concat(F.lit("/works/"), F.col("raw_id").cast("string")).alias("key"), "title", _names().alias("author_name"), _isbns().alias("isbn"), F.array("publisher").alias("publisher"), F.array("language").alias("language"), F.col("page_count").alias("number_of_pages_median"), F.col("categories").alias("subject"), "ratings_count", F.col("average_rating").alias("ratings_average"))
    books = api.open_library(_responses(spark, sf, api.OPEN_LIBRARY, item, lambda x: F.struct(x.alias("docs"))))
    return books.select("external_id", "title", "isbn13", "publisher", "language", "page_count", "ratings_count", "average_rating", F.size("authors").alias("n_authors"), F.size("categories").alias("n_categories"))


@query(f"{_SPLIT} SELECT raw_id::VARCHAR AS external_id, {_clean('title')} AS title, {_clean('description')} AS description, isbn13, published_date, page_count, ratings_count, average_rating, url, {_N_AUTHORS} AS n_authors FROM s")
def google_books_volumes(spark: SparkSession, sf: str) -> DataFrame:
    info = lambda: F.struct("title", _names().alias("authors"), F.col("published_date").alias("publishedDate"), "description", F.transform(_isbns(), lambda x: F.struct(x.alias("identifier"))).alias("industryIdentifiers"), F.col("page_count").alias("pageCount"), F.col("average_rating").alias("averageRating"), F.col("ratings_count").alias("ratingsCount"), F.col("url").alias("canonicalVolumeLink"))
    item = lambda: F.struct(F.col("raw_id").cast("string").alias("id"), info().alias("volumeInfo"))
    books = api.google_books(_responses(spark, sf, api.GOOGLE_BOOKS, item, lambda x: F.struct(x.alias("items"))))
    return books.select("external_id", "title", "description", "isbn13", "published_date", "page_count", "ratings_count", "average_rating", "url", F.size("authors").alias("n_authors"))


@query(f"{_SPLIT} SELECT raw_id::VARCHAR AS external_id, url, {_clean('title')} AS title, {_clean('description')} AS description, isbn13, year(fetched_at) || '-' || month(fetched_at) AS published_date, coalesce(len(list_filter(authors, lambda x: trim(coalesce(x.name, '')) <> '')), 0) AS n_authors FROM s")
def crossref_works(spark: SparkSession, sf: str) -> DataFrame:
    people = lambda: F.transform(_names(), lambda n: F.struct(n.alias("family")))
    dates = lambda: F.struct(F.array(F.array(F.year("fetched_at"), F.month("fetched_at"))).alias("date-parts"))
    item = lambda: F.struct(F.col("raw_id").cast("string").alias("DOI"), F.col("url").alias("URL"), F.array("title").alias("title"), _isbns().alias("ISBN"), people().alias("author"), F.col("description").alias("abstract"), dates().alias("issued"))
    books = api.crossref(_responses(spark, sf, api.CROSSREF, item, lambda x: F.struct(F.struct(x.alias("items")).alias("message"))))
    return books.select("external_id", "url", "title", "description", "isbn13", "published_date", F.size("authors").alias("n_authors"))


@query(f"SELECT raw_id::VARCHAR AS external_id, coalesce(nullif(url, ''), raw_id::VARCHAR) AS url, {_clean('title')} AS title, {_clean('publisher')} AS publisher, year(fetched_at)::VARCHAR AS published_date, ratings_count, coalesce(len(list_filter(authors, lambda x: x.name <> '')), 0) AS n_authors FROM raw_book")
def open_alex_works(spark: SparkSession, sf: str) -> DataFrame:
    people = lambda: F.transform(_names(), lambda n: F.struct(F.struct(n.alias("display_name")).alias("author")))
    place = lambda: F.struct(F.col("url").alias("landing_page_url"), F.struct(F.col("publisher").alias("display_name")).alias("source"))
    item = lambda: F.struct(F.col("raw_id").cast("string").alias("id"), "title", F.year("fetched_at").alias("publication_year"), F.col("ratings_count").alias("cited_by_count"), people().alias("authorships"), place().alias("primary_location"))
    books = api.open_alex(_responses(spark, sf, api.OPEN_ALEX, item, lambda x: F.struct(x.alias("results"))))
    return books.select("external_id", "url", "title", "publisher", "published_date", "ratings_count", F.size("authors").alias("n_authors"))


@query("SELECT sha256(url) AS key, max(fetched_at) AS stored_at, count(*) AS copies FROM raw_book WHERE url IS NOT NULL GROUP BY url HAVING max(fetched_at) >= TIMESTAMP '2026-01-01' - INTERVAL 2000 HOUR")
def fresh_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_book").where("url is not null").select("url", F.lit(200).alias("status"), F.col("fetched_at").alias("stored_at"))
    rows = rows.withColumn("key", landing.landing_key(F.col("url")))
    copies = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("copies"))
    return landing.fresh(rows, "2026-01-01", 2000).join(copies, F.col("key") == F.col("k")).select("key", "stored_at", "copies")


# --- landed pages -----------------------------------------------------------------------------------------------


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.coalesce(x, F.lit(""))


def _pages(spark: SparkSession, sf: str, *parts: str | Column) -> DataFrame:
    """(url, html): a page for each row of raw_book. The columns t, p, i, a are its title, publisher, ISBN and first
    author, cleaned and escaped; id is the raw_id as text."""
    rows = table(spark, sf, "raw_book").select("raw_id", F.col("raw_id").cast("string").alias("id"), "ratings_count", "page_count", "source_id", _escaped(clean_text(F.col("title"))).alias("t"), _escaped(clean_text(F.col("publisher"))).alias("p"), F.when(F.col("isbn13").rlike("^97[89][0-9]{10}$"), F.col("isbn13")).otherwise("").alias("i"), _escaped(clean_text(F.try_element_at("authors", F.lit(1))["name"])).alias("a"))
    body = F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return rows.select(F.concat(F.lit("https://books.example/item/"), "id").alias("url"), body.alias("html"))


_URL = "'https://books.example/item/' || raw_id"
_T, _P = f"coalesce({_clean('title')}, '')", f"nullif({_clean('publisher')}, '')"
_I = "CASE WHEN regexp_matches(isbn13, '^97[89][0-9]{10}$') THEN isbn13 END"
_A = f"nullif(coalesce({_clean('authors[1].name')}, ''), '')"


@query(f"SELECT {_URL} AS page, 'json-ld' AS how, 'Book Hall' AS site, {_T} AS title, {_P} AS publisher, {_I} AS isbn13, page_count, nullif(ratings_count, 0) AS ratings_count FROM raw_book WHERE {_T} <> ''")
def json_ld_books(spark: SparkSession, sf: str) -> DataFrame:
    """Books of pages with schema.org scripts: a graph that also names the site, with a trailing comma."""
    rows = table(spark, sf, "raw_book").select(F.concat(F.lit("https://books.example/item/"), F.col("raw_id").cast("string")).alias("url"), F.struct(F.lit("Book").alias("@type"), clean_text(F.col("title")).alias("name"), F.when(F.col("isbn13").rlike("^97[89][0-9]{10}$"), F.col("isbn13")).alias("isbn"), F.struct(F.lit("Organization").alias("@type"), clean_text(F.col("publisher")).alias("name")).alias("publisher"), F.col("page_count").alias("numberOfPages"), F.struct(F.col("ratings_count").alias("ratingCount")).alias("aggregateRating")).alias("b"))
    ld = F.concat(F.lit('<html><script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "Book Hall"}, '), F.replace(F.to_json("b"), F.lit("</"), F.lit("<\\/")), F.lit(",]}</script><body>"))
    return html.structured_books(rows.select("url", ld.alias("html"))).select("page", "how", "site", "title", "publisher", "isbn13", "page_count", "ratings_count")


@query(f"SELECT {_URL} AS page, 'meta' AS how, {_T} AS title, {_P} AS publisher, {_I} AS isbn13, {_A} AS author FROM raw_book WHERE {_T} <> ''")
def meta_books(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf, '<meta property="og:type" content="book"><meta property="og:title" content="', F.col("t"), '"><meta name="citation_publisher" content="', F.col("p"), '"><meta property="book:isbn" content="', F.col("i"), '"><meta property="book:author" content="', F.col("a"), '">')
    return html.structured_books(pages).select("page", "how", "title", "publisher", "isbn13", F.try_element_at("authors", F.lit(1)).alias("author"))


@query(f"SELECT {_URL} AS page, {_T} AS title, {_I} AS isbn13, raw_id::INT AS page_count FROM raw_book WHERE {_T} <> ''")
def microdata_books(spark: SparkSession, sf: str) -> DataFrame:
    """Items keep their own values: the shop's name is no title."""
    pages = _pages(spark, sf, '<div itemscope itemtype="https://schema.org/Store"><span itemprop="name">Book Hall</span></div><div itemscope itemtype="https://schema.org/Book"><h1 itemprop="name">', F.col("t"), '</h1><meta itemprop="author" content="Somebody"><meta itemprop="isbn" content="', F.col("i"), '"><b itemprop="numberOfPages">', F.col("id"), "</b></div>")
    return html.structured_books(pages).select("page", "title", "isbn13", "page_count")


@query(f"SELECT {_URL} AS page, 'Volume ' || raw_id AS title, {_I} AS isbn13, 'Ann Raymond; Bo Lindqvist' AS authors FROM raw_book")
def card_books(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of listings without any markup, beside the page's furniture; a second sighting without authors is dropped."""
    pages = _pages(spark, sf, '<nav class="book-item"><h3>Volume menu</h3><p>by Ann Raymond</p></nav><div class="book-card"><h3>Volume ', F.col("id"), '</h3><p class="author">by Ann Raymond and Bo Lindqvist</p><p>', F.col("i"), '</p></div><div class="book-card"><h3>Volume ', F.col("id"), "</h3><p>$9.99</p></div>")
    return html.cards_of_pages(pages).select("page", "title", "isbn13", F.array_join("authors", "; ").alias("authors"))


@query(f"SELECT {_URL} AS url, 'no title' AS reason, '' AS text FROM raw_book UNION ALL SELECT {_URL}, 'neither author nor ISBN nor price', 'Volume ' || raw_id FROM raw_book")
def rejected_cards(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf, '<div class="card"></div><div class="card"><h3>Volume ', F.col("id"), "</h3></div>")
    return html.cards_of_pages(pages, explain=True).select("url", "reason", "text")


_RECIPE = """
source_id: hall
links: a.more
items: div.row
url_contains: /item/
item_fields:
  price: {css: .price}
  publisher: {css: .house}
fields:
  title: {css: h1, transforms: [clean]}
  isbn13: {css: .isbn, regex: "([0-9-]{13,17})", transforms: [isbn]}
  page_count: {css: .pages, transforms: [int]}
  authors: {css: .by, byline: true, many: true}
  language: {const: en}
"""


@query(f"SELECT {_URL} AS url, {_T} AS title, {_I} AS isbn13, page_count, 'en' AS language, '$' || raw_id AS price, CASE WHEN {_P} IS NULL THEN NULL ELSE {_P} END AS publisher, 'Ann Raymond; Bo Lindqvist' AS authors FROM raw_book WHERE {_T} <> ''")
def recipe_books(spark: SparkSession, sf: str) -> DataFrame:
    """A declarative crawl: listing pages name details and some fields, which are joined with the landed details."""
    details = _pages(spark, sf, "<h1>", F.col("t"), "</h1><p class='by'>by Ann Raymond and Bo Lindqvist</p><p class='isbn'>ISBN: ", F.col("i"), "</p><p class='pages'>", F.col("page_count"), " pages</p>")
    rows = table(spark, sf, "raw_book").select("raw_id", "source_id", F.concat(F.lit('<div class="row"><a class="more" href="/item/'), F.col("raw_id").cast("string"), F.lit('#top">more</a><a class="more" href="/item/x">other</a><i class="price">$'), F.col("raw_id").cast("string"), F.lit('</i><i class="house">'), _escaped(clean_text(F.col("publisher"))), F.lit("</i></div>")).alias("row"))
    # a hundred rows or so a listing page, as sites have
    listings = rows.groupBy("source_id", F.floor(F.col("raw_id") / 1000).alias("n")).agg(F.array_join(F.collect_list("row"), "").alias("html")).select(F.concat(F.lit("https://books.example/list/"), "source_id", F.lit("/"), F.col("n").cast("string")).alias("url"), "html")
    books = html.crawl_recipe(details.unionByName(listings), html.Recipe.load(_RECIPE), listings.select("url"))
    return books.select("url", "title", "isbn13", "page_count", "language", "price", "publisher", F.array_join("authors", "; ").alias("authors"))


@query(f"SELECT {_URL} AS url, 2 AS books, {_URL} || '?page=2' AS next_url FROM raw_book")
def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf, '<a href="/books/', F.col("id"), '">x</a><a href="/books/', F.col("id"), '#reviews">same</a><a href="/title/b', F.col("id"), '">y</a><a href="https://else.example/books/1">z</a><a href="/about">about</a><a href="?page=2">nächste Seite »</a>')
    return pageparts.listing_survey(pages)


@query(f"SELECT {_URL} AS url, 'https://books.example/author/' || raw_id AS link FROM raw_book")
def author_page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pageparts.author_links(_pages(spark, sf, '<a href="/author/', F.col("id"), '">A</a><a href="/author/', F.col("id"), '?tab=books#x">A</a><a href="/cart">c</a>'))


@query(f"SELECT {_URL} AS url, 'ann' || raw_id || '@ray.example; info@books.example' AS emails, 'https://x.com/ann_' || raw_id AS twitter, 'https://www.instagram.com/ann' || raw_id AS instagram, '+4930' || (1000000 + raw_id) AS phones, (4917000000000 + raw_id)::VARCHAR AS whatsapp FROM raw_book")
def page_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of mailto links first; a shared inbox counts only on the page's own domain."""
    pages = _pages(spark, sf, "<p>Write to info@books.example or info@shop.example. Phone +49 30 ", F.col("raw_id") + 1000000, ', ISBN 9780306406157, 2001-2002</p><a href="mailto:Ann', F.col("id"), '@ray.example?subject=x">mail</a><a href="https://x.com/ann_', F.col("id"), '?s=1">x</a><a href="https://x.com/share">s</a><a href="https://www.instagram.com/ann', F.col("id"), '/">i</a> <a href="https://wa.me/', F.col("raw_id") + 4917000000000, '">chat</a>')
    found = html.contacts_of_pages(pages)
    text = pageparts.visible_text(pages).select(F.col("url").alias("u"), pageparts.phones(F.col("text")).alias("phones"))
    chat = pages.select(F.col("url").alias("u2"), pageparts.whatsapp(F.col("html")).alias("whatsapp"))
    joined = found.join(text, F.col("url") == F.col("u")).join(chat, F.col("url") == F.col("u2"))
    return joined.select("url", F.array_join("emails", "; ").alias("emails"), F.col("socials")["twitter"].alias("twitter"), F.col("socials")["instagram"].alias("instagram"), F.array_join("phones", "; ").alias("phones"), F.array_join("whatsapp", "; ").alias("whatsapp"))


@query(f"SELECT {_URL} AS url, 'https://books.example/contact-us; https://books.example/about' AS contact_urls FROM raw_book")
def contact_pages(spark: SparkSession, sf: str) -> DataFrame:
    ranked = pageparts.contact_pages(_pages(spark, sf, '<a href="/about">About us</a><a href="/contact-us">Contact</a><a href="https://else.example/contact">Contact</a><a href="/cart">Cart ', F.col("id"), "</a>"))
    return ranked.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "contact_url"))), lambda x: x["contact_url"]), "; ").alias("contact_urls"))


@query(f"SELECT {_URL} AS url, raw_id AS ratings, page_count::BIGINT AS reviews, raw_id + 5 AS voters, raw_id + 4 AS views, raw_id + 3 AS want_to_read, raw_id + 2 AS currently_reading, raw_id + 1 AS editions FROM raw_book")
def reader_statistics(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda x: F.format_number(x, 0)
    pages = _pages(spark, sf, number(F.col("raw_id")), " ratings · ", number(F.col("page_count")), " reviews, ", number(F.col("raw_id") + 5), " voters, ", number(F.col("raw_id") + 4), " views, ", number(F.col("raw_id") + 3), " people want to read, ", number(F.col("raw_id") + 2), " currently reading, ", number(F.col("raw_id") + 1), " editions")
    return pages.select("url", html.statistics(F.col("html")).alias("s")).select("url", "s.*")


@query(f"SELECT {_URL} AS url, {_P} AS publisher, raw_id::VARCHAR AS pages, coalesce({_I}, 'none') AS isbn FROM raw_book")
def labelled_details(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf, "<dl><dt>Publisher:</dt><dd>", F.col("p"), "</dd></dl><table><tr><th>Pages</th><td>", F.col("id"), "</td></tr></table><ul><li>ISBN: ", F.when(F.col("i") == "", "none").otherwise(F.col("i")), "</li><li>Pages: 1</li></ul>")
    return html.labelled_fields(pages).select("url", F.col("fields")["publisher"].alias("publisher"), F.col("fields")["pages"].alias("pages"), F.col("fields")["isbn"].alias("isbn"))


_LONG = "It kept me reading until the lamp went out and the whole house was asleep at last."


@query(f"SELECT {_URL} AS url, 2 AS n, 'Volume ' || raw_id || '. {_LONG}' AS first FROM raw_book")
def page_reviews(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf, '<div class="reviews"><div class="review">Volume ', F.col("id"), f'. {_LONG}</div><div class="review">Volume ', F.col("id"), f'. {_LONG} Again.</div><div class="review">Another reader. {_LONG}</div><div class="review">Short.</div></div>')
    return html.community_reviews(pages).select("url", F.size("reviews").alias("n"), F.try_element_at("reviews", F.lit(1)).alias("first"))


@query("SELECT 'https://books.example/author/' || raw_id AS url, 'Margaret Halebrook' AS name, 'Born in Pellin ' || raw_id AS bio, raw_id AS books, 'Pellin' AS born FROM raw_book")
def author_page_profiles(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf, "<h1>Margaret Halebrook</h1><div class='bio'>Born in Pellin ", F.col("id"), "</div><dl><dt>Born</dt><dd>Pellin</dd></dl><p>", F.col("id"), " books</p>")
    pages = pages.select(F.replace("url", F.lit("/item/"), F.lit("/author/")).alias("url"), "html")
    return html.author_pages(pages).select("url", "name", "bio", "books", F.col("fields")["born"].alias("born"))


@query(f"SELECT {_URL} AS url, 'She lives in Pellin ' || raw_id AS bio, 'https://ray.example/' || raw_id AS website, 'ann' || raw_id || '@ray.example' AS email FROM raw_book")
def author_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return pageparts.author_blocks(_pages(spark, sf, '<a href="https://shop.example">shop</a><div class="about-the-author"><p>She lives in Pellin ', F.col("id"), '</p><a href="/author/1">page</a><a href="https://ray.example/', F.col("id"), '">site</a><a href="mailto:Ann', F.col("id"), '@ray.example">m</a></div>'))


@query(f"SELECT {_URL} AS url, CASE WHEN page_count > 300 THEN 'Hall of ' || source_id ELSE 'Book Hall' END AS site_name FROM raw_book")
def site_names(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("page_count") > 300, F.concat(F.lit('<meta property="og:site_name" content="Hall of '), "source_id", F.lit('">'))).otherwise("")
    return pageparts.site_names(_pages(spark, sf, "<title>Volume ", F.col("id"), " - Book Hall</title>", named))


@query(f"SELECT {_URL} AS url, 'Book Hall; Alder Books' AS shops, 'https://books.example/editions/' || raw_id AS editions FROM raw_book")
def shop_links(spark: SparkSession, sf: str) -> DataFrame:
    shops = spark.createDataFrame([("books.example", "Book Hall"), ("alder.example", "Alder Books")], "domain string, name string")
    found = pageparts.shop_links(_pages(spark, sf, '<a href="https://www.alder.example/b">buy</a><a href="https://alder.example/c">buy</a><a href="/editions/', F.col("id"), '">All editions</a><a href="https://none.example">x</a>'), shops)
    return found.select("url", F.array_join("shops", "; ").alias("shops"), "editions")


@query(f"SELECT {_URL} AS url, coalesce(page_count > 200, false) AS bookish FROM raw_book")
def bookish_pages(spark: SparkSession, sf: str) -> DataFrame:
    links = F.when(F.col("page_count") > 200, F.concat(F.lit('<a href="/book/'), "id", F.lit('">a</a><a href="/book/b'), "id", F.lit('">b</a>'))).otherwise('<a href="/cart">cart</a>')
    return pageparts.bookish_pages(_pages(spark, sf, links))


_RULES = [("publisher", r"\bour imprint|we publish\b", 0.9), ("shop", r"add to (?:cart|basket)", 0.6)]


@query(f"SELECT {_URL} AS url, CASE WHEN page_count > 300 THEN 'publisher' WHEN page_count > 100 THEN 'shop' ELSE 'community_listed' END AS category, CASE WHEN page_count > 300 THEN 0.9 WHEN page_count > 100 THEN 0.6 ELSE 0.4 END::DOUBLE AS weight FROM raw_book")
def page_classes(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("page_count") > 300, "Add to cart. We publish books.").when(F.col("page_count") > 100, "Add to basket").otherwise("Hello")
    pages = pageparts.visible_text(_pages(spark, sf, "<p>", said, "</p>"))
    return pages.select("url", html.classify(F.col("text"), _RULES).alias("c")).select("url", "c.category", "c.weight")


@query("SELECT DISTINCT 'https://' || source_id || '.example/item/' || raw_id AS url FROM raw_book")
def sitemap_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A sitemap index of one sitemap per source and thousand ids; addresses outside /item/ are left out."""
    loc = lambda x: F.concat(F.lit("<url><loc> "), x, F.lit(" </loc></url>"))
    rows = table(spark, sf, "raw_book").select("source_id", F.floor(F.col("raw_id") / 1000).alias("n"), loc(F.concat(F.lit("https://"), "source_id", F.lit(".example/item/"), F.col("raw_id").cast("string"))).alias("x"))
    maps = rows.groupBy("source_id", "n").agg(F.concat(F.array_join(F.collect_list("x"), ""), F.lit("<url><loc>https://a.example/help</loc></url>")).alias("xml"))
    maps = maps.select(F.concat(F.lit("https://"), "source_id", F.lit(".example/map"), F.col("n").cast("string"), F.lit(".xml")).alias("url"), "xml", "source_id")
    index = maps.groupBy("source_id").agg(F.array_join(F.collect_list(loc(F.col("url"))), "").alias("xml")).select(F.concat(F.lit("https://"), "source_id", F.lit(".example/sitemap.xml")).alias("url"), "xml")
    both = maps.select("url", "xml").unionByName(index)
    return html.crawl_sitemap(both, "/item/")


# --- replays of a crawl -----------------------------------------------------------------------------------------


@query("SELECT raw_id, source_id <> 'x' AND (page_count IS NULL OR page_count <= 300) AS allowed, CASE WHEN page_count > 100 THEN 4.0 END::DOUBLE AS crawl_delay, CASE WHEN page_count > 100 THEN 0.25 ELSE 0.5 END::DOUBLE AS rate FROM raw_book")
def robots_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Landed robots files of three kinds of hosts, one of which answers 404."""
    kind = F.when(F.col("page_count") > 300, "shut").when(F.col("page_count") > 100, "slow").otherwise("gone")
    requests = table(spark, sf, "raw_book").select("raw_id", F.concat(F.lit("https://"), kind, F.lit(".example/item/"), F.col("raw_id").cast("string")).alias("url"))
    robots = spark.createDataFrame([("https://shut.example", 200, "User-agent: *\nDisallow: /item/\nCrawl-delay: 4"), ("https://slow.example", 200, "User-agent: *\nCrawl-delay: 4"), ("https://gone.example", 404, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    judged = crawlplan.robots_verdicts(requests, robots, "url", "reader")
    return judged.select("raw_id", "allowed", "crawl_delay", crawlplan.request_rate(F.lit(0.5), F.lit(None).cast("double"), F.col("crawl_delay")).alias("rate"))


@query("SELECT raw_id, CASE WHEN page_count IS NULL THEN pow(2, raw_id % 4) WHEN page_count > 400 THEN coalesce(try_cast(language AS DOUBLE), pow(2, raw_id % 4)) END::DOUBLE AS wait FROM raw_book")
def retry_waits(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("page_count") > 400, 503).when(F.col("page_count").isNotNull(), 200)
    return table(spark, sf, "raw_book").select("raw_id", crawlplan.retry_delay(status, F.col("raw_id") % 4, F.col("language")).alias("wait"))


@query("WITH d AS (SELECT source_id, CASE WHEN isbn13 IS NOT NULL THEN 'cache' WHEN page_count > 600 THEN 'dead host' WHEN language IS NULL THEN 'denied' ELSE 'fetch' END AS what, title IS NULL AS failed FROM raw_book) SELECT source_id, count(*) FILTER (what = 'fetch') AS requests, count(*) FILTER (what = 'cache') AS cache_hits, count(*) FILTER (what = 'denied') AS denied, count(*) FILTER (what = 'dead host') AS skipped, count(*) FILTER (what = 'fetch' AND failed) AS errors FROM d GROUP BY 1")
def fetch_counters(spark: SparkSession, sf: str) -> DataFrame:
    what = crawlplan.fetch_decision(F.col("isbn13").isNotNull(), F.coalesce(F.col("page_count") > 600, F.lit(False)), F.col("language").isNotNull())
    rows = table(spark, sf, "raw_book").select("source_id", what.alias("what"), F.col("title").isNull().alias("failed"))
    return crawlplan.domain_counters(rows, "source_id", "what", "failed")
