"""Parts of landed pages beside the books: phones, shops, editions, author blocks, contact pages, what kind of page it is.

All functions take pages (url, html). What needs the tree runs in Arrow batches, the rest is columns over its output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.urls import host, registrable
from quillon.sources.html import Tree, links_of_pages, next_pages, select

_CONTACT_WORDS = [("contact", 0), ("get in touch", 1), ("write to", 1), ("about", 2), ("connect", 3), ("press", 4), ("media", 4)]
_BOOK_PATH = r"(?i)/(?:books?|titles?|isbn|works?|product|dp)/[^/?#]+"


def visible_text(pages: DataFrame) -> DataFrame:
    """(url, text, title, site): a page's visible text, its title and the name it gives its site."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                root = Tree(html or "").root
                title = next((n.text() for n in select(root, "title")), None)
                named = next((n.attrs.get("content") for n in select(root, "meta[property=og:site_name]")), None)
                rows.append((url, root.text(), title, named))
            yield pd.DataFrame(rows, columns=["url", "text", "title", "site"])

    return pages.select("url", "html").mapInPandas(parse, "url string, text string, title string, site string")


def site_names(pages: DataFrame, registry: DataFrame | None = None, max_rows: int = 100_000) -> DataFrame:
    """(url, site_name): the registered name of the page's domain (registry: domain, name), else what the page calls its
    site, else the last part of its title after a dash or a bar."""
    from quillon.session import small

    read = visible_text(pages)
    parts = F.split("title", r"\s+[|\-–—·]\s+")
    own = F.coalesce(F.when(F.length(F.trim("site")) > 0, F.trim("site")), F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))))
    if registry is None:
        return read.select("url", own.alias("site_name"))
    names = registry.select(F.lower("domain").alias("_d"), F.col("name").alias("_n")).dropDuplicates(["_d"])
    return read.join(small(names, max_rows), registrable(host(F.col("url"))) == F.col("_d"), "left").select("url", F.coalesce("_n", own).alias("site_name"))


def phones(text: Column, most: int = 5) -> Column:
    """The distinct telephone numbers of a text as digits with a leading + if it has one: 7 to 15 digits that are neither
    an ISBN nor a year."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^\w+])(\+?\(?\d[\d()\s.\-]{6,20}\d)(?![\w])"), F.lit(1))
    bare = F.transform(found, lambda p: F.concat(F.when(F.startswith(p, F.lit("+")), "+").otherwise(""), F.regexp_replace(p, r"\D", "")))
    digits = lambda p: F.regexp_replace(p, r"\D", "")
    fits = lambda p: F.length(digits(p)).between(7, 15) & ~digits(p).rlike(r"^97[89]\d{10}$") & ~digits(p).rlike(r"^(?:19|20)\d{2}(?:19|20)\d{2}$")
    return F.slice(F.array_distinct(F.filter(bare, fits)), 1, most)


def whatsapp(text: Column, most: int = 3) -> Column:
    """The numbers of WhatsApp links and of numbers labelled so."""
    linked = F.regexp_extract_all(text, F.lit(r"(?i)(?:wa\.me/|whatsapp\.com/send\?phone=)\+?(\d{7,15})"), F.lit(1))
    said = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)whatsapp\s*:?\s*(\+?\d[\d\s\-]{6,18}\d)"), F.lit(1)), lambda p: F.regexp_replace(p, r"\D", ""))
    return F.slice(F.array_distinct(F.filter(F.concat(linked, said), lambda p: F.length(p).between(7, 15))), 1, most)


def book_links(pages: DataFrame) -> DataFrame:
    """(url, link): the record pages a page links to on its own host, each once."""
    links = links_of_pages(pages)
    return links.where((host(F.col("link")) == host(F.col("url"))) & F.col("link").rlike(_BOOK_PATH)).select("url", "link")


def author_links(pages: DataFrame) -> DataFrame:
    """(url, link): one address per author page a page links to: host and path without query."""
    links = links_of_pages(pages).where(F.col("link").rlike(r"(?i)/(?:authors?|writers?|people|profiles?)/[^/?#]+"))
    return links.select("url", F.regexp_extract("link", r"^[^?#]*", 0).alias("link")).distinct()


def listing_survey(pages: DataFrame) -> DataFrame:
    """(url, books, next_url): how many record pages a listing links to, and its next page."""
    counted = book_links(pages).groupBy("url").agg(F.count("*").alias("books"))
    return pages.select("url").distinct().join(counted, "url", "left").join(next_pages(pages), "url", "left").select("url", F.coalesce("books", F.lit(0)).alias("books"), "next_url")


def bookish_pages(pages: DataFrame) -> DataFrame:
    """(url, bookish): whether a page is about books: two explicit record links, or three that mention books, or the
    words of the trade."""
    links = links_of_pages(pages)
    counts = links.groupBy("url").agg(F.count_if(F.col("link").rlike(_BOOK_PATH)).alias("explicit"), F.count_if(F.lower(F.concat("link", F.lit(" "), "text")).rlike(r"\b(?:book|novel|author|isbn|paperback|hardcover)s?\b")).alias("loose"))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:isbn|paperback|hardcover|publisher|author|novel|ebook|bookshop|edition)\b"), F.lit(0))))
    read = visible_text(pages).select("url", words.alias("words"))
    return read.join(counts, "url", "left").select("url", ((F.coalesce("explicit", F.lit(0)) >= 2) | (F.coalesce("loose", F.lit(0)) >= 3) | (F.col("words") >= 3)).alias("bookish"))


def shop_links(pages: DataFrame, shops: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """(url, shops, editions): the names of the shops a page links to, its own first, then in order of appearance, and
    its first link to other editions. shops has (domain, name)."""
    from quillon.session import small

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                rows.append((url, url, 0, ""))
                rows += [(url, urljoin(url or "", n.attrs["href"]), i, n.text()) for i, n in enumerate(select(Tree(html or "").root, "a[href]"), 1)]
            yield pd.DataFrame(rows, columns=["url", "link", "place", "text"])

    links = pages.select("url", "html").mapInPandas(parse, "url string, link string, place int, text string")
    named = small(shops.select(F.lower("domain").alias("_d"), F.col("name").alias("_n")).dropDuplicates(["_d"]), max_rows)
    links = links.join(named, registrable(host(F.col("link"))) == F.col("_d"), "left")
    first = links.where("_n is not null").groupBy("url", "_n").agg(F.min("place").alias("place")).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_n"))), lambda x: x["_n"]).alias("shops"))
    editions = links.where((F.col("place") > 0) & F.lower(F.concat("link", F.lit(" "), "text")).rlike(r"\beditions?\b")).groupBy("url").agg(F.min_by("link", "place").alias("editions"))
    return pages.select("url").distinct().join(first, "url", "left").join(editions, "url", "left").select("url", F.coalesce("shops", F.array().cast("array<string>")).alias("shops"), "editions")


def author_blocks(pages: DataFrame, longest: int = 4000) -> DataFrame:
    """(url, bio, website, email): what a page says in its block about the author; links count only inside it."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                root = Tree(html or "").root
                block = next((n for n in root.walk() if re.search(r"(?i)about[-_ ]?(?:the[-_ ]?)?author|author[-_ ]?(?:bio|info|about)", n.attrs.get("class", "") + " " + n.attrs.get("id", ""))), None)
                if block is None:
                    continue
                hrefs = [urljoin(url or "", n.attrs["href"]) for n in select(block, "a[href]")]
                mail = next((h[7:].split("?")[0].lower() for h in hrefs if h.startswith("mailto:")), None)
                own = re.sub(r"^www\.", "", re.sub(r"^https?://|[/:?#].*$", "", re.sub(r"^(https?://[^/:?#]*).*$", r"\1", url or "")))
                site = next((h for h in hrefs if h.startswith("http") and own not in h), None)
                body = " ".join(n.text() for n in block.walk() if n.tag == "p") or block.text()
                rows.append((url, body[:longest], site, mail))
            yield pd.DataFrame(rows, columns=["url", "bio", "website", "email"])

    return pages.select("url", "html").mapInPandas(parse, "url string, bio string, website string, email string")


def contact_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """(url, contact_url, rank): the links of a page most likely to lead to a contact page on the same domain."""
    links = links_of_pages(pages).where(registrable(host(F.col("link"))) == registrable(host(F.col("url"))))
    said = F.lower(F.concat("text", F.lit(" "), F.regexp_replace("link", r"^https?://[^/]*", "")))
    rank = F.coalesce(*[F.when(F.contains(said, F.lit(w)), r) for w, r in _CONTACT_WORDS])
    best = links.select("url", "link", rank.alias("rank")).where("rank is not null").groupBy("url").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "link"))), 1, most).alias("best"))
    return best.select("url", F.posexplode("best").alias("place", "b")).select("url", F.col("b.link").alias("contact_url"), (F.col("place") + 1).alias("rank"))
