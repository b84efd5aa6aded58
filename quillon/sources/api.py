"""Landed search responses of four public bibliographic APIs as raw books.

Responses lie as JSON files (one response per line or per file); nothing is fetched. Schemas are explicit, so the scan
infers nothing and reads only the fields used; malformed lines come out as nulls and drop out at the explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.isbn import split_isbns
from quillon.functions.text import clean_text, null_if_empty

AUTHOR = "struct<name:string,role:string,url:string,bio:string,email:string,website:string,socials:map<string,string>,external_id:string>"
FIELDS = ["source_id", "external_id", "url", "title", "subtitle", "authors", "isbn13", "isbn10", "published_date", "publisher", "language", "page_count", "description", "cover_url", "categories", "ratings_count", "average_rating", "raw"]

OPEN_LIBRARY = "numFound int, start int, docs array<struct<key:string,title:string,subtitle:string,author_name:array<string>,author_key:array<string>,isbn:array<string>,first_publish_year:int,publisher:array<string>,language:array<string>,number_of_pages_median:int,cover_i:bigint,subject:array<string>,ratings_count:int,ratings_average:double>>"
GOOGLE_BOOKS = "totalItems int, items array<struct<id:string,volumeInfo:struct<title:string,subtitle:string,authors:array<string>,publisher:string,publishedDate:string,description:string,industryIdentifiers:array<struct<type:string,identifier:string>>,pageCount:int,categories:array<string>,averageRating:double,ratingsCount:int,imageLinks:struct<thumbnail:string>,language:string,infoLink:string,canonicalVolumeLink:string>>>"
CROSSREF = "message struct<`total-results`:int,items:array<struct<DOI:string,URL:string,title:array<string>,subtitle:array<string>,ISBN:array<string>,author:array<struct<given:string,family:string,name:string,ORCID:string,affiliation:array<struct<name:string>>>>,publisher:string,language:string,abstract:string,subject:array<string>,issued:struct<`date-parts`:array<array<int>>>>>>"
OPEN_ALEX = "results array<struct<id:string,doi:string,title:string,display_name:string,publication_date:string,publication_year:int,language:string,cited_by_count:int,authorships:array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string>>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string,host_organization_name:string>>,concepts:array<struct<display_name:string>>>>"


def author(name: Column, url: Column | None = None, bio: Column | None = None, external_id: Column | None = None) -> Column:
    nil = lambda kind="string": F.lit(None).cast(kind)
    pick = lambda x: nil() if x is None else x
    return F.struct(name.alias("name"), F.lit("author").alias("role"), pick(url).alias("url"), pick(bio).alias("bio"), nil().alias("email"), nil().alias("website"), nil("map<string,string>").alias("socials"), pick(external_id).alias("external_id"))


def _first(x: Column) -> Column:
    return F.try_element_at(x, F.lit(1))


def _books(df: DataFrame, source_id: str, **columns: Column) -> DataFrame:
    kinds = {"authors": f"array<{AUTHOR}>", "page_count": "int", "ratings_count": "int", "average_rating": "double", "categories": "array<string>"}
    given = {"source_id": F.lit(source_id)} | columns
    return df.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FIELDS])


def open_library(responses: DataFrame) -> DataFrame:
    """Parallel lists of author names and keys are zipped by place; missing keys leave the link null."""
    d = responses.select(F.explode("docs").alias("d"))
    names, keys = F.coalesce("d.author_name", F.array().cast("array<string>")), F.col("d.author_key")
    key = lambda i: F.get(keys, i)
    authors = F.transform(names, lambda n, i: author(n, F.concat(F.lit("https://openlibrary.org/authors/"), key(i)), None, key(i)))
    isbn = split_isbns(F.col("d.isbn"))
    return _books(
        d, "openlibrary", external_id=F.col("d.key"), url=F.when(F.length("d.key") > 0, F.concat(F.lit("https://openlibrary.org"), F.col("d.key"))),
        title=clean_text(F.col("d.title")), subtitle=clean_text(F.col("d.subtitle")), authors=authors, isbn13=isbn["isbn13"], isbn10=isbn["isbn10"],
        published_date=F.when(F.col("d.first_publish_year") != 0, F.col("d.first_publish_year").cast("string")), publisher=clean_text(_first(F.col("d.publisher"))), language=_first(F.col("d.language")),
        page_count=F.col("d.number_of_pages_median"), cover_url=F.when(F.col("d.cover_i") != 0, F.concat(F.lit("https://covers.openlibrary.org/b/id/"), F.col("d.cover_i").cast("string"), F.lit("-L.jpg"))),
        categories=F.slice(F.coalesce("d.subject", F.array().cast("array<string>")), 1, 12), ratings_count=F.col("d.ratings_count"), average_rating=F.col("d.ratings_average"), raw=F.to_json("d"),
    )


def google_books(responses: DataFrame) -> DataFrame:
    d = responses.select(F.explode("items").alias("d")).select(F.col("d.id").alias("id"), F.col("d.volumeInfo").alias("v"), F.to_json("d").alias("raw_"))
    isbn = split_isbns(F.transform("v.industryIdentifiers", lambda x: x["identifier"]))
    return _books(
        d, "googlebooks", external_id=F.col("id"), url=F.coalesce(null_if_empty(F.col("v.infoLink")), F.col("v.canonicalVolumeLink")), title=clean_text(F.col("v.title")), subtitle=clean_text(F.col("v.subtitle")),
        authors=F.transform(F.coalesce("v.authors", F.array().cast("array<string>")), lambda n: author(n)), isbn13=isbn["isbn13"], isbn10=isbn["isbn10"], published_date=F.col("v.publishedDate"), publisher=clean_text(F.col("v.publisher")),
        language=F.col("v.language"), page_count=F.col("v.pageCount"), description=clean_text(F.col("v.description")), cover_url=F.col("v.imageLinks.thumbnail"), categories=F.coalesce("v.categories", F.array().cast("array<string>")),
        ratings_count=F.col("v.ratingsCount"), average_rating=F.col("v.averageRating"), raw=F.col("raw_"),
    )


def crossref(responses: DataFrame) -> DataFrame:
    """Given and family name, else the name of an organisation; affiliations make the bio; date parts join with dashes."""
    d = responses.select(F.explode("message.items").alias("d"))
    full = lambda a: F.coalesce(null_if_empty(F.trim(F.concat_ws(" ", null_if_empty(a["given"]), null_if_empty(a["family"])))), null_if_empty(a["name"]))
    bio = lambda a: null_if_empty(F.array_join(F.filter(F.transform(a["affiliation"], lambda x: x["name"]), lambda x: F.length(x) > 0), "; "))
    people = F.filter(F.transform(F.coalesce("d.author", F.array()), lambda a: author(full(a), a["ORCID"], bio(a), a["ORCID"])), lambda a: a["name"].isNotNull())
    isbn = split_isbns(F.col("d.ISBN"))
    parts = F.filter(F.get(F.col("d.issued.`date-parts`"), F.lit(0)), lambda x: x.isNotNull())
    return _books(
        d, "crossref", external_id=F.col("d.DOI"), url=F.col("d.URL"), title=clean_text(_first(F.col("d.title"))), subtitle=clean_text(_first(F.col("d.subtitle"))), authors=people, isbn13=isbn["isbn13"], isbn10=isbn["isbn10"],
        published_date=null_if_empty(F.array_join(F.transform(parts, lambda x: x.cast("string")), "-")), publisher=clean_text(F.col("d.publisher")), language=F.col("d.language"), description=clean_text(F.col("d.abstract")),
        categories=F.coalesce("d.subject", F.array().cast("array<string>")), raw=F.to_json("d"),
    )


def open_alex(responses: DataFrame) -> DataFrame:
    """Citations stand in for ratings, as this source has none; the venue's name stands in for a missing publisher."""
    d = responses.select(F.explode("results").alias("d"))
    names = lambda xs: F.filter(F.transform(xs, lambda x: x["display_name"]), lambda x: F.length(x) > 0)
    people = F.transform(F.coalesce("d.authorships", F.array()), lambda a: author(a["author"]["display_name"], F.coalesce(null_if_empty(a["author"]["orcid"]), a["author"]["id"]), null_if_empty(F.array_join(names(a["institutions"]), "; ")), a["author"]["id"]))
    venue = F.col("d.primary_location.source")
    return _books(
        d, "openalex", external_id=F.col("d.id"), url=F.coalesce(null_if_empty(F.col("d.doi")), null_if_empty(F.col("d.primary_location.landing_page_url")), F.col("d.id")), title=clean_text(F.coalesce(null_if_empty(F.col("d.display_name")), F.col("d.title"))),
        authors=F.filter(people, lambda a: F.length(a["name"]) > 0), published_date=F.coalesce(null_if_empty(F.col("d.publication_date")), F.col("d.publication_year").cast("string")), publisher=clean_text(F.coalesce(null_if_empty(venue["host_organization_name"]), venue["display_name"])),
        language=F.col("d.language"), categories=F.slice(names(F.coalesce("d.concepts", F.array())), 1, 12), ratings_count=F.col("d.cited_by_count"), raw=F.to_json("d"),
    )


REGISTRY: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "openlibrary": (OPEN_LIBRARY, open_library),
    "googlebooks": (GOOGLE_BOOKS, google_books),
    "crossref": (CROSSREF, crossref),
    "openalex": (OPEN_ALEX, open_alex),
}


def read_source(spark: SparkSession, source_id: str, path: str, multi_line: bool = True) -> DataFrame:
    """Raw books of one source's landed responses. An unknown source is an error before anything is planned."""
    if source_id not in REGISTRY:
        raise ValueError(f"unknown source {source_id!r}; known: {', '.join(sorted(REGISTRY))}")
    schema, to_books = REGISTRY[source_id]
    return to_books(spark.read.schema(schema).option("multiLine", multi_line).json(path))


def untitled_dropped(books: DataFrame) -> DataFrame:
    return books.where(F.length("title") > 0)
