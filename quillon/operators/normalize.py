"""Raw reports of books to normalised ones, as one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.dates import guarded, parse_date
from quillon.functions.isbn import repaired
from quillon.functions.text import block_key, clean_text, normalize_person, normalize_title, null_if_empty, person_block_key
from quillon.session import held

#: Greatest lengths of stored fields.
CAPS = {"title": 500, "subtitle": 500, "publisher": 300, "language": 16, "description": 20_000, "cover_url": 1000, "name": 300, "key": 120, "categories": 20}


def capped(x: Column, n: int) -> Column:
    return null_if_empty(F.substring(x, 1, n))


def normalize_author(a: Column, position: Column) -> Column:
    """The normalised struct of a raw author struct; null if the name has fewer than two characters or folds to nothing.
    A missing website falls back to the author's page at the source."""
    return F.get(_normalized(F.array(a), lambda _: position), F.lit(0))


def _normalized(authors: Column, position) -> Column:
    """An array of normalised structs; each step is a transform of its own, so that no chain of replacements runs twice."""
    named = F.transform(authors, lambda a: F.struct(a.alias("a"), clean_text(a["name"]).alias("n")))
    folded = F.transform(named, lambda x: F.struct(x["a"].alias("a"), x["n"].alias("n"), normalize_person(x["n"]).alias("f")))

    def made(x: Column, i: Column) -> Column:
        a = x["a"]
        out = F.struct(
            F.substring(x["n"], 1, CAPS["name"]).alias("display_name"),
            F.substring(x["f"], 1, CAPS["name"]).alias("normalized_name"),
            F.substring(block_key(x["f"]), 1, CAPS["key"]).alias("dedupe_key"),
            F.coalesce(null_if_empty(a["role"]), F.lit("author")).alias("role"),
            position(i).cast("int").alias("position"),
            clean_text(a["bio"]).alias("bio"),
            F.coalesce(null_if_empty(a["website"]), null_if_empty(a["url"])).alias("website"),
            null_if_empty(F.lower(a["email"])).alias("email"),
            a["url"].alias("source_url"),
        )
        return F.when((F.length(x["n"]) >= 2) & (x["f"] != ""), out)

    return F.transform(folded, made)


def normalize_authors(authors: Column) -> Column:
    """The normalised authors of one report, each normalised name once, the first spelling first."""
    kept = F.filter(_normalized(authors, lambda i: i), lambda a: a.isNotNull())
    # held in a one-element array, the list is computed once however often the inner lambdas look at it
    once = lambda m: F.filter(m, lambda a, i: F.array_position(F.transform(m, lambda z: z["normalized_name"]), a["normalized_name"]) == i + 1)
    return F.get(F.transform(F.array(kept), once), F.lit(0))


def book_dedupe_key(isbn13: Column, title: Column, first_author: Column) -> Column:
    """'isbn:...' where there is an ISBN, else the folded title with the first author's block key."""
    keyed = F.concat(F.lit("t:"), F.substring(normalize_title(title), 1, 80), F.lit("|a:"), F.coalesce(person_block_key(first_author), F.lit("")))
    return F.when(isbn13.isNotNull(), F.concat(F.lit("isbn:"), isbn13)).otherwise(F.substring(keyed, 1, CAPS["key"]))


def normalize_books(raw: DataFrame, as_of_year: int) -> DataFrame:
    """Normalised books of raw reports; untitled reports are dropped. raw_id and fetched_at pass through where present."""
    # one lambda cleans all texts: spelled out per column, the generated code would outgrow a method
    texts = ["title", "subtitle", "publisher", "description"]
    df = raw.select("*", held(F.transform(F.array(*texts), clean_text)).alias("_texts"))
    df = df.select("*", *[F.col("_texts")[i].alias(f"_{c}") for i, c in enumerate(texts)]).where("_title is not null")
    df = df.select("*", repaired(F.col("isbn13"), F.col("isbn10")).alias("_isbn"), normalize_authors(F.col("authors")).alias("_authors"), guarded(parse_date(F.col("published_date")), as_of_year).alias("_date"))
    first = F.try_element_at(F.col("_authors"), F.lit(1))["display_name"]
    passed = [F.col(c) for c in ("raw_id", "fetched_at") if c in raw.columns]
    return df.select(
        *passed,
        F.substring("_title", 1, CAPS["title"]).alias("title"),
        capped(F.col("_subtitle"), CAPS["subtitle"]).alias("subtitle"),
        F.col("_isbn.isbn13").alias("isbn13"),
        F.col("_isbn.isbn10").alias("isbn10"),
        F.col("_date.date").alias("published_on"),
        F.col("_date.year").alias("published_year"),
        capped(F.col("_publisher"), CAPS["publisher"]).alias("publisher"),
        capped(F.col("language"), CAPS["language"]).alias("language"),
        "page_count",
        capped(F.col("_description"), CAPS["description"]).alias("description"),
        capped(F.col("cover_url"), CAPS["cover_url"]).alias("cover_url"),
        F.slice(F.array_distinct(F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: c != "")), 1, CAPS["categories"]).alias("categories"),
        "ratings_count",
        "average_rating",
        F.col("_authors").alias("authors"),
        book_dedupe_key(F.col("_isbn.isbn13"), F.col("_title"), first).alias("dedupe_key"),
        "source_id",
        "external_id",
        "url",
    )


def content_hash(raw: DataFrame, ignored: tuple[str, ...] = ("raw", "raw_id", "fetched_at")) -> Column:
    """SHA-256 of the report's fields in name order, nulls included; equal content gives equal hashes."""
    fields = [F.col(c) for c in sorted(raw.columns) if c not in ignored]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
