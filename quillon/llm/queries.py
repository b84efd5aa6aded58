"""Queries of the training-data operators, and their SQL where SQL can state them (module sql)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.canonical import mapped
from quillon.llm.matching import linked_units, matched_books, units_of
from quillon.llm.mixing import mixed, text_quality
from quillon.llm.packing import fill_report, packed
from quillon.llm.ranking import combined_ranking, equal_ranking, loadings, top_of_group
from quillon.llm.reading_level import reading_levels
from quillon.llm.sql import SQL as SQL
from quillon.llm.survivor import real_date, real_pages, real_text, survivors
from quillon.llm.thesaurus import CATEGORIES
from quillon.llm.tokens import n_tokens
from quillon.llm.variants import identities, same_name_pairs
from quillon.session import small, table


LEAD_SCORES = {"score": 1, "b_ratings": 1, "b_average": 1}


def _lead_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "lead_row").select("export_id", "lead_id", "raw_id", "score")
    books = table(spark, sf_dir, "raw_book").select("raw_id", F.col("ratings_count").alias("b_ratings"), F.col("average_rating").alias("b_average"))
    return leads.join(books, "raw_id", "left")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = equal_ranking(_lead_scores(spark, sf_dir), "lead_id", "export_id", LEAD_SCORES)
    return top_of_group(ranked, "export_id", "lead_id", 5).select("export_id", "lead_id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lead of every export with its projections on the equal weights and on the plain component; the order of
    an export is by the equal weights, then lead_id."""
    return combined_ranking(_lead_scores(spark, sf_dir), "lead_id", "export_id", LEAD_SCORES)


def p1_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each score weighs in the plain and in the balanced component, and how much of the variance they explain."""
    return loadings(_lead_scores(spark, sf_dir), "lead_id", "export_id", LEAD_SCORES)


def _survivors(spark: SparkSession, sf_dir: str, seen: Column) -> DataFrame:
    books = table(spark, sf_dir, "normalized_book").select("norm_id", "dedupe_key", "publisher", "page_count", "published_on", "source_id", seen.alias("seen"))
    trust = table(spark, sf_dir, "source_meta").select(F.col("id").alias("source"), "trust")
    fields = {"publisher": real_text(F.col("publisher")), "page_count": real_pages(F.col("page_count")), "published_on": real_date(F.col("published_on"))}
    return survivors(books, "dedupe_key", "norm_id", "source_id", "seen", trust, fields)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, F.col("seen_at"))


def p2_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the currency order stands in for times: the times of the first six minutes of every hour, a tenth, are
    hidden. (field_name, cases, kept): the values that must survive, and those that do nevertheless."""
    values = table(spark, sf_dir, "normalized_book").select(F.col("norm_id").alias("i"), F.struct(*[F.col(c).cast("string").alias(c) for c in ("publisher", "page_count", "published_on")]).alias("v"))
    value = F.when(F.col("field_name") == "publisher", F.col("v.publisher")).when(F.col("field_name") == "page_count", F.col("v.page_count")).otherwise(F.col("v.published_on"))
    read = lambda found, out: found.join(values, F.col("norm_id") == F.col("i")).select("dedupe_key", "field_name", value.alias(out))
    true = read(_survivors(spark, sf_dir, F.col("seen_at")), "true_value")
    blind = read(_survivors(spark, sf_dir, F.when(F.minute("seen_at") >= 6, F.col("seen_at"))), "found_value")
    return true.join(blind, ["dedupe_key", "field_name"]).groupBy("field_name").agg(F.count("*").alias("cases"), F.sum((F.col("true_value") == F.col("found_value")).cast("long")).alias("kept"))


def _sized(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *more, n_tokens(F.col("text")).alias("tokens"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of every pack_spec capacity."""
    specs = table(spark, sf_dir, "pack_spec").select("spec_id", F.col("capacity_tokens").alias("capacity"))
    return packed(_sized(spark, sf_dir), specs, "doc_id", "tokens").withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(p8_packed(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    items = documents.select("source", F.col("doc_id").alias("id"), n_tokens(F.col("text")).alias("size"), text_quality(F.col("text")).alias("weight"))
    return mixed(items, table(spark, sf_dir, "mix_target"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their repeat counts, and the shares their sources reach."""
    selection, report = _mix(spark, sf_dir)
    shares = report.select(F.col("mix_id").alias("m"), F.col("source").alias("s"), "target_share", "reached_share")
    joined = selection.join(small(shares, 100_000), (F.col("mix_id") == F.col("m")) & (F.col("source") == F.col("s")))
    return joined.select("mix_id", "source", F.col("id").alias("doc_id"), F.col("size").alias("tokens"), "repeats", "target_share", "reached_share")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    return _mix(spark, sf_dir)[1]


def _raw_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_book").select("raw_id", "source_id", "title", "authors", "isbn13", "isbn10", "publisher")


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return matched_books(_raw_books(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = _books(spark, sf_dir)
    several = members.groupBy("book").agg(F.count_distinct("source").alias("k")).where("k > 1").select("book")
    rows = members.join(several, "book", "left_semi")
    a = rows.select(F.col("id").alias("raw_id_a"), F.col("source").alias("sa"), "book")
    b = rows.select(F.col("id").alias("raw_id_b"), F.col("source").alias("sb"), "book")
    return a.join(b, "book").where("raw_id_a < raw_id_b and not (sa <=> sb)").select("raw_id_a", "raw_id_b")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked units of each book with their confidence, each unit (rows that read alike) by its smallest raw_id."""
    books = _raw_books(spark, sf_dir)
    members, pairs = matched_books(books)
    first = members.groupBy("unit").agg(F.min("id").alias("i"))
    linked = linked_units(members, pairs, units_of(books))
    named = linked.join(first.select(F.col("unit").alias("a"), F.col("i").alias("ia")), "a").join(first.select(F.col("unit").alias("b"), F.col("i").alias("ib")), "b")
    return named.select(F.least("ia", "ib").alias("raw_id_a"), F.greatest("ia", "ib").alias("raw_id_b"), F.round("confidence", 4).alias("confidence"))


def p4_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with a title: its book and its unit, both by their smallest raw_id."""
    members, _ = _books(spark, sf_dir)
    books, first = members.groupBy("book").agg(F.min("id").alias("book_id")), members.groupBy("unit").agg(F.min("id").alias("unit_id"))
    return members.join(books, "book").join(first, "unit").select(F.col("id").alias("raw_id"), "book_id", "unit_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_name_pairs(table(spark, sf_dir, "normalized_author").select("author_id", "display_name"), "author_id", "display_name")


def p5_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling in raw_book.authors with the key of the person or organisation it names."""
    names = table(spark, sf_dir, "raw_book").select(F.explode("authors").alias("a")).select(F.col("a.name").alias("name"))
    return identities(names, "name")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, field_name, item_pos, value, book): the typed publishers and categories; book is the ISBN of the row."""
    books = table(spark, sf_dir, "raw_book").select("raw_id", "publisher", "categories", F.regexp_replace("isbn13", "[^0-9]", "").alias("book"))
    books = books.withColumn("book", F.when(F.length("book") == 13, F.col("book")))
    publishers = books.where("publisher is not null").select("raw_id", F.lit("publisher").alias("field_name"), F.lit(0).alias("item_pos"), F.col("publisher").alias("value"), "book")
    return publishers.unionByName(books.select("raw_id", F.lit("category").alias("field_name"), F.posexplode("categories").alias("item_pos", "value"), "book"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(_typed(spark, sf_dir), "field_name", "value", table(spark, sf_dir, "canon_value"), {"category": CATEGORIES}, learn=("raw_id", "book"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("raw_id", "field_name", "item_pos", "ref_id")


def p7_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values that mean no entry, with how often they occur."""
    return _mapped(spark, sf_dir).where("ref_id = -1 and value is not null").groupBy("field_name", "value").agg(F.count("*").alias("rows"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "level_label").select(F.col("doc_id").alias("id"), F.col("reading_level").alias("level"))
    return reading_levels(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How demanding each source is: documents and mean difficulty by source and level."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return _levels(spark, sf_dir).join(documents, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("documents"), F.round(F.avg("difficulty"), 3).alias("difficulty"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_books": p4_books, "p5_found": p5_found, "p5_identities": p5_identities, "p7_found": p7_found, "p7_misses": p7_misses, "p9_mix": p9_mix, "p9_shares": p9_shares, "p8_packed": p8_packed, "p8_report": p8_report, "p1_found": p1_found, "p1_ranking": p1_ranking, "p1_loadings": p1_loadings, "p2_found": p2_found, "p2_currency": p2_currency, "p10_found": p10_found, "p10_profile": p10_profile}
