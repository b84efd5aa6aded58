"""Queries of leads, exports, record merges and the small tables around a run, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import exporting, leads, merge
from quillon.plans.catalogue_queries import AS_OF, corroboration
from quillon.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Markers in publishers' names are an input of the signals; these stand for them here.
FUNDED, TRADE = ["press", "co."], ["house", "verlag"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- leads ------------------------------------------------------------------------------------------------------

_BASE = """
WITH book AS (SELECT dedupe_key AS book_key, arg_min(title, norm_id) FILTER (title <> '') AS title, arg_min(subtitle, norm_id) FILTER (subtitle <> '') AS subtitle, arg_min(isbn13, norm_id) FILTER (isbn13 <> '') AS isbn13, arg_min(publisher, norm_id) FILTER (publisher <> '') AS publisher,
  arg_min(language, norm_id) FILTER (language <> '') AS language, arg_min(page_count, norm_id) FILTER (page_count <> 0) AS page_count, arg_min(published_on, norm_id) FILTER (published_on IS NOT NULL) AS published_on, arg_min(published_year, norm_id) FILTER (published_year <> 0) AS published_year, max(ratings_count) AS ratings_count
  FROM normalized_book WHERE dedupe_key IS NOT NULL GROUP BY 1),
src AS (SELECT dedupe_key AS book_key, count(DISTINCT source_id) AS n_sources, max(coalesce(trust, 0.5)) AS best_trust FROM normalized_book b LEFT JOIN source_meta m ON m.id = b.source_id GROUP BY 1),
link AS (SELECT DISTINCT unnest(authors).normalized_name AS author_key, dedupe_key AS book_key FROM normalized_book),
told AS (SELECT normalized_name AS author_key, 'email' AS kind, email AS value FROM normalized_author WHERE email IS NOT NULL UNION SELECT normalized_name, 'website', website FROM normalized_author WHERE website IS NOT NULL),
author AS (SELECT normalized_name AS author_key, arg_min(display_name, author_id) AS display_name, arg_min(website, author_id) FILTER (website <> '') AS website FROM normalized_author WHERE normalized_name IS NOT NULL GROUP BY 1),
con AS (SELECT author_key, count(*) AS n_contacts FROM told GROUP BY 1),
cat AS (SELECT author_key, count(*) AS n_books FROM link WHERE author_key IS NOT NULL AND book_key IS NOT NULL GROUP BY 1),
months AS (SELECT *, CASE WHEN published_on IS NOT NULL THEN (2026 - year(published_on)) * 12 + (11 - month(published_on)) ELSE (2026 - published_year) * 12 END AS months FROM book),
has AS (SELECT *, coalesce(trim(publisher), '') = '' AS none_, coalesce(contains(lower(publisher), 'press') OR contains(lower(publisher), 'co.'), false) AS funded, coalesce(contains(lower(publisher), 'house') OR contains(lower(publisher), 'verlag'), false) AS trade FROM months),
sig AS (SELECT author_key, book_key, months,
  CASE WHEN none_ OR funded THEN 1.0 WHEN trade THEN 0.0 ELSE 0.5 END::DOUBLE AS author_funded, CASE WHEN trade THEN 1.0 ELSE 0.0 END::DOUBLE AS trade_published,
  CASE WHEN n_books <= 1 THEN 1.0 WHEN n_books <= 3 THEN 0.6 ELSE 0.1 END::DOUBLE AS small_catalogue, greatest(0.0, 1 - coalesce(ratings_count, 0) / 50.0)::DOUBLE AS low_visibility, least(1.0, coalesce(ratings_count, 0) / 500.0)::DOUBLE AS high_visibility,
  least(1.0, 0.4::DOUBLE * coalesce(n_contacts, 0) + 0.4::DOUBLE * (coalesce(website, '') <> '')::INT)::DOUBLE AS contactable, greatest(0.0, least(1.0, best_trust))::DOUBLE AS source_trust, greatest(0.0, least(1.0, (n_sources - 1) / 2.0))::DOUBLE AS corroborated
  FROM link JOIN cat USING (author_key) JOIN has USING (book_key) JOIN src USING (book_key) LEFT JOIN author USING (author_key) LEFT JOIN con USING (author_key) WHERE author_key IS NOT NULL)"""


def _score_sql(profile: str) -> str:
    horizon, weights = leads.PROFILES[profile]
    recency = f"(CASE WHEN months IS NULL THEN 0.3 WHEN months < 0 THEN 1.0 ELSE greatest(0.0, 1 - months / {horizon}.0) END)::DOUBLE"
    total = " + ".join(f"{w!r}::DOUBLE * {recency if s == 'recency' else s}" for s, w in weights.items())
    return f"floor(100 * (100 * (0.0::DOUBLE + {total}) / {sum(weights.values())!r}::DOUBLE) + 0.5) / 100"


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(links, books, authors, contacts, provenance) of the normalised tables."""
    rows = table(spark, sf, "normalized_book").where("dedupe_key is not null")
    fields = ["title", "subtitle", "isbn13", "publisher", "language", "page_count", "published_on", "published_year"]
    folded = merge.fold_first(rows, "dedupe_key", ["norm_id"], fields).withColumnRenamed("dedupe_key", "book_key")
    most = rows.groupBy(F.col("dedupe_key").alias("book_key")).agg(F.max("ratings_count").alias("ratings_count"))
    origin = corroboration(spark, sf).select(F.col("dedupe_key").alias("book_key"), F.col("sources").alias("n_sources"), "best_trust")
    books = folded.join(most, "book_key").join(origin, "book_key")
    links = rows.select(F.explode("authors.normalized_name").alias("author_key"), F.col("dedupe_key").alias("book_key")).where("author_key is not null").distinct()
    people = table(spark, sf, "normalized_author").where("normalized_name is not null")
    told = people.select(F.col("normalized_name").alias("author_key"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("email", "website")])).alias("c")).select("author_key", "c.*").where("value is not null").distinct()
    counted = told.groupBy("author_key").agg(F.count("*").alias("n_contacts"))
    named = people.groupBy(F.col("normalized_name").alias("author_key")).agg(F.min_by("display_name", "author_id").alias("display_name"), F.min_by("website", F.when(F.col("website") != "", F.col("author_id"))).alias("website"))
    authors = named.join(counted, "author_key", "left").withColumn("has_site", F.coalesce(F.col("website") != "", F.lit(False)))
    provenance = rows.select(F.col("dedupe_key").alias("book_key"), "source_id", "url")
    return links, books, authors, told, provenance


@query(_BASE + "".join(f", {p} AS (SELECT author_key, book_key, '{p}' AS profile, {_score_sql(p)} AS score FROM sig)" for p in leads.PROFILES) + " SELECT *, CASE WHEN score >= 75 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 35 THEN 'C' ELSE 'D' END AS tier FROM (" + " UNION ALL ".join(f"SELECT * FROM {p}" for p in leads.PROFILES) + ")")
def rebuilt_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of an author and a book scored under every profile by all nine signals."""
    links, books, authors, _, _ = _tables(spark, sf)
    every = None
    for p in leads.PROFILES:
        one = exporting.scored_leads(links, books, authors, p, AS_OF, FUNDED, TRADE).select("author_key", "book_key", F.lit(p).alias("profile"), "score", "tier")
        every = one if every is None else every.unionByName(one)
    return every


def _export(spark: SparkSession, sf: str, **how) -> DataFrame:
    links, books, authors, told, provenance = _tables(spark, sf)
    scored = exporting.scored_leads(links, books, authors, "services", AS_OF, FUNDED, TRADE)
    rows = scored.withColumns({"lead_id": F.sha2(F.concat_ws("|", "author_key", "book_key"), 256), "status": F.lit("new"), "notes": F.lit(None).cast("string")})
    blocked = table(spark, sf, "normalized_author").where("role = 'editor'").select(F.lit("author_name").alias("kind"), F.col("display_name").alias("value"))
    mails = told.where("kind = 'email' and value like 'a%'").select(F.lit("email").alias("kind"), "value")
    return exporting.export_rows(rows, authors, told, books.withColumn("categories", F.array().cast("array<string>")), provenance, blocked.unionByName(mails), **how)


_EXPORT = _BASE + f""", scored AS (SELECT author_key, book_key, {_score_sql("services")} AS score FROM sig),
blocked AS (SELECT author_key FROM author WHERE lower(trim(display_name)) IN (SELECT lower(trim(display_name)) FROM normalized_author WHERE role = 'editor') UNION SELECT author_key FROM told WHERE kind = 'email' AND lower(trim(value)) IN (SELECT lower(trim(value)) FROM told WHERE kind = 'email' AND value LIKE 'a%')),
said AS (SELECT author_key, coalesce(string_agg(value, '; ' ORDER BY value) FILTER (kind = 'email'), '') AS author_emails, coalesce(string_agg(kind || '=' || value, '; ' ORDER BY value) FILTER (kind <> 'email'), '') AS author_socials FROM told GROUP BY 1),
prov AS (SELECT dedupe_key AS book_key, string_agg(DISTINCT source_id, '; ' ORDER BY source_id) AS sources, coalesce(string_agg(DISTINCT url, ' | ' ORDER BY url) FILTER (url <> ''), '') AS source_urls FROM normalized_book GROUP BY 1)
SELECT sha256(author_key || '|' || book_key) AS lead_id, score, CASE WHEN score >= 75 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 35 THEN 'C' ELSE 'D' END AS tier, 'new' AS status, display_name AS author_name, coalesce(website, '') AS author_website, coalesce(author_emails, '') AS author_emails, coalesce(author_socials, '') AS author_socials,
  coalesce(title, '') AS book_title, coalesce(subtitle, '') AS book_subtitle, coalesce(isbn13, '') AS isbn13, coalesce(published_on::VARCHAR, '') AS published_on, coalesce(published_year::VARCHAR, '') AS published_year, coalesce(publisher, '') AS publisher, coalesce(language, '') AS language, coalesce(page_count::VARCHAR, '') AS page_count, coalesce(ratings_count::VARCHAR, '') AS ratings_count,
  sources, source_urls FROM scored JOIN author USING (author_key) JOIN book USING (book_key) LEFT JOIN said USING (author_key) LEFT JOIN prov USING (book_key) WHERE author_key NOT IN (SELECT author_key FROM blocked)"""
_SHOWN = ["lead_id", "score", "tier", "status", "author_name", "author_website", "author_emails", "author_socials", "book_title", "book_subtitle", "isbn13", "published_on", "published_year", "publisher", "language", "page_count", "ratings_count", "sources", "source_urls"]


@query(_EXPORT)
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _export(spark, sf).select(*_SHOWN)


@query(f"WITH x AS ({_EXPORT}) SELECT lead_id, score, tier, author_emails FROM x WHERE score >= 40 AND tier IN ('B', 'C') AND (author_emails <> '' OR author_website <> '' OR author_socials <> '') ORDER BY score DESC, lead_id LIMIT 100")
def export_top(spark: SparkSession, sf: str) -> DataFrame:
    """The filters of an export: score, tiers, a way to write to the author; the limit counts what suppression left."""
    return _export(spark, sf, min_score=40.0, tiers=["b", "c"], require_contact=True, limit=100).select("lead_id", "score", "tier", "author_emails")


# --- extracted records ------------------------------------------------------------------------------------------


@query("SELECT raw_id FROM raw_book WHERE ratings_count >= 1 AND language IN ('en', 'eng') AND list_has_any(coalesce(categories, []), ['Poetry', 'Horror', 'Music', 'Biography', 'Law']) AND (coalesce(contains(lower(title), 'the'), false) OR coalesce(contains(lower(publisher), 'the'), false))")
def filtered_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_book").select("raw_id", F.col("ratings_count").alias("priority"), F.col("language").alias("tier"), F.col("categories").alias("channels"), "title", "publisher")
    return exporting.filtered_records(rows, 1, ["en", "eng"], ["Poetry", "Horror", "Music", "Biography", "Law"], False, "The", ["title", "publisher"]).select("raw_id")


@query("""SELECT dedupe_key, count(*) AS records, arg_min(publisher, {'k': source_id, 'n': norm_id}) FILTER (publisher <> '') AS publisher, arg_min(description, {'k': source_id, 'n': norm_id}) FILTER (description <> '') AS description, array_to_string(arg_min(categories, {'k': source_id, 'n': norm_id}) FILTER (len(categories) > 0), '; ') AS categories
FROM normalized_book WHERE source_id IS NOT NULL GROUP BY 1""")
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one key from several extractors in their order; arrays fill only what is empty."""
    rows = table(spark, sf, "normalized_book").where("source_id is not null").select("dedupe_key", "source_id", "norm_id", "publisher", "description", "categories")
    merged = exporting.merged_records(rows, "dedupe_key", ["source_id", "norm_id"], ["publisher", "description"], ["categories"])
    return merged.select("dedupe_key", "records", "publisher", "description", F.array_join("categories", "; ").alias("categories"))


@query("""WITH r AS (SELECT dedupe_key, coalesce(authors[1].normalized_name, '') AS author, norm_id AS seq, publisher, language, year(seen_at) >= 2026 AS late FROM normalized_book WHERE dedupe_key IS NOT NULL),
n AS (SELECT dedupe_key, min(author) AS least_ FROM r WHERE author <> '' GROUP BY 1), f AS (SELECT dedupe_key, coalesce(nullif(author, ''), least_, '') AS author, seq, publisher, language, late FROM r LEFT JOIN n USING (dedupe_key)),
g AS (SELECT dedupe_key, author, late, arg_min(publisher, seq) FILTER (publisher <> '') AS publisher, arg_min(language, seq) FILTER (language <> '') AS language FROM f GROUP BY ALL), a AS (SELECT * FROM g WHERE NOT late), b AS (SELECT * FROM g WHERE late)
SELECT coalesce(a.dedupe_key, b.dedupe_key) AS dedupe_key, coalesce(a.author, b.author) AS author, CASE WHEN a.dedupe_key IS NULL THEN 'added' WHEN (a.publisher IS NULL AND b.publisher IS NOT NULL) OR (a.language IS NULL AND b.language IS NOT NULL) THEN 'enriched' ELSE 'kept' END AS change, coalesce(a.publisher, b.publisher) AS publisher, coalesce(a.language, b.language) AS language
FROM a FULL JOIN b ON a.dedupe_key = b.dedupe_key AND a.author = b.author""")
def saved_records(spark: SparkSession, sf: str) -> DataFrame:
    """A library of the records seen before 2026 after those seen since are saved."""
    rows = table(spark, sf, "normalized_book").where("dedupe_key is not null").select("dedupe_key", F.coalesce(F.try_element_at("authors", F.lit(1))["normalized_name"], F.lit("")).alias("author"), F.col("norm_id").alias("seq"), "publisher", "language", (F.year("seen_at") >= 2026).alias("late"))
    return exporting.saved_records(rows.where("not late"), rows.where("late"), "dedupe_key", "author", ["publisher", "language"])


# --- tables around a run ----------------------------------------------------------------------------------------


@query("WITH a AS (SELECT run_id, record_id AS seq, CASE WHEN url IS NULL THEN 'no address: ' || external_id END AS error FROM raw_record WHERE run_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, error IS NULL ORDER BY seq) AS k FROM a) SELECT run_id, CASE WHEN count(error) = count(*) THEN 'failed' WHEN count(error) > 0 THEN 'partial' ELSE 'success' END AS status, count(*) AS records, count(error) AS errors, coalesce(string_agg(error, '; ' ORDER BY seq) FILTER (k <= 20), '') AS first_errors FROM r GROUP BY 1")
def run_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_record").where("run_id is not null").select("run_id", F.col("record_id").alias("seq"), F.when(F.col("url").isNull(), F.concat(F.lit("no address: "), "external_id")).alias("error"))
    return exporting.run_states(rows)


@query("WITH g AS (SELECT DISTINCT source_id AS id, 'named by a run' AS notes FROM raw_book WHERE source_id IS NOT NULL) SELECT coalesce(m.id, g.id) AS id, name, homepage, coalesce(g.notes, m.notes) AS notes, trust FROM source_meta m FULL JOIN g ON m.id = g.id")
def ensured_sources(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "raw_book").where("source_id is not null").select(F.col("source_id").alias("id")).distinct().withColumn("notes", F.lit("named by a run"))
    known = table(spark, sf, "source_meta").select("id", "name", "homepage", "notes", "trust")
    return exporting.with_sources(known, given, ["notes"])


@query("WITH l AS (SELECT DISTINCT lead_id, status, notes, tier, language FROM lead_row) SELECT lead_id, CASE WHEN tier = 'A' THEN 'contacted' ELSE status END AS status, CASE WHEN tier = 'A' THEN 'call ' || lead_id ELSE notes END AS notes FROM l")
def patched_leads(spark: SparkSession, sf: str) -> DataFrame:
    """An update of leads: an unknown status changes nothing."""
    rows = table(spark, sf, "lead_row").select("lead_id", "status", "notes", "tier", "language").distinct()
    updates = rows.where("tier = 'A'").select("lead_id", F.lit("contacted").alias("status"), F.concat(F.lit("call "), F.col("lead_id").cast("string")).alias("notes"))
    odd = rows.where("tier = 'B'").select("lead_id", F.lit("lost").alias("status"), F.lit(None).cast("string").alias("notes"))
    return exporting.patched(rows, updates.unionByName(odd)).select("lead_id", "status", "notes")


@query("SELECT DISTINCT kind, value FROM (SELECT 'author_name' AS kind, lower(trim(author_name, ' ')) AS value FROM lead_row UNION ALL SELECT 'email', lower(trim(author_emails, ' ')) FROM lead_row) WHERE value <> ''")
def suppression_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lead_row")
    names = rows.select(F.lit("AUTHOR_NAME ").alias("kind"), F.col("author_name").alias("value"))
    return exporting.added_suppression(names, rows.select(F.lit("email").alias("kind"), F.upper("author_emails").alias("value")))


@query("WITH s1 AS (SELECT normalized_name AS k, min(website) AS w FROM normalized_author WHERE website IS NOT NULL GROUP BY 1), s2 AS (SELECT normalized_name AS k, min(bio) AS b FROM normalized_author WHERE bio IS NOT NULL GROUP BY 1), a AS (SELECT DISTINCT normalized_name AS k FROM normalized_author) SELECT k AS author_key, w AS website, b AS bio, (CASE WHEN w IS NOT NULL THEN 0.75 ELSE 0.6 END)::DOUBLE AS confidence, (w IS NOT NULL)::INT + (b IS NOT NULL)::INT AS answered FROM a LEFT JOIN s1 USING (k) LEFT JOIN s2 USING (k) WHERE w IS NOT NULL OR b IS NOT NULL")
def enrichment_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Two enrichers in turn: one that knows websites, one, less sure, that knows biographies."""
    people = table(spark, sf, "normalized_author").select(F.col("normalized_name").alias("author_key"), "website", "bio")
    nothing = F.lit(None).cast("string")
    sites = people.where("website is not null").groupBy("author_key").agg(F.min("website").alias("website")).select("author_key", "website", nothing.alias("bio"), F.lit(0.75).alias("confidence"))
    bios = people.where("bio is not null").groupBy("author_key").agg(F.min("bio").alias("bio")).select("author_key", nothing.alias("website"), "bio", F.lit(0.6).alias("confidence"))
    return exporting.enriched_in_turn(people.select("author_key").distinct(), [sites, bios])
