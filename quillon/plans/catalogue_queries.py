"""Queries of the catalogue operators over the project's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import dates, isbn, text, urls
from quillon.operators import crawlplan, enrich, leads, merge, normalize, resolve
from quillon.session import small, table

AS_OF = (2026, 11)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL spellings of the scalar functions, written out for DuckDB.
_WS = "[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"


def _fold(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '{_WS}+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _clean(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&amp;", "&"), ("&#39;", "''"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"trim(regexp_replace({t}, '{_WS}+', ' ', 'g'))"
    t = f"regexp_replace({t}, ' +([.,;:!?%)\\]}}])', '\\1', 'g')"
    return f"nullif(regexp_replace({t}, '([(\\[{{]) +', '\\1', 'g'), '')"


def _title(x: str) -> str:
    return f"regexp_replace({_fold(x)}, '^(?:the|an|a) ', '')"


def _person(x: str) -> str:
    t = f"trim(regexp_replace(strip_accents({x}), '{_WS}+', ' ', 'g'))"
    t = f"regexp_replace({t}, '(?i),?\\s*\\b(?:phd|ph\\.d|md|m\\.d|jr|sr|ii|iii|iv|esq|mba|dds)\\b\\.?$', '')"
    t = f"lower(CASE WHEN instr({t}, ',') > 0 THEN trim(substr({t}, instr({t}, ',') + 1)) || ' ' || trim(left({t}, instr({t}, ',') - 1)) ELSE {t} END)"
    t = f"regexp_replace({t}, '\\b(?:dr|mr|mrs|ms|prof|professor|sir|dame)\\b\\.?', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _isbn(x: str) -> str:
    d = f"upper(regexp_replace({x}, '[^0-9Xx]', '', 'g'))"
    return f"CASE WHEN regexp_matches({d}, '^[0-9]{{13}}$') OR length({d}) = 10 THEN {d} END"


def _to13(x: str) -> str:
    total = " + ".join(f"try_cast(substr('978' || {x}, {i + 1}, 1) AS INT) * {1 if i % 2 == 0 else 3}" for i in range(12))
    return f"CASE WHEN regexp_matches({x}, '^[0-9]{{9}}.$') THEN '978' || left({x}, 9) || ((10 - ({total}) % 10) % 10) END"


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scalar functions -------------------------------------------------------------------------------------------


@query(f"SELECT raw_id, {_clean('title')} AS clean_title, {_clean('description')} AS clean_description FROM raw_book")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_book").select("raw_id", text.clean_text(F.col("title")).alias("clean_title"), text.clean_text(F.col("description")).alias("clean_description"))


@query(f"SELECT raw_id, {_title('title')} AS title_key, replace({_fold('title')}, ' ', '-') AS slug FROM raw_book")
def title_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_book").select("raw_id", text.normalize_title(F.col("title")).alias("title_key"), text.slugify(F.col("title")).alias("slug"))


@query(f"WITH p AS (SELECT author_id, {_person('display_name')} AS person FROM normalized_author) SELECT author_id, person, CASE WHEN instr(person, ' ') > 0 THEN regexp_extract(person, '([^ ]+)$', 1) || ':' || left(person, 1) ELSE person END AS block_key FROM p")
def person_keys(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("display_name")
    return table(spark, sf, "normalized_author").select("author_id", text.normalize_person(name).alias("person"), text.person_block_key(name).alias("block_key"))


@query(f"WITH n AS (SELECT raw_id, {_isbn('isbn13')} AS a, {_isbn('isbn10')} AS b FROM raw_book), m AS (SELECT raw_id, CASE WHEN length(a) = 10 THEN a WHEN length(b) = 10 THEN b END AS ten, CASE WHEN length(a) = 13 THEN a WHEN length(b) = 13 THEN b END AS thirteen FROM n) SELECT raw_id, coalesce(thirteen, {_to13('ten')}) AS isbn13, ten AS isbn10 FROM m")
def isbn_repair(spark: SparkSession, sf: str) -> DataFrame:
    both = isbn.repaired(F.col("isbn13"), F.col("isbn10"))
    return table(spark, sf, "raw_book").select("raw_id", both.alias("i")).select("raw_id", "i.isbn13", "i.isbn10")


@query("SELECT isbn13, count(*) AS n, " + "(" + " + ".join(f"try_cast(substr(isbn13, {i + 1}, 1) AS INT) * {1 if i % 2 == 0 else 3}" for i in range(13)) + ") % 10 = 0 AS valid FROM normalized_book WHERE length(isbn13) = 13 GROUP BY isbn13")
def isbn_check(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "normalized_book").where("length(isbn13) = 13").groupBy("isbn13").agg(F.count("*").alias("n"))
    return counted.withColumn("valid", isbn.isbn_valid(F.col("isbn13")))


@query(r"""SELECT raw_id, (p).d AS published_on, coalesce(year((p).d), (p).y) AS published_year FROM (
SELECT raw_id, {'d': CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}') THEN try_strptime(left(t, 10), '%Y-%m-%d')
  WHEN regexp_matches(t, '^\d{4}/\d{2}/\d{2}$') THEN try_strptime(t, '%Y/%m/%d')
  WHEN regexp_matches(t, '^[A-Za-z]{4,} \d{1,2}, \d{4}$') THEN try_strptime(t, '%B %d, %Y')
  WHEN regexp_matches(t, '^[A-Za-z]{3} \d{1,2}, \d{4}$') THEN try_strptime(t, '%b %d, %Y')
  WHEN regexp_matches(t, '^\d{1,2} [A-Za-z]{4,} \d{4}$') THEN try_strptime(t, '%d %B %Y')
  WHEN regexp_matches(t, '^\d{1,2} [A-Za-z]{3} \d{4}$') THEN try_strptime(t, '%d %b %Y')
  WHEN regexp_matches(t, '^\d{8}$') THEN try_strptime(t, '%Y%m%d') END::DATE,
  'y': try_cast(regexp_extract(t, '(1[0-9]{3}|20[0-9]{2})', 1) AS INT)} AS p
FROM (SELECT raw_id, trim(published_date, ' ') AS t FROM raw_book))""")
def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    parsed = dates.parse_date(F.col("published_date"))
    return table(spark, sf, "raw_book").select("raw_id", parsed.alias("p")).select("raw_id", F.col("p.date").alias("published_on"), F.col("p.year").alias("published_year"))


@query(r"SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x))).len() AS n_emails FROM documents WHERE text IS NOT NULL")
def email_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(text.extract_emails(F.col("text"))).cast("bigint").alias("n_emails"))


@query(r"SELECT raw_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '([^.]+\.[^.]+)$', 1) AS domain FROM raw_book WHERE url LIKE 'http%'")
def url_domains(spark: SparkSession, sf: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return table(spark, sf, "raw_book").where("url like 'http%'").select("raw_id", h.alias("host"), urls.registrable(h).alias("domain"))


@query(r"""WITH d AS (SELECT author_id, regexp_extract(lower(regexp_extract(website, '^[a-z]+://([^/:?#]+)', 1)), '([^.]+\.[^.]+)$', 1) AS a, regexp_extract(lower(regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1)), '([^.]+\.[^.]+)$', 1) AS b FROM normalized_author WHERE website LIKE 'http%')
SELECT author_id, CASE WHEN a = b THEN 'page' WHEN a IN ('twitter.com', 'facebook.com', 'instagram.com') THEN 'social' ELSE 'website' END AS kind FROM d""")
def link_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kind = urls.link_kind(F.col("website"), F.col("source_url"), ["twitter.com", "facebook.com", "instagram.com"])
    return table(spark, sf, "normalized_author").where("website like 'http%'").select("author_id", kind.alias("kind"))


@query(r"SELECT raw_id, try_cast(regexp_replace(price, '[^0-9.\-]', '', 'g') AS DOUBLE) AS amount, try_cast(regexp_extract(replace(price, ',', ''), '(\d+)', 1) AS BIGINT) AS whole FROM raw_book WHERE price IS NOT NULL")
def numbers_in_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_book").where("price is not null").select("raw_id", text.to_number(F.col("price")).alias("amount"), text.parse_count(F.col("price")).alias("whole"))


@query("SELECT run_id, try_cast(json_extract_string(stats, '$.fetched') AS INT) AS fetched, try_cast(json_extract_string(stats, '$.stored') AS INT) AS stored FROM crawl_run")
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda p: F.get_json_object("stats", p).try_cast("int")
    return table(spark, sf, "crawl_run").select("run_id", at("$.fetched").alias("fetched"), at("$.stored").alias("stored"))


# --- normalisation ----------------------------------------------------------------------------------------------

_BOOKS = f"""
WITH n AS (SELECT *, {_clean('title')} AS t, {_isbn('isbn13')} AS ia, {_isbn('isbn10')} AS ib FROM raw_book),
m AS (SELECT *, CASE WHEN length(ia) = 10 THEN ia WHEN length(ib) = 10 THEN ib END AS ten, CASE WHEN length(ia) = 13 THEN ia WHEN length(ib) = 13 THEN ib END AS thirteen FROM n WHERE t IS NOT NULL),
k AS (SELECT *, coalesce(thirteen, {_to13('ten')}) AS i13 FROM m)
"""


@query(_BOOKS + f"SELECT raw_id, left(t, 500) AS title, i13 AS isbn13, ten AS isbn10, nullif(left({_clean('publisher')}, 300), '') AS publisher, nullif(left(language, 16), '') AS language, nullif(left({_clean('description')}, 20000), '') AS description FROM k")
def normalized_reports(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_books(table(spark, sf, "raw_book"), AS_OF[0]).select("raw_id", "title", "isbn13", "isbn10", "publisher", "language", "description")


@query(
    f"""WITH a AS (SELECT raw_id, unnest(authors) AS a, generate_subscripts(authors, 1) - 1 AS position FROM raw_book),
c AS (SELECT raw_id, position, {_clean('a.name')} AS name FROM a),
p AS (SELECT raw_id, position, left(name, 300) AS display_name, left({_person('name')}, 300) AS normalized_name FROM c WHERE length(name) >= 2)
SELECT raw_id, CAST(position AS INT) AS position, display_name, normalized_name FROM p WHERE normalized_name <> '' QUALIFY row_number() OVER (PARTITION BY raw_id, normalized_name ORDER BY position) = 1"""
)
def normalized_authors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_book").select("raw_id", F.explode(normalize.normalize_authors(F.col("authors"))).alias("a"))
    return rows.select("raw_id", "a.position", "a.display_name", "a.normalized_name")


@query(f"WITH p AS (SELECT norm_id, isbn13, title, authors[1].display_name AS f, {_person('authors[1].display_name')} AS person FROM normalized_book) SELECT norm_id, CASE WHEN isbn13 IS NOT NULL THEN 'isbn:' || isbn13 ELSE left('t:' || left({_title('title')}, 80) || '|a:' || coalesce(CASE WHEN instr(person, ' ') > 0 THEN regexp_extract(person, '([^ ]+)$', 1) || ':' || left(person, 1) ELSE person END, ''), 120) END AS key FROM p")
def dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    first = F.try_element_at("authors", F.lit(1))["display_name"]
    return table(spark, sf, "normalized_book").select("norm_id", normalize.book_dedupe_key(F.col("isbn13"), F.col("title"), first).alias("key"))


@query("SELECT source_id, lower(content_hash) AS content_hash, min(record_id) AS record_id, count(*) AS copies FROM raw_record GROUP BY ALL")
def first_of_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_record").select("source_id", F.lower("content_hash").alias("content_hash"), "record_id")
    return rows.groupBy("source_id", "content_hash").agg(F.min("record_id").alias("record_id"), F.count("*").alias("copies"))


@query("WITH m AS (SELECT median(fetched_at) AS t FROM raw_record), n AS (SELECT * FROM raw_record, m WHERE fetched_at > t), o AS (SELECT * FROM raw_record, m WHERE fetched_at <= t) SELECT record_id FROM n r WHERE NOT EXISTS (SELECT 1 FROM o s WHERE s.source_id = r.source_id AND lower(s.content_hash) = lower(r.content_hash)) QUALIFY row_number() OVER (PARTITION BY source_id, lower(content_hash) ORDER BY record_id) = 1")
def unseen_content(spark: SparkSession, sf: str) -> DataFrame:
    """Content of the later half of all fetches that the earlier half has not brought, once each."""
    rows = table(spark, sf, "raw_record").select("record_id", "source_id", F.lower("content_hash").alias("content_hash"), F.unix_micros("fetched_at").alias("at"))
    middle = F.lit(rows.agg(F.percentile("at", 0.5)).first()[0])
    new, seen = rows.where(F.col("at") > middle), rows.where(F.col("at") <= middle)
    return merge.unseen(new, seen, ["source_id", "content_hash"], ["record_id"]).select("record_id")


@query("SELECT count(*) AS reports, count(DISTINCT r) AS contents FROM (SELECT * EXCLUDE (raw, raw_id, fetched_at) FROM raw_book) r")
def report_contents(spark: SparkSession, sf: str) -> DataFrame:
    """All reports and their different contents."""
    rows = table(spark, sf, "raw_book")
    return rows.agg(F.count("*").alias("reports"), F.count_distinct(normalize.content_hash(rows)).alias("contents"))


# --- folds ------------------------------------------------------------------------------------------------------


@query("""SELECT dedupe_key, arg_min(publisher, norm_id) FILTER (publisher <> '') AS publisher, arg_min(page_count, norm_id) FILTER (page_count <> 0) AS page_count, arg_min(subtitle, norm_id) FILTER (subtitle <> '') AS subtitle, arg_min(language, norm_id) FILTER (language <> '') AS language, arg_min(published_on, norm_id) FILTER (published_on IS NOT NULL) AS published_on FROM normalized_book GROUP BY dedupe_key""")
def fold_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return merge.fold_first(table(spark, sf, "normalized_book"), "dedupe_key", ["norm_id"], ["publisher", "page_count", "subtitle", "language", "published_on"])


@query("""WITH e AS (SELECT dedupe_key, norm_id, unnest(categories) AS v, generate_subscripts(categories, 1) AS p FROM normalized_book), f AS (SELECT dedupe_key, v, min({'n': norm_id, 'p': p}) AS place FROM e WHERE v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY place, v) AS k FROM f) SELECT dedupe_key, string_agg(v, '; ' ORDER BY k) AS categories FROM r WHERE k <= 30 GROUP BY 1""")
def fold_categories(spark: SparkSession, sf: str) -> DataFrame:
    folded = merge.fold_arrays(table(spark, sf, "normalized_book"), "dedupe_key", ["norm_id"], "categories")
    return folded.select("dedupe_key", F.array_join("categories", "; ").alias("categories"))


@query("""WITH b AS (SELECT *, coalesce(ratings_count, 0) AS c, max(coalesce(ratings_count, 0)) OVER (PARTITION BY dedupe_key ORDER BY norm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM normalized_book)
SELECT dedupe_key, max(ratings_count) AS ratings_count, coalesce(arg_max(average_rating, norm_id) FILTER (average_rating IS NOT NULL AND (before IS NULL OR c > before)), arg_min(average_rating, norm_id) FILTER (average_rating IS NOT NULL)) AS average_rating FROM b GROUP BY 1""")
def fold_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return merge.fold_ratings(table(spark, sf, "normalized_book"), "dedupe_key", ["norm_id"])


@query("SELECT dedupe_key, source_id, min(norm_id) AS norm_id, arg_min(url, norm_id) AS url FROM normalized_book GROUP BY ALL")
def first_provenance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalized_book").select("dedupe_key", "source_id", "norm_id", "url")
    return merge.first_per_key(rows, ["dedupe_key", "source_id"], ["norm_id"]).select("dedupe_key", "source_id", "norm_id", "url")


@query("""WITH o AS (SELECT DISTINCT lead_id, score, status FROM lead_row WHERE tier <> 'A'), n AS (SELECT DISTINCT lead_id, score + 1 AS score, 'new' AS status FROM lead_row WHERE tier IN ('A', 'B'))
SELECT coalesce(n.lead_id, o.lead_id) AS lead_id, CASE WHEN n.lead_id IS NOT NULL THEN n.score ELSE o.score END AS score, coalesce(o.status, n.status) AS status FROM o FULL JOIN n ON o.lead_id = n.lead_id""")
def lead_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All leads: those of tier A are new, those of B are scored anew, the others stay."""
    rows = table(spark, sf, "lead_row").select("lead_id", "score", "status", "tier").distinct()
    new = rows.where("tier in ('A', 'B')").select("lead_id", (F.col("score") + 1).alias("score"), F.lit("new").alias("status"))
    return merge.upsert(rows.where("tier <> 'A'").select("lead_id", "score", "status"), new, ["lead_id"], ["score"], ["status"])


# --- aggregates and joins ---------------------------------------------------------------------------------------


@query("WITH a AS (SELECT DISTINCT dedupe_key AS book, unnest(authors).normalized_name AS author FROM normalized_book) SELECT author, count(*) AS books FROM a WHERE author IS NOT NULL GROUP BY 1")
def books_per_author(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalized_book").select(F.col("dedupe_key").alias("book"), F.explode("authors").alias("a")).select("book", F.col("a.normalized_name").alias("author")).distinct()
    return rows.where("author is not null").groupBy("author").agg(F.count("*").alias("books"))


@query("WITH c AS (SELECT normalized_name, 'email' AS kind, email AS v FROM normalized_author UNION SELECT normalized_name, 'website', website FROM normalized_author) SELECT normalized_name, count(*) AS contacts FROM c WHERE v IS NOT NULL GROUP BY 1")
def contacts_per_author(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("email", "website")]))
    rows = table(spark, sf, "normalized_author").select("normalized_name", kinds.alias("c")).select("normalized_name", "c.kind", "c.v").where("v is not null").distinct()
    return rows.groupBy("normalized_name").agg(F.count("*").alias("contacts"))


@query("SELECT dedupe_key, count(DISTINCT source_id) AS sources, max(coalesce(trust, 0.5)) AS best_trust, string_agg(DISTINCT source_id, '; ' ORDER BY source_id) AS source_list FROM normalized_book b LEFT JOIN source_meta m ON m.id = b.source_id GROUP BY 1")
def corroboration(spark: SparkSession, sf: str) -> DataFrame:
    meta = small(table(spark, sf, "source_meta").select(F.col("id").alias("source_id"), "trust"), 100_000)
    rows = table(spark, sf, "normalized_book").select("dedupe_key", "source_id").join(meta, "source_id", "left")
    return rows.groupBy("dedupe_key").agg(F.count_distinct("source_id").alias("sources"), F.max(F.coalesce("trust", F.lit(0.5))).alias("best_trust"), F.array_join(F.sort_array(F.collect_set("source_id")), "; ").alias("source_list"))


@query("SELECT author_id FROM normalized_author a WHERE NOT EXISTS (SELECT 1 FROM normalized_author b WHERE b.normalized_name = a.normalized_name AND (b.email IS NOT NULL OR b.website IS NOT NULL))")
def authors_without_contacts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalized_author")
    have = rows.where("email is not null or website is not null").select("normalized_name").distinct()
    return rows.join(have, "normalized_name", "left_anti").select("author_id")


@query("SELECT status, tier, count(*) AS n, coalesce(floor(sum(round(score * 100)::BIGINT)::DOUBLE / count(score) + 0.5) / 100, 0) AS mean_score FROM (SELECT DISTINCT lead_id, status, tier, score FROM lead_row) GROUP BY ALL")
def lead_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lead_row").select("lead_id", "status", "tier", "score").distinct()
    return rows.groupBy("status", "tier").agg(F.count("*").alias("n"), F.coalesce(F.floor(F.sum(F.round(F.col("score") * 100).cast("bigint")).cast("double") / F.count("score") + F.lit(0.5)) / 100, F.lit(0.0)).alias("mean_score"))


@query("SELECT t.tier, count(l.lead_id) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(tier) LEFT JOIN lead_row l ON l.tier = t.tier GROUP BY 1")
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return leads.counts_with_zeros(table(spark, sf, "lead_row"), "tier", ["A", "B", "C", "D", "E"])


@query("SELECT trim(s) AS source, count(*) AS n FROM (SELECT unnest(string_split(sources, ';')) AS s FROM lead_row) WHERE trim(s) <> '' GROUP BY 1")
def leads_by_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lead_row").select(F.explode(F.split("sources", ";")).alias("s")).select(F.trim("s").alias("source"))
    return rows.where("source <> ''").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT count(*) AS leads, count(*) FILTER (author_emails <> '') AS with_email, count(*) FILTER (author_emails <> '' OR author_website <> '' OR author_socials <> '') AS reachable FROM lead_row")
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    some = F.col("author_emails") != ""
    rows = table(spark, sf, "lead_row")
    return rows.agg(F.count("*").alias("leads"), F.count_if(some).alias("with_email"), F.count_if(some | (F.col("author_website") != "") | (F.col("author_socials") != "")).alias("reachable"))


_LISTED = "WITH s AS (SELECT DISTINCT lower(author_emails) AS e FROM lead_row WHERE author_emails <> '' AND status = 'contacted'), d AS (SELECT DISTINCT regexp_extract(lower(author_emails), '@(.*)$', 1) AS e FROM lead_row WHERE author_emails <> '' AND tier = 'A'), a AS (SELECT DISTINCT lower(trim(author_name)) AS e FROM lead_row WHERE language = 'fr')"
_REASON = "CASE WHEN lower(author_emails) IN (SELECT e FROM s) THEN 'email' WHEN regexp_extract(lower(author_emails), '@(.*)$', 1) IN (SELECT e FROM d) THEN 'domain' WHEN lower(trim(author_name)) IN (SELECT e FROM a) THEN 'author_name' END"


def _suppression_list(rows: DataFrame) -> DataFrame:
    """Addresses of contacted leads, domains of those of tier A, names of authors of French books."""
    some = rows.where("author_emails <> ''")
    lists = some.where("status = 'contacted'").select(F.lit("email").alias("kind"), F.col("author_emails").alias("value"))
    lists = lists.unionByName(some.where("tier = 'A'").select(F.lit("domain").alias("kind"), F.concat(F.lit("@"), F.regexp_extract("author_emails", "@(.*)$", 1)).alias("value")))
    return lists.unionByName(rows.where("language = 'fr'").select(F.lit("author_name").alias("kind"), F.col("author_name").alias("value")))


@query(f"{_LISTED} SELECT lead_id, {_REASON} AS suppression_reason FROM (SELECT DISTINCT lead_id, author_emails, author_name FROM lead_row)")
def suppression(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lead_row").select("lead_id", "author_emails", "author_name", "status", "tier", "language")
    distinct = rows.select("lead_id", "author_emails", "author_name").distinct()
    return leads.suppressed(distinct, _suppression_list(rows), ["author_emails"], "author_name").select("lead_id", "suppression_reason")


@query(f"{_LISTED} SELECT DISTINCT lead_id, score FROM lead_row WHERE score >= 50 AND tier IN ('A', 'B', 'C') AND ({_REASON}) IS NULL ORDER BY score DESC, lead_id LIMIT 50")
def top_leads(spark: SparkSession, sf: str) -> DataFrame:
    """The best fifty leads, counted after suppression."""
    rows = table(spark, sf, "lead_row").select("lead_id", "score", "author_emails", "author_name", "status", "tier", "language")
    asked = rows.where((F.col("score") >= 50) & F.col("tier").isin("A", "B", "C"))
    left = leads.suppressed(asked, _suppression_list(rows), ["author_emails"], "author_name").where("suppression_reason is null")
    return left.select("lead_id", "score").distinct().orderBy(F.desc("score"), "lead_id").limit(50)


_SIGNALS = """
WITH t AS (SELECT dedupe_key, count(DISTINCT source_id) AS n_sources, max(coalesce(trust, 0.5)) AS trust FROM normalized_book b LEFT JOIN source_meta m ON m.id = b.source_id GROUP BY 1),
b AS (SELECT norm_id, dedupe_key, published_on, published_year, ratings_count FROM normalized_book),
c AS (SELECT b.*, n_sources, trust,
  CASE WHEN published_on IS NOT NULL THEN (2026 - year(published_on)) * 12 + (11 - month(published_on)) ELSE (2026 - published_year) * 12 END AS months FROM b JOIN t USING (dedupe_key)),
s AS (SELECT norm_id,
  CASE WHEN months IS NULL THEN 0.3 WHEN months < 0 THEN 1.0 ELSE greatest(0.0, 1 - months / 60.0) END::DOUBLE AS recency,
  least(1.0, coalesce(ratings_count, 0) / 500.0)::DOUBLE AS high_visibility,
  greatest(0.0, least(1.0, (n_sources - 1) / 2.0))::DOUBLE AS corroborated,
  greatest(0.0, least(1.0, trust))::DOUBLE AS source_trust FROM c)
"""


def _signals(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    rows = table(spark, sf, "normalized_book").select("norm_id", "dedupe_key", "published_on", "published_year", "ratings_count").join(corroboration(spark, sf), "dedupe_key")
    horizon, _ = leads.PROFILES["rights"]
    signals = {
        "recency": leads.recency(F.col("published_on"), F.col("published_year"), AS_OF, horizon),
        "high_visibility": leads.high_visibility(F.col("ratings_count")),
        "corroborated": leads.corroborated(F.col("sources")),
        "source_trust": leads.clamp(F.col("best_trust")),
    }
    return rows, signals


@query(_SIGNALS + "SELECT norm_id, score, CASE WHEN score >= 75 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 35 THEN 'C' ELSE 'D' END AS tier FROM (SELECT norm_id, floor(100 * (100 * (0.34::DOUBLE * high_visibility + 0.22::DOUBLE * 0 + 0.18::DOUBLE * recency + 0.14::DOUBLE * corroborated + 0.07::DOUBLE * source_trust + 0.05::DOUBLE * 0) / 1.0) + 0.5) / 100 AS score FROM s)")
def lead_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows, signals = _signals(spark, sf)
    scored = rows.select("norm_id", leads.weighted_score(signals, leads.PROFILES["rights"][1]).alias("score"))
    return scored.withColumn("tier", leads.tier(F.col("score")))


@query(_SIGNALS + """, l AS (SELECT norm_id, unnest([{'o': 0, 's': 'high_visibility', 'p': floor(100 * (100 * 0.34::DOUBLE * high_visibility) + 0.5) / 100}, {'o': 2, 's': 'recency', 'p': floor(100 * (100 * 0.18::DOUBLE * recency) + 0.5) / 100}, {'o': 3, 's': 'corroborated', 'p': floor(100 * (100 * 0.14::DOUBLE * corroborated) + 0.5) / 100}, {'o': 4, 's': 'source_trust', 'p': floor(100 * (100 * 0.07::DOUBLE * source_trust) + 0.5) / 100}]) AS r FROM s)
SELECT norm_id, string_agg(r.s, ';' ORDER BY r.p DESC, r.o) AS signals FROM l WHERE r.p > 0 GROUP BY 1""")
def lead_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows, signals = _signals(spark, sf)
    listed = rows.select("norm_id", leads.reasons(signals, leads.PROFILES["rights"][1]).alias("r"))
    kept = F.filter("r", lambda x: x["points"] > 0)
    return listed.where(F.size(kept) > 0).select("norm_id", F.array_join(F.transform(kept, lambda x: x["signal"]), ";").alias("signals"))


@query("SELECT coalesce(homepage, name) AS owner, count(*) AS n, string_agg(id, ';' ORDER BY id) AS ids FROM source_meta GROUP BY 1")
def sources_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_meta").groupBy(F.coalesce("homepage", "name").alias("owner")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ";").alias("ids"))


@query("SELECT id, trust FROM source_meta WHERE NOT requires_api_key AND kind IN ('retailer', 'publisher') ORDER BY trust DESC, id")
def source_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "source_meta").where(~F.col("requires_api_key") & F.col("kind").isin("retailer", "publisher"))
    return rows.select("id", "trust").orderBy(F.desc("trust"), "id")


@query(r"WITH h AS (SELECT id, regexp_replace(regexp_extract(homepage, '://([^/]+)', 1), '^www\.', '') AS host FROM source_meta WHERE homepage IS NOT NULL) SELECT raw_id, h.id AS platform FROM raw_book b JOIN h ON regexp_replace(lower(regexp_extract(b.url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') = h.host")
def platform_of_page(spark: SparkSession, sf: str) -> DataFrame:
    bare = lambda c: F.regexp_replace(urls.host(F.col(c)), r"^www\.", "")
    platforms = small(table(spark, sf, "source_meta").where("homepage is not null").select(F.col("id").alias("platform"), bare("homepage").alias("host")), 100_000)
    return table(spark, sf, "raw_book").select("raw_id", bare("url").alias("host")).join(platforms, "host").select("raw_id", "platform")


@query("SELECT DISTINCT a.author_id, b.norm_id FROM normalized_author a JOIN (SELECT norm_id, url, unnest(authors).normalized_name AS name FROM normalized_book) b ON a.source_url = b.url OR a.normalized_name = b.name")
def profile_to_books(spark: SparkSession, sf: str) -> DataFrame:
    """An OR of two equalities as a union of two equi-joins."""
    a = table(spark, sf, "normalized_author").select("author_id", "source_url", "normalized_name")
    b = table(spark, sf, "normalized_book").select("norm_id", "url", F.explode("authors").alias("x")).select("norm_id", "url", F.col("x.normalized_name").alias("name"))
    by_url = a.join(b.select("norm_id", "url").distinct(), F.col("source_url") == F.col("url")).select("author_id", "norm_id")
    by_name = a.join(b.select("norm_id", "name").distinct(), F.col("normalized_name") == F.col("name")).select("author_id", "norm_id")
    return by_url.unionByName(by_name).distinct()


@query("""SELECT r.run_id, r.status, count(c.record_id) AS records, count(DISTINCT c.external_id) AS listings, max(c.fetched_at) AS last_fetched FROM crawl_run r LEFT JOIN raw_record c ON c.run_id = r.run_id GROUP BY ALL""")
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "raw_record").where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("records"), F.count_distinct("external_id").alias("listings"), F.max("fetched_at").alias("last_fetched"))
    runs = table(spark, sf, "crawl_run").select("run_id", "status")
    return runs.join(records, "run_id", "left").na.fill(0, ["records", "listings"])


@query("SELECT run_id, source_id, started_at FROM crawl_run ORDER BY started_at DESC, run_id LIMIT 20")
def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl_run").select("run_id", "source_id", "started_at").orderBy(F.desc("started_at"), "run_id").limit(20)


@query("""WITH f AS (SELECT a.normalized_name AS author_id, u.kind, CASE WHEN u.kind = 'email' THEN lower(trim(u.value)) ELSE trim(u.value) END AS value, b.source_id, coalesce(m.trust, 0.5) AS confidence, a.author_id AS place
  FROM normalized_author a JOIN raw_book b USING (raw_id) LEFT JOIN source_meta m ON m.id = b.source_id, LATERAL (VALUES ('email', a.email), ('website', a.website), ('bio', a.bio)) u(kind, value) WHERE trim(u.value) <> ''),
g AS (SELECT *, left(value, 500) AS v FROM f), s AS (SELECT author_id FROM f GROUP BY 1 HAVING max(confidence) >= 0.55)
SELECT author_id, kind, v AS value, source_id, confidence FROM g SEMI JOIN s USING (author_id)
QUALIFY row_number() OVER (PARTITION BY author_id, kind, CASE WHEN kind = 'email' THEN v ELSE '' END ORDER BY confidence DESC, place, v) = 1""")
def author_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts and biographies of each author with the source that vouches for them."""
    meta = small(table(spark, sf, "source_meta").select(F.col("id").alias("source_id"), "trust"), 100_000)
    books = table(spark, sf, "raw_book").select("raw_id", "source_id").join(meta, "source_id", "left")
    rows = table(spark, sf, "normalized_author").join(books, "raw_id")
    kinds = {k: F.col(k) for k in ("email", "website", "bio")}
    facts = enrich.facts_of(rows, "normalized_name", F.col("source_id"), F.col("source_url"), F.coalesce("trust", F.lit(0.5)), F.col("author_id"), kinds)
    return enrich.merged_facts(facts).select("author_id", "kind", "value", "source_id", "confidence")


@query("""WITH f AS (SELECT normalized_name, max(bio) FILTER (author_id = first) AS bio FROM (SELECT *, min(author_id) FILTER (bio IS NOT NULL AND bio <> '') OVER (PARTITION BY normalized_name) AS first FROM normalized_author) GROUP BY 1)
SELECT author_id, coalesce(nullif(a.bio, ''), f.bio) AS bio FROM normalized_author a JOIN f USING (normalized_name)""")
def filled_biographies(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalized_author").select("author_id", "normalized_name", "bio")
    first = merge.fold_first(rows, "normalized_name", ["author_id"], ["bio"]).select(F.col("normalized_name").alias("author_id"), F.lit("bio").alias("kind"), F.col("bio").alias("value"))
    return enrich.fill_gaps(rows, first.where("value is not null"), ["bio"], "normalized_name").select("author_id", "bio")


# --- crawl replays ----------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT record_id, source_id, epoch_us(fetched_at) / 1e6 AS t, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at, record_id) AS i FROM raw_record)
SELECT record_id, round(max(t - i * 2.0) OVER (PARTITION BY source_id ORDER BY i) + i * 2.0, 3) AS allowed_s FROM o""")
def rate_limit_schedule(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_record").select("record_id", "source_id", "fetched_at")
    return crawlplan.rate_limited(rows, "source_id", "fetched_at", "record_id", 2.0).select("record_id", "allowed_s")


@query("""WITH e AS (SELECT event_id, user_id, event_type = 'error' AS bad FROM events), r AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
k AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM r)
SELECT event_id, coalesce(bool_or(k >= 3) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM k""")
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("failed"))
    return crawlplan.circuit_breaker(rows, "user_id", ["event_id"], "failed").select("event_id", "skipped")


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events), r AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), s AS (SELECT user_id, run, count(*) AS n FROM r WHERE bad GROUP BY ALL)
SELECT user_id, count(*) AS streaks, max(n) AS longest FROM s GROUP BY 1""")
def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("failed"))
    return crawlplan.failure_streaks(rows, "user_id", ["event_id"], "failed")


# --- greedy resolution: tested against sequential versions, not expressible in SQL -------------------------------


@query()
def author_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_authors(table(spark, sf, "normalized_author"), "dedupe_key", "normalized_name", "author_id")


@query()
def book_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_books(table(spark, sf, "normalized_book"), "norm_id").withColumnRenamed("id", "norm_id")
