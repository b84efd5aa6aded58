"""Rows of an export, the leads they come from, merges of extracted records, and the small tables around a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.leads import PROFILES, clamp, contactable, corroborated, high_visibility, low_visibility, reasons, recency, small_catalogue, tier, weighted_score

#: The columns of an export in order, and the states a lead may have.
EXPORT_COLUMNS = ["lead_id", "score", "tier", "status", "author_name", "author_website", "author_emails", "author_socials", "book_title", "book_subtitle", "isbn13", "published_on", "published_year", "publisher", "language", "page_count", "ratings_count", "average_rating", "categories", "sources", "source_urls", "top_signals", "notes"]
STATUSES = ["new", "contacted", "replied", "converted", "rejected"]


def author_funded(publisher: Column, funded: list[str], trade: list[str]) -> Column:
    """1 without a publisher or with a marker of `funded`, 0 with one of `trade`, else a half. Markers are an input."""
    return F.when(F.coalesce(F.trim(publisher), F.lit("")) == "", 1.0).when(_has(publisher, funded), 1.0).when(_has(publisher, trade), 0.0).otherwise(0.5)


def trade_published(publisher: Column, trade: list[str]) -> Column:
    return F.when(_has(publisher, trade), 1.0).otherwise(0.0)


def _has(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(text), F.lit(m))
    return F.coalesce(found, F.lit(False))


def scored_leads(links: DataFrame, books: DataFrame, authors: DataFrame, profile: str, as_of: tuple[int, int], funded: list[str], trade: list[str]) -> DataFrame:
    """(author_key, book_key, score, tier, reasons) of every pair of links (author_key, book_key). books has book_key,
    published_on, published_year, publisher, ratings_count, n_sources, best_trust; authors has author_key, n_contacts,
    has_site. Missing counts are 1 book, 0 contacts, 1 source and a trust of 0.5. An unknown profile is an error."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known: {', '.join(PROFILES)}")
    horizon, weights = PROFILES[profile]
    pairs = links.select("author_key", "book_key").distinct()
    catalogue = pairs.groupBy("author_key").agg(F.count("*").alias("n_books"))
    rows = pairs.join(catalogue, "author_key").join(books, "book_key").join(authors, "author_key", "left")
    signals = {
        "recency": recency(F.col("published_on"), F.col("published_year"), as_of, horizon),
        "author_funded": author_funded(F.col("publisher"), funded, trade),
        "small_catalogue": small_catalogue(F.coalesce("n_books", F.lit(1))),
        "low_visibility": low_visibility(F.col("ratings_count")),
        "high_visibility": high_visibility(F.col("ratings_count")),
        "trade_published": trade_published(F.col("publisher"), trade),
        "contactable": contactable(F.coalesce("n_contacts", F.lit(0)), F.coalesce("has_site", F.lit(False))),
        "source_trust": clamp(F.coalesce("best_trust", F.lit(0.5))),
        "corroborated": corroborated(F.coalesce("n_sources", F.lit(1))),
    }
    used = {k: v for k, v in signals.items() if k in weights}
    rows = rows.select("author_key", "book_key", *[v.alias("s_" + k) for k, v in used.items()])
    held = {k: F.col("s_" + k) for k in used}
    rows = rows.select("author_key", "book_key", weighted_score(held, weights).alias("score"), reasons(held, weights).alias("reasons"))
    return rows.withColumn("tier", tier(F.col("score")))


def blocked_authors(authors: DataFrame, contacts: DataFrame, suppression: DataFrame) -> DataFrame:
    """(author_key, reason): the first reason of email, domain, author_name for which an author may not be written to.
    Each kind is one equi-join on distinct lower-case values; an author has any number of addresses."""
    listed = suppression.select("kind", F.regexp_replace(F.lower(F.trim("value")), "^@", "").alias("v")).distinct()
    mails = contacts.where("kind = 'email'").select("author_key", F.lower(F.trim("value")).alias("mail"))
    keys = mails.select("author_key", F.lit("email").alias("kind"), F.col("mail").alias("v"), F.lit(0).alias("rank"))
    keys = keys.unionByName(mails.select("author_key", F.lit("domain").alias("kind"), F.regexp_extract("mail", "@(.*)$", 1).alias("v"), F.lit(1).alias("rank")))
    keys = keys.unionByName(authors.select("author_key", F.lit("author_name").alias("kind"), F.lower(F.trim("display_name")).alias("v"), F.lit(2).alias("rank")))
    return keys.join(listed, ["kind", "v"], "left_semi").groupBy("author_key").agg(F.min_by("kind", "rank").alias("reason"))


def export_rows(leads: DataFrame, authors: DataFrame, contacts: DataFrame, books: DataFrame, provenance: DataFrame, suppression: DataFrame | None = None, min_score: float = 0.0, tiers: list[str] | None = None, limit: int | None = None, require_contact: bool = False) -> DataFrame:
    """Export rows, 23 columns in fixed order, '' for missing values. Filters and suppression come first, then the limit,
    by score, then lead_id. Leads without their author or book are left out; children are aggregated before the joins."""
    rows = leads.where(F.col("score") >= min_score)
    if tiers:
        rows = rows.where(F.col("tier").isin([t.upper() for t in tiers]))
    if suppression is not None:
        rows = rows.join(blocked_authors(authors, contacts, suppression), "author_key", "left_anti")
    told = contacts.where("value is not null").select("author_key", "kind", "value").distinct().groupBy("author_key").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == "email", F.col("value")))), "; ").alias("author_emails"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") != "email", F.concat("kind", F.lit("="), "value")))), "; ").alias("author_socials"),
    )
    where_from = provenance.groupBy("book_key").agg(
        F.array_join(F.sort_array(F.collect_set("source_id")), "; ").alias("sources"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("url") != "", F.col("url")))), " | ").alias("source_urls"),
    )
    rows = rows.join(authors, "author_key").join(books, "book_key").join(told, "author_key", "left").join(where_from, "book_key", "left")
    if require_contact:
        rows = rows.where((F.coalesce("author_emails", F.lit("")) != "") | (F.coalesce("website", F.lit("")) != "") | (F.coalesce("author_socials", F.lit("")) != ""))
    if limit is not None:
        rows = rows.orderBy(F.desc("score"), "lead_id").limit(limit)
    signals = F.array_join(F.transform(F.slice("reasons", 1, 3), lambda r: F.concat(r["signal"], F.lit("("), r["points"].cast("string"), F.lit(")"))), "; ")
    text = {"author_name": F.col("display_name"), "author_website": F.col("website"), "book_title": F.col("title"), "book_subtitle": F.col("subtitle"), "categories": F.array_join("categories", "; "), "top_signals": signals}
    return rows.select("lead_id", "score", *[F.coalesce(text.get(c, F.col(c) if c in rows.columns else F.lit("")).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS[2:]])


def filtered_records(rows: DataFrame, min_priority: int | None = None, tiers: list[str] | None = None, channels: list[str] | None = None, every: bool = False, contains: str = "", text_columns: list[str] | None = None) -> DataFrame:
    """Extracted records by priority, tier, channels (array column `channels`: any or every one of the given) and a text
    that one of the text columns contains, whatever its case."""
    if min_priority is not None:
        rows = rows.where(F.col("priority") >= min_priority)
    if tiers:
        rows = rows.where(F.col("tier").isin(tiers))
    if channels:
        wanted = F.array(*[F.lit(c) for c in channels])
        rows = rows.where(F.size(F.array_except(wanted, F.coalesce("channels", F.array().cast("array<string>")))) == 0 if every else F.coalesce(F.arrays_overlap("channels", wanted), F.lit(False)))
    if contains:
        found = F.lit(False)
        for c in text_columns or []:
            found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(contains.lower())), F.lit(False))
        rows = rows.where(found)
    return rows


def record_key(isbn13: Column, title: Column, first_author: Column) -> Column:
    """'isbn:...' where there is one, else title and first author, folded."""
    from quillon.functions.text import normalize_person, normalize_title

    return F.when(F.length(isbn13) > 0, F.concat(F.lit("isbn:"), isbn13)).otherwise(F.concat(F.lit("t:"), normalize_title(title), F.lit("|"), F.coalesce(normalize_person(first_author), F.lit(""))))


def merged_records(rows: DataFrame, key: str, rank: list[str], scalars: list[str], arrays: list[str]) -> DataFrame:
    """(key, records, scalars, arrays): one record per key; of each scalar the first value by rank that is not empty, of
    each array the first that has elements. One aggregation, so a frequent key is combined before the shuffle."""
    at = F.struct(*rank)
    first = lambda c, ok: F.min_by(c, F.when(ok, at)).alias(c)
    some = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return rows.groupBy(key).agg(F.count("*").alias("records"), *[first(c, some(c)) for c in scalars], *[first(c, F.coalesce(F.size(c) > 0, F.lit(False))) for c in arrays])


def saved_records(saved: DataFrame, new: DataFrame, key: str, author: str, columns: list[str]) -> DataFrame:
    """(key, author, change, columns): a library after saving new records. Records of one key with different authors stay
    apart; a record without an author joins the smallest author of its key. change is kept, enriched (a gap was filled)
    or added."""
    names = saved.select(key, author).unionByName(new.select(key, author)).where(F.col(author) != "").groupBy(key).agg(F.min(author).alias("_least"))
    filled = lambda df: df.join(names, key, "left").withColumn(author, F.coalesce(F.when(F.col(author) != "", F.col(author)), "_least", F.lit(""))).drop("_least")
    first = lambda df: filled(df).groupBy(key, author).agg(*[F.min_by(c, F.when(F.coalesce(F.col(c).cast("string") != "", F.lit(False)), F.col("seq"))).alias(c) for c in columns])
    a, b = first(saved), first(new).select(F.col(key).alias("_k"), F.col(author).alias("_a"), *[F.col(c).alias("_" + c) for c in columns])
    joined = a.join(b, (F.col(key) == F.col("_k")) & (F.col(author) == F.col("_a")), "full_outer")
    gap = F.lit(False)
    for c in columns:
        gap = gap | (F.col(c).isNull() & F.col("_" + c).isNotNull())
    change = F.when(F.col(key).isNull(), "added").when(gap, "enriched").otherwise("kept")
    return joined.select(F.coalesce(key, "_k").alias(key), F.coalesce(author, "_a").alias(author), change.alias("change"), *[F.coalesce(c, "_" + c).alias(c) for c in columns])


def run_states(attempts: DataFrame) -> DataFrame:
    """(run_id, status, records, errors, first_errors): the ledger of runs from their record attempts (run_id, seq, error):
    failed if nothing came through, partial if some records failed, success otherwise; the first 20 messages."""
    bad = F.col("error").isNotNull()
    kept = attempts.where(bad).withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).where("_r <= 20")
    messages = kept.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda x: x["error"]), "; ").alias("first_errors"))
    counted = attempts.groupBy("run_id").agg(F.count("*").alias("records"), F.count_if(bad).alias("errors"))
    status = F.when(F.col("errors") == F.col("records"), "failed").when(F.col("errors") > 0, "partial").otherwise("success")
    return counted.join(messages, "run_id", "left").select("run_id", status.alias("status"), "records", "errors", F.coalesce("first_errors", F.lit("")).alias("first_errors"))


def with_sources(known: DataFrame, given: DataFrame, refreshed: list[str]) -> DataFrame:
    """The small table of sources (id, ...) after a run named some: new ones are added, `refreshed` columns take over
    what is given, all others stay."""
    rest = [c for c in known.columns if c != "id"]
    g = given.select(F.col("id").alias("_id"), *[F.col(c).alias("_" + c) for c in rest if c in given.columns])
    there = [c for c in rest if c in given.columns]
    columns = [F.coalesce("_" + c, c).alias(c) if c in refreshed and c in there else F.coalesce(c, "_" + c).alias(c) if c in there else F.col(c) for c in rest]
    return known.join(g, F.col("id") == F.col("_id"), "full_outer").select(F.coalesce("id", "_id").alias("id"), *columns)


def patched(leads: DataFrame, updates: DataFrame, key: str = "lead_id", columns: tuple[str, ...] = ("status", "notes")) -> DataFrame:
    """leads with the given status and notes; a null in an update leaves the value; an unknown status is ignored."""
    once = updates.groupBy(F.col(key).alias("_k")).agg(*[F.max(c).alias("_" + c) for c in columns])
    value = lambda c: F.coalesce(F.when(F.col("_" + c).isin(STATUSES), F.col("_" + c)) if c == "status" else F.col("_" + c), F.col(c))
    return leads.join(once, F.col(key) == F.col("_k"), "left").select(*[value(c).alias(c) if c in columns else F.col(c) for c in leads.columns])


def added_suppression(listed: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, value): the list with more entries, stripped and in lower case, each once."""
    clean = lambda df: df.select(F.lower(F.trim("kind")).alias("kind"), F.lower(F.trim("value")).alias("value")).where("value <> ''")
    return clean(listed).unionByName(clean(entries)).distinct()


def enriched_in_turn(authors: DataFrame, stages: list[DataFrame], least: float = 0.55) -> DataFrame:
    """(author_key, website, bio, confidence, answered): what a chain of enrichers says about authors. Each stage is a
    table (author_key, website, bio, confidence) of one enricher's answers; later ones see and keep what earlier ones
    found, gaps are filled in order, and an author counts only if the most confident answer reaches `least`."""
    out = authors.select("author_key", F.lit(None).cast("string").alias("website"), F.lit(None).cast("string").alias("bio"), F.lit(0.0).alias("confidence"), F.lit(0).alias("answered"))
    for k, answers in enumerate(stages):
        a = answers.groupBy(F.col("author_key").alias(f"_k{k}")).agg(F.max_by("website", "confidence").alias("_w"), F.max_by("bio", "confidence").alias("_b"), F.max("confidence").alias("_c"))
        out = out.join(a, F.col("author_key") == F.col(f"_k{k}"), "left").select("author_key", F.coalesce("website", "_w").alias("website"), F.coalesce("bio", "_b").alias("bio"), F.greatest("confidence", F.coalesce("_c", F.lit(0.0))).alias("confidence"), (F.col("answered") + F.col("_c").isNotNull().cast("int")).alias("answered"))
    return out.where(F.col("confidence") >= least)
