"""Aggregates over books, authors and sources, weighted signals, suppression, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the signals, in order of declaration, and the months a book counts as recent.
PROFILES = {
    "services": (36, {"recency": 0.28, "author_funded": 0.22, "small_catalogue": 0.16, "low_visibility": 0.12, "contactable": 0.14, "source_trust": 0.04, "corroborated": 0.04}),
    "marketing": (18, {"recency": 0.34, "low_visibility": 0.24, "author_funded": 0.12, "contactable": 0.16, "small_catalogue": 0.06, "source_trust": 0.04, "corroborated": 0.04}),
    "saas": (36, {"contactable": 0.30, "recency": 0.22, "author_funded": 0.18, "small_catalogue": 0.12, "low_visibility": 0.08, "source_trust": 0.05, "corroborated": 0.05}),
    "rights": (60, {"high_visibility": 0.34, "trade_published": 0.22, "recency": 0.18, "corroborated": 0.14, "source_trust": 0.07, "contactable": 0.05}),
}
TIERS = [("A", 75.0), ("B", 55.0), ("C", 35.0), ("D", float("-inf"))]


def recency(published_on: Column, published_year: Column, as_of: tuple[int, int], horizon: int) -> Column:
    """1 for this month or later, falling to 0 over the horizon in months; 0.3 without a date."""
    year, month = as_of
    months = F.when(published_on.isNotNull(), (year - F.year(published_on)) * 12 + (month - F.month(published_on))).otherwise((year - published_year) * 12)
    return F.when(months.isNull(), 0.3).when(months < 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - months / horizon))


def small_catalogue(n_books: Column) -> Column:
    return F.when(n_books <= 1, 1.0).when(n_books <= 3, 0.6).otherwise(0.1)


def low_visibility(ratings: Column, threshold: int = 50) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.coalesce(ratings, F.lit(0)) / threshold)


def high_visibility(ratings: Column, threshold: int = 500) -> Column:
    return F.least(F.lit(1.0), F.coalesce(ratings, F.lit(0)) / threshold)


def contactable(n_contacts: Column, has_site: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * n_contacts + 0.4 * has_site.cast("int"))


def corroborated(n_sources: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n_sources - 1) / 2))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rounded(x: Column, places: int) -> Column:
    """Half up on the binary value, the same in every engine."""
    return F.floor(x * 10**places + F.lit(0.5)) / 10**places


def weighted_score(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """100 times the weighted mean of the signals, to two places; a missing signal is 0."""
    total = sum(weights.values())
    return rounded(100 * sum((F.lit(w) * F.coalesce(signals.get(s, F.lit(0.0)), F.lit(0.0)) for s, w in weights.items()), F.lit(0.0)) / total, 2)


def reasons(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """array<struct<signal, value, weight, points>> of the signals above 0, most points first, ties in profile order."""
    total = sum(weights.values())
    rows = [F.struct((-rounded(100 * w * signals[s] / total, 2)).alias("o"), F.lit(i).alias("i"), F.lit(s).alias("signal"), rounded(signals[s], 3).alias("value"), F.lit(w).alias("weight"), rounded(100 * w * signals[s] / total, 2).alias("points")) for i, (s, w) in enumerate(weights.items()) if s in signals]
    sorted_rows = F.array_sort(F.filter(F.array(*rows), lambda r: r["value"] > 0))
    return F.transform(sorted_rows, lambda r: F.struct(r["signal"].alias("signal"), r["value"].alias("value"), r["weight"].alias("weight"), r["points"].alias("points")))


def tier(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, least in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def counts_with_zeros(df: DataFrame, column: str, values: list[str], out: str = "n") -> DataFrame:
    """A row per value, those that never occur with 0; one aggregation, no join."""
    sums = df.agg(*[F.coalesce(F.sum((F.col(column) == v).cast("long")), F.lit(0)).alias(f"c{i}") for i, v in enumerate(values)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(f"c{i}").alias(out)) for i, v in enumerate(values)])).alias("x")).select("x.*")


def suppressed(rows: DataFrame, suppression: DataFrame, email_cols: list[str], name_col: str, max_rows: int = 1_000_000) -> DataFrame:
    """rows with suppression_reason: 'email', 'domain' or 'author_name', the first that applies, else null. suppression
    has (kind, value); it is broadcast only up to max_rows. Each kind is one equi-join on distinct lower-case values."""
    from quillon.session import fresh, small

    out = rows
    flags = []
    for kind, keys in (("email", [F.lower(F.col(c)) for c in email_cols]), ("domain", [F.regexp_extract(F.lower(F.col(c)), "@(.*)$", 1) for c in email_cols]), ("author_name", [F.lower(F.trim(F.col(name_col)))])):
        listed = suppression.where(F.col("kind") == kind).select(F.regexp_replace(F.lower(F.trim("value")), "^@", "").alias("v")).distinct()
        for key in keys:
            flag = fresh(out, f"_s{len(flags)}")
            out = out.join(small(listed.select(F.col("v").alias(flag)), max_rows), key == F.col(flag), "left")
            flags.append((kind, flag))
    reason = F.coalesce(*[F.when(F.col(f).isNotNull(), k) for k, f in flags])
    return out.withColumn("suppression_reason", reason).drop(*[f for _, f in flags])


def joined_text(df: DataFrame, key: str, column: str, sep: str = "; ", out: str | None = None) -> DataFrame:
    """(key, out): the distinct values of a key in order, as one text."""
    return df.where(F.col(column).isNotNull()).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(column)), sep).alias(out or column))
