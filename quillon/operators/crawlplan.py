"""Replays of a crawl's pacing and failures from logs, as window functions per host."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(requests: DataFrame, host: str, at: str, order: str, gap_s: float) -> DataFrame:
    """requests with allowed_s: when each may start (seconds since 1970) if a host's requests keep gap_s apart. The
    recurrence next = max(arrival, previous + gap) is the running maximum of arrival - position * gap."""
    w = Window.partitionBy(host).orderBy(at, order)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = F.unix_micros(F.col(at)) / 1e6
    placed = requests.withColumn("_i", F.row_number().over(w)).withColumn("_t", seconds - F.col("_i") * gap_s)
    return placed.withColumn("allowed_s", F.round(F.max("_t").over(up_to) + F.col("_i") * gap_s, 3)).drop("_i", "_t")


def circuit_breaker(requests: DataFrame, host: str, order: list[str], failed: str, limit: int = 3) -> DataFrame:
    """requests with skipped: whether `limit` consecutive failures of the host came before, after which it stays
    closed. A success resets the count: runs of failures are islands between successes."""
    w = Window.partitionBy(host).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.col(failed).cast("int")
    runs = requests.withColumn("_run", F.sum(1 - bad).over(up_to))
    in_run = Window.partitionBy(host, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = runs.withColumn("_k", F.sum(bad).over(in_run))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("skipped", F.coalesce(F.max(F.col("_k") >= limit).over(before), F.lit(False))).drop("_run", "_k")


def failure_streaks(requests: DataFrame, host: str, order: list[str], failed: str) -> DataFrame:
    """(host, streaks, longest): the runs of consecutive failures of each host."""
    w = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = requests.withColumn("_run", F.sum(1 - F.col(failed).cast("int")).over(w)).where(F.col(failed))
    sizes = runs.groupBy(host, "_run").agg(F.count("*").alias("n"))
    return sizes.groupBy(host).agg(F.count("*").alias("streaks"), F.max("n").alias("longest"))


#: Statuses after which a request is tried again.
RETRYABLE = [408, 425, 429, 500, 502, 503, 504]


def retry_delay(status: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds until the next try of a request, null if there is none: what the response asks for, else 2 to the power of
    the attempt; a null status is a network error, which is tried again too."""
    again = status.isNull() | status.isin(RETRYABLE)
    return F.when(again, F.coalesce(F.when(status.isNotNull(), retry_after.try_cast("double")), F.pow(F.lit(2.0), attempt)))


def robots_verdicts(requests: DataFrame, robots: DataFrame, url: str, agent: str) -> DataFrame:
    """requests with allowed and crawl_delay. robots has (origin, status, body); an origin that was not reached, or
    answered 400 or more, allows everything. Rules are parsed once per origin and batch."""
    origin = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.\-]*://[^/?#]+", 0))
    rules = robots.groupBy(F.lower("origin").alias("_o")).agg(F.max_by("body", F.coalesce("status", F.lit(0))).alias("_body"), F.max("status").alias("_status"))
    joined = requests.join(rules, origin == F.col("_o"), "left")

    @F.pandas_udf("allowed boolean, crawl_delay double")
    def judge(urls: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        parsers: dict[str, RobotFileParser] = {}
        rows = []
        for u, body in zip(urls, bodies):
            if body is None or u is None:
                rows.append((True, None))
                continue
            if body not in parsers:
                parsers[body] = RobotFileParser()
                parsers[body].parse(body.splitlines())
            delay = parsers[body].crawl_delay(agent)
            rows.append((parsers[body].can_fetch(agent, u), float(delay) if delay is not None else None))
        return pd.DataFrame(rows, columns=["allowed", "crawl_delay"])

    heard = F.when(F.coalesce(F.col("_status") < 400, F.lit(False)), F.col("_body"))
    judged = joined.withColumn("_v", judge(F.col(url), heard))
    return judged.select(*requests.columns, F.col("_v.allowed").alias("allowed"), F.col("_v.crawl_delay").alias("crawl_delay"))


def request_rate(default: Column, recipe: Column, crawl_delay: Column) -> Column:
    """Requests a second to a host: the recipe's rate if it has one, at most one per crawl delay."""
    base = F.coalesce(recipe, default)
    return F.when(crawl_delay > 0, F.least(base, 1 / crawl_delay)).otherwise(base)


def fetch_decision(cached: Column, skipped: Column, allowed: Column) -> Column:
    """What becomes of a request, in this order: a fresh copy is there, the host is given up, robots deny it, or fetch."""
    return F.when(cached, "cache").when(skipped, "dead host").when(~allowed, "denied").otherwise("fetch")


def domain_counters(decided: DataFrame, domain: str, decision: str, failed: str) -> DataFrame:
    """(domain, requests, cache_hits, denied, skipped, errors) of decided requests."""
    d = F.col(decision)
    return decided.groupBy(domain).agg(F.count_if(d == "fetch").alias("requests"), F.count_if(d == "cache").alias("cache_hits"), F.count_if(d == "denied").alias("denied"), F.count_if(d == "dead host").alias("skipped"), F.count_if((d == "fetch") & F.col(failed)).alias("errors"))
