"""URLs as column expressions: hosts, registrable domains, kinds of links, social profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The network of a registrable domain, and the path segments before a profile's name there ("" for none).
NETWORKS = {
    "twitter.com": ("twitter", ""),
    "x.com": ("twitter", ""),
    "instagram.com": ("instagram", ""),
    "facebook.com": ("facebook", ""),
    "linkedin.com": ("linkedin", "in"),
    "goodreads.com": ("goodreads", "author/show"),
    "youtube.com": ("youtube", ""),
    "tiktok.com": ("tiktok", ""),
    "mastodon.social": ("mastodon", ""),
    "bsky.app": ("bluesky", "profile"),
    "substack.com": ("substack", ""),
}
#: Path segments that are no profile.
NOT_PROFILES = ["share", "sharer", "intent", "home", "login", "search", "explore", "hashtag", "p", "tr", "plugins", "dialog"]


def authority(url: Column) -> Column:
    """Lower-case host with its port; null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def registrable(h: Column) -> Column:
    """The last two labels of a host."""
    labels = F.filter(F.split(F.lower(h), r"\."), lambda x: F.length(x) > 0)
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.lower(h))


def link_kind(link: Column, page: Column, platforms: list[str]) -> Column:
    """page (same registrable domain), social (a platform's host) or website; null for what is no URL."""
    a, b = registrable(host(link)), registrable(host(page))
    return F.when(a == b, "page").when(a.isin(platforms), "social").when(a.isNotNull(), "website")


def network(url: Column) -> Column:
    """The network whose host an address has; null for others."""
    domain = registrable(host(url))
    return F.coalesce(*[F.when(domain == d, n) for d, (n, _) in NETWORKS.items()])


def profile_address(url: Column) -> Column:
    """The address of a profile without query and trailing slash; null if the path names none."""
    domain = registrable(host(url))
    path = F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    below = F.coalesce(*[F.when(domain == d, F.when(F.lit(lead == ""), path).when(F.startswith(path, F.lit(lead + "/")), F.substring(path, len(lead) + 2, 1_000_000))) for d, (_, lead) in NETWORKS.items()])
    name = F.get(F.split(below, "/"), F.lit(0))
    fits = (F.length(name) >= 2) & ~F.lower(name).isin(NOT_PROFILES) & name.rlike(r"^[\w.%\-]+$")
    return F.when(fits, F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), r"[/.]+$", ""))


def social_profiles(text: Column) -> Column:
    """map of network to the first profile address in a text."""
    links = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s\"'<>()\\]+"), F.lit(0))
    found = F.filter(F.transform(links, lambda u: F.struct(network(u).alias("k"), profile_address(u).alias("v"))), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    kinds = F.array_distinct(F.transform(found, lambda x: x["k"]))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.get(F.filter(found, lambda x: x["k"] == k), F.lit(0))["v"])))


def slug_words(url: Column) -> Column:
    """The last path segment of a URL as words."""
    segment = F.regexp_extract(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "/+$", ""), r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(segment, r"\.[a-z]{2,5}$", ""), r"[-_+]+", " "))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")
