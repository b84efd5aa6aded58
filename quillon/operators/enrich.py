"""What several sources say about authors, as a long table of facts, and its folding into profiles and contacts.

facts: author_id, kind, value, source_id, source_url, confidence, place (order of the source in the chain). Long form
needs no map per author, so an author with many facts spreads over tasks until the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_person

#: Kinds of which an author has several values; of all others the first one counts.
MANY = ("email",)
#: Kinds whose values are texts and stay whole.
WHOLE = ("bio",)
FACTS = "author_id, kind, value, source_id, source_url, confidence, place"


def facts_of(rows: DataFrame, author_id: str, source_id: Column, source_url: Column, confidence: Column, place: Column, kinds: dict[str, Column]) -> DataFrame:
    """Facts from columns: one row per kind with a non-empty value."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(v).alias("value")) for k, v in kinds.items()]))
    long = rows.select(F.col(author_id).alias("author_id"), cells.alias("c"), source_id.alias("source_id"), source_url.alias("source_url"), confidence.cast("double").alias("confidence"), place.cast("long").alias("place"))
    return long.select("author_id", "c.kind", "c.value", "source_id", "source_url", "confidence", "place").where("value is not null and value <> ''")


def social_facts(rows: DataFrame, author_id: str, socials: str, source_id: Column, source_url: Column, confidence: Column, place: Column) -> DataFrame:
    """Facts from a map of network to address."""
    long = rows.select(F.col(author_id).alias("author_id"), F.explode(socials).alias("kind", "value"), source_id.alias("source_id"), source_url.alias("source_url"), confidence.cast("double").alias("confidence"), place.cast("long").alias("place"))
    return long.where("value is not null and value <> ''")


def merged_facts(facts: DataFrame, floor: float = 0.55, value_cap: int = 500) -> DataFrame:
    """One row per author and kind (per value for kinds in MANY): the most confident source first, then the earlier one
    in the chain. Authors whose best source stays below the floor drop out. Values are cut before they are compared,
    except for kinds in WHOLE."""
    cut = facts.withColumn("value", F.when(F.col("kind").isin(*WHOLE), F.col("value")).otherwise(F.substring("value", 1, value_cap))).withColumn("value", F.when(F.col("kind").isin(*MANY), F.lower("value")).otherwise(F.col("value")))
    slot = F.when(F.col("kind").isin(*MANY), F.col("value")).otherwise(F.lit(""))
    rest = F.struct("value", "source_id", "source_url", "confidence", "place")
    best = cut.withColumn("_slot", slot).groupBy("author_id", "kind", "_slot").agg(F.min_by(rest, F.struct(-F.coalesce("confidence", F.lit(0.0)), "place", "value")).alias("r"))
    sure = facts.groupBy("author_id").agg(F.max("confidence").alias("m")).where(F.col("m") >= floor).select("author_id")
    return best.join(sure, "author_id", "left_semi").select("author_id", "kind", "r.*")


def new_contacts(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Facts whose (author_id, kind, value) is not recorded yet."""
    return facts.join(known.select("author_id", "kind", "value").distinct(), ["author_id", "kind", "value"], "left_anti")


def fill_gaps(authors: DataFrame, facts: DataFrame, kinds: list[str], id_col: str = "author_id") -> DataFrame:
    """authors with their empty columns of the given kinds filled from the facts."""
    wide = facts.where(F.col("kind").isin(*kinds)).groupBy(F.col("author_id").alias("_a")).agg(*[F.first(F.when(F.col("kind") == k, F.col("value")), ignorenulls=True).alias(f"_{k}") for k in kinds])
    joined = authors.join(wide, F.col(id_col) == F.col("_a"), "left")
    return joined.select(*[F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in kinds else F.col(c) for c in authors.columns])


def best_match(authors: DataFrame, candidates: DataFrame, id_col: str, name: str, most: int = 5) -> DataFrame:
    """(id, candidate): the first of an author's first `most` candidates (author_id, place, label, candidate) whose
    folded label equals the author's folded name; others are never taken, however high they rank."""
    near = candidates.where(F.col("place") < most).select(F.col("author_id").alias("_a"), "place", normalize_person(F.col("label")).alias("_l"), "candidate")
    joined = authors.join(near, (F.col(id_col) == F.col("_a")) & (normalize_person(F.col(name)) == F.col("_l")))
    return joined.groupBy(id_col).agg(F.min_by("candidate", "place").alias("candidate"))


def plausible(instance_of: Column, occupations: Column, human: str, writing: list[str]) -> Column:
    """Whether a knowledge-base entry is a person who writes."""
    return F.coalesce(F.array_contains(instance_of, human) & F.arrays_overlap(occupations, F.array(*[F.lit(o) for o in writing])), F.lit(False))
