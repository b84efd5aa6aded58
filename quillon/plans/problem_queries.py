"""Queries of the general data-preparation operators, with their SQL where SQL can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.incremental import Ledger, taken_over
from quillon.operators.timestamps import published_norm, source_zones
from quillon.session import shared_dir, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of a ledger that starts from what book_source has taken over."""
    records = table(spark, sf_dir, "raw_record")
    ledger = Ledger(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    ledger.adopt(taken_over(table(spark, sf_dir, "book_source"), records))
    return ledger.run(records).select("record_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "raw_book").select("raw_id", "source_id", "published_date", "fetched_at")
    return published_norm(books, table(spark, sf_dir, "source_meta")).where("published_norm is not null").select("raw_id", "published_norm")


def p3_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone each source's own timestamps point to, beside the declared one."""
    books = table(spark, sf_dir, "raw_book").select("source_id", "published_date", "fetched_at")
    return source_zones(books, table(spark, sf_dir, "source_meta"))


QUERIES = {"p3_found": p3_found, "p3_zones": p3_zones, "p6_found": p6_found}

SQL = {
    "p6_found": """
WITH keyed AS (
  SELECT *, coalesce('s:' || source_id, 'n:') || chr(1) || coalesce('e:' || external_id, 'u:' || url) AS k FROM raw_record),
newest AS (
  SELECT k, record_id, lower(content_hash) AS h FROM keyed WHERE k IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY fetched_at DESC NULLS LAST, record_id DESC) = 1),
taken AS (
  SELECT coalesce('s:' || b.source_id, 'n:') || chr(1) || coalesce('e:' || b.external_id, 'u:' || b.url) AS k, lower(r.content_hash) AS h
  FROM book_source b LEFT JOIN raw_record r ON r.record_id = b.raw_record_id)
SELECT n.record_id FROM newest n
WHERE n.h IS NULL OR NOT EXISTS (SELECT 1 FROM taken t WHERE t.k = n.k)
   OR EXISTS (SELECT 1 FROM taken t WHERE t.k = n.k AND (t.h IS NULL OR t.h <> n.h))
""",
}
