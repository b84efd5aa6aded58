"""A landing table of fetched pages or responses, and which of its rows are fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def landing_key(url: Column) -> Column:
    """SHA-256 of the requested URL (not of where it redirected to)."""
    return F.sha2(url, 256)


def read_landing(spark: SparkSession, path: str, schema: str = "url string, final_url string, status int, body string, stored_at timestamp") -> DataFrame:
    """Landed rows; a corrupt line counts as not landed."""
    rows = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and url is not null").drop("_corrupt").withColumn("key", landing_key(F.col("url")))


def fresh(rows: DataFrame, as_of: str, hours: int = 168) -> DataFrame:
    """The newest successful row of each key that is not older than `hours` at as_of."""
    good = rows.where(F.col("status").between(200, 299) & (F.col("stored_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours")))
    rest = [c for c in rows.columns if c != "key"]
    return good.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("stored_at", "url")).alias("r")).select("key", "r.*")
