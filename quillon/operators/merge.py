"""Folding of duplicate records into one, as aggregations with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truthy(df: DataFrame, column: str) -> Column:
    """Whether a value may fill a gap: not null, not empty, not zero."""
    kind = df.schema[column].dataType.simpleString()
    c = F.col(column)
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def fold_first(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns): of each column the first value, in the given order, that can fill a gap."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, F.when(truthy(df, c), at)).alias(c) for c in columns])


def fold_arrays(df: DataFrame, key: str, order: list[str], column: str, cap: int = 30) -> DataFrame:
    """(key, column): the elements of all rows' arrays once, in order of first appearance, at most cap of them.
    Each element is reduced to its first place before the groups meet."""
    place = F.struct(*order, "_p")
    first = df.select(key, *order, F.posexplode(column).alias("_p", "_v")).where("_v is not null").groupBy(key, "_v").agg(F.min(place).alias("_at"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_at", "_v"))).where(F.col("_r") <= cap)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"])
    return ranked.groupBy(key).agg(listed.alias(column))


def fold_ratings(df: DataFrame, key: str, order: list[str], count: str = "ratings_count", average: str = "average_rating") -> DataFrame:
    """(key, count, average): the greatest count; the average comes from the last row that raised the running maximum
    and has one, else from the first row that has one."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_c", F.coalesce(F.col(count), F.lit(0)).cast("long")).withColumn("_before", F.max("_c").over(before))
    raises = F.col("_before").isNull() | (F.col("_c") > F.col("_before"))
    at = F.struct(*order)
    has = F.col(average).isNotNull() & ~F.isnan(average)
    return rows.groupBy(key).agg(F.max(count).alias(count), F.coalesce(F.max_by(average, F.when(has & raises, at)), F.min_by(average, F.when(has, at))).alias(average))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as one aggregation (no window, so a frequent key is combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refreshed: list[str], kept: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, `refreshed` columns come from new and `kept` ones from old."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    there = F.coalesce(*[F.col(f"b.{c}").isNotNull() for c in keys])
    cols = [F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys]
    cols += [F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in refreshed]
    cols += [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in kept]
    return joined.select(*cols)


def unseen(new: DataFrame, seen: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key of new that seen doesn't have."""
    return first_per_key(new, keys, order).join(seen.select(*keys).distinct(), keys, "left_anti")
