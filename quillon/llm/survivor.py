"""The best value of each field of a group of duplicate records.

Among the rows with a real value, those of the most trusted source compete, and the topologically latest one in the
currency order of the group survives. That partial order has two kinds of relations:

  times: of two rows with a time the one seen later is more current;
  values: where a time is missing, value b is more current than value a if rows of one key and source went from a to b
  significantly more often than back, anywhere in the data, or if a chain of such steps leads from a to b. Chains that
  run in a circle say nothing about the values in it: the learned relation is closed transitively once for all groups,
  and pairs it relates in both directions are dropped, which leaves a strict partial order.

A group whose rows all have a time is ordered totally, and its latest row is the maximum of a struct: one aggregation
with map-side combining, so a group of any size never meets in one task. Only groups with a missing time are compared
with the learned order, by joins on (group, field, value) of their distinct values.

Where nothing more current than either of two rows is known, the one with a time comes first, then the smaller id.

Defined cases: null and blank values, stand-ins ('n/a', 'unknown', 0 pages, 1900-01-01, ...), impossible numbers and
dates, and texts cut short (ending in an ellipsis) are not real; a group without a real value gives no row; a null
trust is the lowest; ties go to the smallest id; a null group key is no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import small, stage

#: Ways to write that a text is missing.
STAND_INS = [
    "n/a", "na", "n.a", "n.a.", "none", "(none)", "null", "nil", "unknown", "(unknown)", "[unknown]", "unknown publisher", "publisher unknown", "not stated", "not given", "none given",
    "no publisher", "not known", "not available", "publisher not identified", "[publisher not identified]", "s.n", "s.n.", "[s.n.]", "sine nomine", "tbd", "tbc", "tba", "to be announced",
    "to be confirmed", "to be determined", "various", "various publishers", "self", "self-published", "self published", "unspecified", "undefined", "missing", "x", "xx", "xxx", "0", "00", "000",
]
STAND_IN_DATES = ["1753-01-01", "1899-12-30", "1899-12-31", "1900-01-01", "1904-01-01", "1970-01-01", "1980-01-01", "2099-12-31", "9999-12-31", "0001-01-01"]
STAND_IN_NUMBERS = [999, 9999, 99999, 999999, 32767, 65535, 2147483647]


def real_text(x: Column) -> Column:
    """Whether a text is a value: not null, blank, a stand-in, or cut short."""
    t = F.lower(F.trim(F.regexp_replace(x, r"[\s\u00A0]+", " ")))
    return F.coalesce(F.length(t) > 0, F.lit(False)) & ~t.isin(STAND_INS) & ~t.rlike(r"(\.\.|…)$") & t.rlike(r"[\p{L}\p{N}]")


def real_pages(x: Column, least: int = 4, most: int = 9000) -> Column:
    return F.coalesce(x.between(least, most) & ~x.isin(STAND_IN_NUMBERS), F.lit(False))


def real_date(x: Column, first: str = "1951-01-01", last: str = "2027-12-31") -> Column:
    return F.coalesce(x.between(F.lit(first).cast("date"), F.lit(last).cast("date")) & ~x.cast("string").isin(STAND_IN_DATES), F.lit(False))


def transitions(rows: DataFrame, keys: list[str], value: str, seen: str, buckets: str = "quarter", significance: float = 0.0) -> DataFrame:
    """(older, newer): value pairs in which older is replaced by newer more often than the other way round, learned
    from consecutive timestamped rows of equal keys; by `significance` standard deviations of a fair coin at least. A
    key's rows are ordered per calendar quarter, and the quarters' last and first values afterwards, so that the rows of
    a frequent key spread over many tasks."""
    known = rows.where(F.col(seen).isNotNull() & F.col(value).isNotNull()).withColumn("_q", F.date_trunc(buckets, seen))
    order = Window.partitionBy(*keys, "_q").orderBy(seen, value)
    within = known.select(F.lag(value).over(order).alias("older"), F.col(value).alias("newer"))
    ends = known.groupBy(*keys, "_q").agg(F.min_by(value, F.struct(seen, value)).alias("_first"), F.max_by(value, F.struct(seen, value)).alias("_last"))
    across = ends.select(F.lag("_last").over(Window.partitionBy(*keys).orderBy("_q")).alias("older"), F.col("_first").alias("newer"))
    moves = within.unionByName(across).where("older is not null and older <> newer")
    # both directions of a pair are counted in one row
    low, high = F.least("older", "newer"), F.greatest("older", "newer")
    pairs = moves.groupBy(low.alias("low"), high.alias("high")).agg(F.sum((F.col("older") == low).cast("long")).alias("up"), F.count("*").alias("n"))
    lead = F.abs(2 * F.col("up") - F.col("n"))
    rising = 2 * F.col("up") > F.col("n")
    return pairs.where((lead > 0) & (lead >= significance * F.sqrt("n"))).select(F.when(rising, F.col("low")).otherwise(F.col("high")).alias("older"), F.when(rising, F.col("high")).otherwise(F.col("low")).alias("newer"))


def closed(relation: DataFrame) -> DataFrame:
    """The strict partial order of a relation (older, newer): its transitive closure by doubling, without the pairs
    related in both directions. Rounds go on until no pair is new: the logarithm of the longest chain."""
    pairs = stage(relation.select("older", "newer").distinct())
    size = pairs.count()
    while size:
        steps = pairs.select(F.col("older").alias("mid"), F.col("newer").alias("end"))
        pairs = stage(pairs.unionByName(pairs.join(steps, pairs["newer"] == steps["mid"]).select("older", F.col("end").alias("newer"))).distinct())
        grown = pairs.count()
        if grown == size:
            break
        size = grown
    back = pairs.select(F.col("newer").alias("older"), F.col("older").alias("newer"))
    return pairs.join(back, ["older", "newer"], "left_anti")


def survivors(rows: DataFrame, group: str, id_col: str, source: str, seen: str, trust: DataFrame, fields: dict[str, Column], min_rows: int = 2, max_sources: int = 100_000, significance: float = 2.0) -> DataFrame:
    """(group, field_name, id): the row whose value survives, for every group of at least min_rows rows and each field.
    trust has (source, trust); fields maps a column to the condition that its value is real."""
    meta = trust.select(F.col("source").alias("_s"), F.col("trust").cast("double").alias("_trust")).dropDuplicates(["_s"])
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("v"), ok.alias("ok")) for f, ok in fields.items()])
    df = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(id_col).alias("_i"), F.col(source).alias("_src"), F.col(seen).alias("_at"), cells.alias("_cells"))
    df = df.join(small(meta, max_sources), F.col("_src") == F.col("_s"), "left").drop("_s")
    by_field = lambda x: [F.max(F.when(F.element_at(x, k + 1)["ok"], _order())).alias(f"b{k}") for k in range(len(fields))]
    untimed = df.where(F.col("_at").isNull()).select(F.col("_g").alias("_ug")).distinct()
    some = len(untimed.take(1)) > 0
    plain = df.join(untimed, F.col("_g") == F.col("_ug"), "left_anti") if some else df
    best = plain.groupBy("_g").agg(F.count("*").alias("_n"), *by_field(F.col("_cells"))).where(F.col("_n") >= min_rows)
    names = list(fields)
    out = best.select("_g", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"b{k}.id").alias("i")) for k, f in enumerate(names)])).alias("x"))
    out = out.select("_g", "x.field_name", F.col("x.i").alias("_i"))
    if some:
        out = out.unionByName(_by_currency(df, untimed, min_rows, significance))
    return out.where("_i is not null").select(F.col("_g").alias(group), "field_name", F.col("_i").alias(id_col))


def _order() -> Column:
    """Greater is better; nulls are lowest in a struct's order."""
    return F.struct(F.col("_trust"), F.col("_src"), F.col("_at"), (-F.col("_i").cast("decimal(38,0)")).alias("neg"), F.col("_i").alias("id"))


def _by_currency(df: DataFrame, untimed: DataFrame, min_rows: int, significance: float) -> DataFrame:
    """(_g, field_name, _i) of the groups with a missing time."""
    long = df.select("_g", "_i", "_src", "_at", "_trust", F.explode("_cells").alias("c")).select("_g", "_i", "_src", "_at", "_trust", "c.field_name", "c.v", "c.ok").where("ok")
    long = long.withColumn("_v", F.concat("field_name", F.lit("\u0001"), "v"))
    newer = closed(transitions(long, ["_g", "_src", "field_name"], "_v", "_at", significance=significance))
    inside = stage(long.join(untimed, F.col("_g") == F.col("_ug"), "left_semi").drop("ok", "v"))
    top = inside.groupBy(F.col("_g").alias("tg"), F.col("field_name").alias("tf")).agg(F.max(F.struct("_trust", "_src")).alias("best"))
    rivals = inside.join(top, (F.col("_g") == F.col("tg")) & (F.col("field_name") == F.col("tf")) & F.col("_trust").eqNullSafe(F.col("best._trust")) & F.col("_src").eqNullSafe(F.col("best._src"))).select("_g", "field_name", "_v", "_at", "_i")
    # the latest of the rows with a time, and each value of those without one
    latest = rivals.where("_at is not null").groupBy("_g", "field_name").agg(F.max(F.struct("_at", (-F.col("_i").cast("decimal(38,0)")).alias("neg"), "_i", "_v")).alias("m"))
    others = rivals.where("_at is null").groupBy("_g", "field_name", "_v").agg(F.min("_i").alias("_i"))
    final = stage(latest.select("_g", "field_name", F.col("m._v").alias("_v"), F.col("m._i").alias("_i"), F.lit(True).alias("timed")).unionByName(others.select("_g", "field_name", "_v", "_i", F.lit(False).alias("timed"))))
    values = final.select("_g", "_v").distinct()
    there = values.select(F.col("_g").alias("g2"), F.col("_v").alias("v2"))
    beaten = values.join(newer, F.col("_v") == F.col("older")).join(there, (F.col("_g") == F.col("g2")) & (F.col("newer") == F.col("v2")), "left_semi").select(F.col("_g").alias("g3"), F.col("older").alias("v3")).distinct()
    final = final.join(beaten, (F.col("_g") == F.col("g3")) & (F.col("_v") == F.col("v3")), "left")
    best = final.groupBy("_g", "field_name").agg(F.max(F.struct(F.col("g3").isNull().alias("top"), "timed", (-F.col("_i").cast("decimal(38,0)")).alias("neg"), F.col("_i").alias("id"))).alias("b"))
    big = df.groupBy(F.col("_g").alias("g4")).agg(F.count("*").alias("n4")).where(F.col("n4") >= min_rows)
    return best.join(big, F.col("_g") == F.col("g4"), "left_semi").select("_g", "field_name", F.col("b.id").alias("_i"))
