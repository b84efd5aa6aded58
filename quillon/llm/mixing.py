"""A selection of documents whose sources contribute target shares of the total size.

For each mix the total T is as large as the repeat limits let the shares be met: the least of max_repeat * size / share
over the sources that have documents. A source's budget is its share of T. Whole passes over a source come first
(budget div size of the source); the rest is drawn by weighted sampling without replacement: document i with weight w
gets the key -ln(u) / w from a hash-based uniform u (the order of the Efraimidis-Spirakis keys u^(1/w)), and documents
are taken in key order up to what is left of the budget. The one further document whose size is nearest to the part
still open then closes it, if that brings the source nearer to its budget.

Running sizes are exact at any size of a source: keys are cut into blocks, block sums are added up first (a bounded
number per source), and only rows within one block are ordered in one task.

Defined cases: a source without documents, with size 0 or share 0 contributes nothing and is reported with a share
reached of 0; its part of T stays empty, so the other sources keep their proportions; documents of size 0 or null are
never selected; null or non-positive weights count as the smallest weight; a mix of which no source has documents
selects nothing; repeated (mix, source) targets are added up, with the smallest repeat limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut, small, stage

BLOCKS = 1024
RUN = 32  # cuts are looked up in runs of this many


def sampling_key(id_col: Column, weight: Column, seed: int = 17) -> Column:
    """-ln(u) / weight with u uniform in (0, 1) from a hash of the id; ascending order is the order of selection."""
    u = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.greatest(F.coalesce(F.when(weight > 0, weight), F.lit(1e-6)), F.lit(1e-6))


def text_quality(text: Column) -> Column:
    """A weight in (0, 1]: texts of letters and of some length weigh more than scraps and markup."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.01), letters * letters * (n / (n + F.lit(200.0))))


def running_sizes(items: DataFrame, blocks: int = BLOCKS, max_sources: int = 100_000) -> DataFrame:
    """items (source, id, size, key) with `upto`: the size of the source's rows up to and including this one in order
    of key, then id. A source's rows are cut into blocks at quantiles of its keys."""
    cuts = cut(items.groupBy("source").agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 4 * blocks).alias("cuts"), F.sum("size").alias("source_size")))
    cuts = cuts.select(F.col("source").alias("cs"), "source_size", "cuts", F.filter("cuts", lambda _, i: i % RUN == RUN - 1).alias("heads"))
    placed = items.join(small(cuts, max_sources), items["source"].eqNullSafe(F.col("cs")))
    # the number of cuts below the key: whole runs by their last cuts, then within one run
    placed = placed.withColumn("run", F.size(F.filter("heads", lambda x: x < F.col("key"))))
    inside = F.filter(F.slice("cuts", F.col("run") * RUN + 1, F.lit(RUN)), lambda x: x < F.col("key"))
    placed = placed.select("source", "id", "size", "key", "source_size", (F.col("run") * RUN + F.size(inside)).alias("block"))
    # a stated number of partitions is not coalesced: the rows are small in bytes, but not in work
    placed = placed.repartition(max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "source", "block")
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("in_block"))
    over = Window.partitionBy("source").orderBy("block")  # at most `blocks` rows a source
    below = sums.select(F.col("source").alias("s2"), F.col("block").alias("b2"), (F.sum("in_block").over(over) - F.col("in_block")).alias("below"))
    within = Window.partitionBy("source", "block").orderBy("key", "id")
    run = placed.withColumn("in", F.sum("size").over(within))
    joined = run.join(below, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    return joined.select("source", "id", "size", "source_size", (F.col("below") + F.col("in")).alias("upto"))


def mixed(items: DataFrame, targets: DataFrame, seed: int = 17, max_targets: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(selection, report). items: source, id, size, weight. targets: mix_id, source, target_share, max_repeat.

    selection: mix_id, source, id, size, repeats (at least 1, at most the limit). report: a row per target with
    target_share, available (size of the source), selected (size with repeats), reached_share and documents."""
    goals = targets.where("target_share > 0").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeat").alias("max_repeat"))
    wanted = goals.select("source").distinct()
    rows = items.where("size > 0").select("source", "id", F.col("size").cast("long").alias("size"), sampling_key(F.col("id").cast("string"), F.col("weight").cast("double"), seed).alias("key"))
    rows = stage(rows.join(small(wanted, max_targets), "source", "left_semi"))
    run = stage(running_sizes(rows))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("available"))
    plan = goals.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    whole = Window.partitionBy("mix_id")
    limit = F.when((F.col("available") > 0) & (F.col("max_repeat") > 0), F.col("max_repeat") * F.col("available") / F.col("target_share"))
    plan = plan.withColumn("total", F.min(limit).over(whole))
    budget = F.least(F.col("target_share") * F.col("total"), F.col("max_repeat") * F.col("available").cast("double"))
    plan = plan.withColumn("budget", F.when((F.col("available") > 0) & (F.col("max_repeat") > 0), budget).otherwise(0.0))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available") + 1e-9)).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("available")))
    plan = cut(plan)
    per = plan.where("budget > 0").select("mix_id", F.col("source").alias("ps"), "epochs", "rest", "max_repeat")
    joined = run.join(small(per, max_targets), F.col("source") == F.col("ps")).drop("ps")
    open_ = F.col("epochs") < F.col("max_repeat")
    drawn = open_ & (F.col("upto") <= F.col("rest"))
    # what the draw leaves open is closed by the one further document whose size is nearest to it, if that helps
    gaps = joined.groupBy("mix_id", "source").agg((F.max("rest") - F.coalesce(F.max(F.when(drawn, F.col("upto"))), F.lit(0))).alias("gap"))
    gaps = cut(gaps.select(F.col("mix_id").alias("gm"), F.col("source").alias("gs"), "gap"))  # at most a row per target
    after = joined.where(open_ & ~drawn).join(small(gaps, max_targets), (F.col("mix_id") == F.col("gm")) & (F.col("source") == F.col("gs")))
    after = after.where("size < 2 * gap").groupBy("gm", "gs").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "upto", "id")).alias("best"))
    last = small(cut(after.select("gm", "gs", F.col("best.id").alias("gid"))), max_targets)
    closed = joined.join(last, (F.col("mix_id") == F.col("gm")) & (F.col("source") == F.col("gs")) & (F.col("id") == F.col("gid")), "left")
    selection = closed.withColumn("repeats", F.col("epochs") + (drawn | F.col("gid").isNotNull()).cast("int")).where("repeats > 0").select("mix_id", "source", "id", "size", "repeats")
    taken = selection.groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("repeats")).alias("selected"), F.count("*").alias("documents"))
    report = plan.select("mix_id", "source", "target_share", "max_repeat", "available").join(taken, ["mix_id", "source"], "left").na.fill(0, ["selected", "documents"])
    mix_size = F.sum("selected").over(whole)
    report = report.withColumn("reached_share", F.when(mix_size > 0, F.round(F.col("selected") / mix_size, 6)).otherwise(0.0))
    return selection, report
