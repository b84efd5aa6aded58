"""Items of varying length packed into containers of fixed capacity by the sum-of-squares rule.

An item goes to the fill level (a partly filled container of that level, or a new one) that leaves the smallest sum of
squared counts of partly filled containers per level. The counts live in one array per capacity with an entry per
level, so a placement looks at `capacity` numbers whatever the number of items, and containers of equal level are
interchangeable.

Only items longer than the capacity are split: into full pieces, each a container of its own, and a rest that is packed
like any item. Items are spread over tasks by a hash of their id into streams of about `stream_items`; each stream is
packed on its own. The containers that streams leave partly filled are then packed again as whole units, in rounds with
ever fewer streams, so that the unused space does not grow with the number of tasks.

Defined cases: an item of size 0 or null goes into no container; equal ids are told apart by their row's size only, so
ids should be unique; an empty table gives an empty result; capacities must be positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import stage


class SumOfSquares:
    """Online packing of one stream into containers of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)  # partly filled containers by fill level
        self.open: dict[int, list[int]] = {}  # containers by fill level
        self.made = 0

    def place(self, size: int) -> int:
        """The number of the container the item goes to."""
        c, n = self.capacity, self.level
        if size >= c:
            self.made += 1
            return self.made - 1
        # putting it into level h takes one from n[h] and adds one to n[h + size]: the sum of squares changes by
        # 2 (n[h + size] - n[h]) + 2; into a new container by 2 n[size] + 1; filling one up by 1 - 2 n[h]
        last = c - size
        change = 2 * (n[size : c + 1] - n[: last + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[last] = 1 - 2 * n[last]
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        h = int(change.argmin())
        if h == 0:
            box, self.made = self.made, self.made + 1
        else:
            box = self.open[h].pop()
            n[h] -= 1
        if h + size < c:
            n[h + size] += 1
            self.open.setdefault(h + size, []).append(box)
        return box


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches come sorted by spec and stream; a packer lives as long as its stream of one spec."""
    at, packer = None, None
    for df in batches:
        boxes = np.empty(len(df), dtype=np.int64)
        for i, (spec, s, n, c) in enumerate(zip(df["spec_id"].to_numpy(), df["stream"].to_numpy(), df["size"].to_numpy(), df["capacity"].to_numpy())):
            if (spec, s) != at:
                at, packer = (spec, s), SumOfSquares(int(c))
            boxes[i] = packer.place(int(n))
        yield df.assign(box=boxes)


def packed(items: DataFrame, specs: DataFrame, id_col: str, size_col: str, stream_items: int = 50_000, rounds: int = 2, max_specs: int = 1000) -> DataFrame:
    """(spec_id, capacity, id, piece, start, size, container, fill) with a row for each piece of each item under each
    spec (spec_id, capacity). container is unique within a spec; fill is its sum of sizes. items need a size column."""
    kind = items.schema[id_col].dataType.simpleString()
    # staged, so that sizes that are costly to compute are computed once
    base = stage(items.where(F.col(size_col) > 0).select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")))
    capacities = specs.where("capacity > 0").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("long").alias("capacity")).distinct()
    listed = [(r["spec_id"], r["capacity"]) for r in capacities.limit(max_specs + 1).collect()]
    if len(listed) > max_specs:
        raise ValueError(f"more than {max_specs} specs")
    schema = f"spec_id int, capacity long, id {kind}, piece int, start long, size long, container string, fill long"
    if not listed:
        return items.sparkSession.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).alias("capacity")) for s, c in listed]))
    pieces = base.withColumn("s", each).select("id", "n", "s.spec_id", "s.capacity")
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("int"))))
    pieces = pieces.withColumn("start", F.col("piece") * F.col("capacity")).withColumn("size", F.least("capacity", F.col("n") - F.col("start")))
    full = pieces.where("size = capacity").select("spec_id", "capacity", "id", "piece", "start", "size", F.concat(F.lit("f"), F.xxhash64(F.col("id").cast("string")).cast("string"), F.lit("-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.col("size").alias("fill"))
    rest = pieces.where("size < capacity")
    n_items = base.count()
    streams = max(1, round(n_items / stream_items))
    # a stream is packed by one task, its items in a fixed pseudo-random order
    first = rest.withColumn("stream", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(streams)))
    placed = stage(_round(first.withColumn("o", F.xxhash64(F.col("id").cast("string"), F.lit(7))), f"id {kind}, spec_id int, capacity long, piece int, start long, size long, stream long", streams * len(listed)))
    name = F.concat_ws("-", F.lit("s0"), "stream", "box")
    current = placed.select("spec_id", "capacity", "id", "piece", "start", "size", name.alias("container"))
    moved = []
    boxes = placed.groupBy("spec_id", "capacity", "stream", "box").agg(F.sum("size").alias("fill")).select("spec_id", "capacity", "fill", F.concat_ws("-", F.lit("s0"), "stream", "box").alias("container"))
    for k in range(1, rounds + 1):
        if streams == 1:
            break
        streams = max(1, streams // 16)
        part = boxes.where("fill < capacity")
        part = part.withColumn("stream", F.pmod(F.xxhash64("container"), F.lit(streams)))
        again = stage(_round(part.withColumn("size", F.col("fill")).withColumn("o", F.xxhash64("container", F.lit(k))), "container string, spec_id int, capacity long, size long, stream long", streams * len(listed)))
        renamed = again.select(F.col("spec_id").alias("sp"), F.col("container").alias("old"), F.concat_ws("-", F.lit(f"s{k}"), "stream", "box").alias("new"))
        moved.append(renamed)
        boxes = again.groupBy("spec_id", "capacity", "stream", "box").agg(F.sum("size").alias("fill")).select("spec_id", "capacity", "fill", F.concat_ws("-", F.lit(f"s{k}"), "stream", "box").alias("container")).unionByName(boxes.where("fill >= capacity"))
    for renamed in moved:
        current = current.join(renamed, (F.col("spec_id") == F.col("sp")) & (F.col("container") == F.col("old")), "left").withColumn("container", F.coalesce("new", "container")).drop("sp", "old", "new")
    fills = boxes.select(F.col("spec_id").alias("sp"), F.col("container").alias("c"), "fill")
    done = current.join(fills, (F.col("spec_id") == F.col("sp")) & (F.col("container") == F.col("c"))).drop("sp", "c")
    columns = ["spec_id", "capacity", "id", "piece", "start", "size", "container", "fill"]
    return done.select(*columns).unionByName(full.select(*columns))


def _round(df: DataFrame, schema: str, streams: int) -> DataFrame:
    columns = [x.split()[0] for x in schema.split(", ")]
    ordered = df.repartition(min(max(streams, 1), 4096), "spec_id", "stream").sortWithinPartitions("spec_id", "stream", "o").select(*columns)
    return ordered.mapInPandas(_pack, schema + ", box long")


def fill_report(result: DataFrame) -> DataFrame:
    """(spec_id, capacity, items, containers, tokens, used_share): how full the containers are."""
    boxes = result.groupBy("spec_id", "capacity", "container").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    sums = boxes.groupBy("spec_id", "capacity").agg(F.sum("n").alias("items"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
