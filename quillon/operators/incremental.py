"""Which stored records still have to be taken over: a Merkle comparison of key ranges, and its atomic publishing.

The current state (newest record of each listing) and the state taken over so far are each reduced to one digest per
key range (leaf) with a map-side combined aggregation. Leaves fold into parents, `fanout` to one, up to a root. The
comparison starts at the root and joins only the children of nodes whose digests differ, so that listings are read
back and compared one by one only inside leaves that changed.

`Ledger` keeps what was taken over. A run reduces the current state to digests, descends in the saved tree, reads the saved
rows of changed leaves only, and publishes its output together with the new rows and digests of the changed buckets
(runs of leaves); all other buckets stay where earlier versions wrote them.

Defined cases: letter case of a hash is ignored; a null hash is unknown content and never equals anything, so its
record is always due; a null source_id is a source of its own; a record with neither external_id nor url is not a
listing and is never due; repeated book_source rows count as one unless one of them differs from the current content,
which makes the record due; a raw_record_id without a raw_record counts as null; an empty input gives an empty result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import cut, stage


def listing_key(source_id: Column, external_id: Column, url: Column) -> Column:
    """Identity of a listing within its source: the external id, or the URL where that is null; null if both are."""
    source = F.coalesce(F.concat(F.lit("s:"), source_id), F.lit("n:"))
    own = F.coalesce(F.concat(F.lit("e:"), external_id), F.concat(F.lit("u:"), url))
    return F.concat(source, F.lit("\u0001"), own)


def newest_records(raw_record: DataFrame) -> DataFrame:
    """(key, record_id, state): the newest record of each listing by fetched_at, then record_id."""
    latest = F.max(F.struct(F.col("fetched_at"), F.col("record_id"), F.lower("content_hash").alias("state")))
    keyed = raw_record.select(listing_key(F.col("source_id"), F.col("external_id"), F.col("url")).alias("key"), "fetched_at", "record_id", "content_hash")
    grouped = keyed.where("key is not null").groupBy("key").agg(latest.alias("m"))
    return grouped.select("key", F.col("m.record_id").alias("record_id"), F.col("m.state").alias("state"))


def taken_over(book_source: DataFrame, raw_record: DataFrame) -> DataFrame:
    """(key, state): the content each listing row was taken over with; a null state is unknown content."""
    content = raw_record.select(F.col("record_id").alias("raw_record_id"), F.lower("content_hash").alias("state"))
    rows = book_source.select(listing_key(F.col("source_id"), F.col("external_id"), F.col("url")).alias("key"), "raw_record_id")
    return rows.where("key is not null").join(content, "raw_record_id", "left").select("key", "state").distinct()


class MerkleTree:
    """Digests of key ranges. leaves is the number of ranges, a power of fanout, chosen from the row count so that a
    leaf holds about rows_per_leaf listings whatever the size; the tree itself then has about rows / rows_per_leaf rows."""

    def __init__(self, fanout: int = 256, rows_per_leaf: int = 8, depth: int | None = None):
        self.fanout, self.rows_per_leaf, self.depth = fanout, rows_per_leaf, depth

    def sized_for(self, rows: int) -> "MerkleTree":
        depth = 1
        while self.fanout**depth * self.rows_per_leaf < rows and depth < 7:
            depth += 1
        return MerkleTree(self.fanout, self.rows_per_leaf, depth)

    def leaf_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.fanout**self.depth))

    def leaves(self, state: DataFrame, unknown: str = "?") -> DataFrame:
        """(level, node, digest) of the leaves of (key, state) rows; order and partitioning do not matter. `unknown`
        stands for a null state: two sides with different marks differ wherever either has one."""
        known = F.coalesce("state", F.lit(unknown))
        digest = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", known)).alias("x"), F.bit_xor(F.xxhash64(known, "key", F.lit(1))).alias("y"))
        return state.groupBy(self.leaf_of(F.col("key")).alias("node")).agg(digest.alias("digest")).select(F.lit(self.depth).alias("level"), "node", "digest")

    @staticmethod
    def _digest() -> Column:
        return F.struct(F.sum("digest.n").alias("n"), F.bit_xor(F.xxhash64("node", "digest")).alias("x"), F.bit_xor(F.xxhash64("digest", "node", F.lit(1))).alias("y"))

    def levels(self, leaves: DataFrame) -> DataFrame:
        """The levels below the root. A node's digest covers the hashes of all leaves under it, so that every level comes
        from one aggregation of the leaves."""
        if self.depth == 1:
            return leaves
        ups = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("node") / self.fanout ** (self.depth - i)).cast("long").alias("up")) for i in range(1, self.depth)]))
        above = leaves.withColumn("at", ups).groupBy(F.col("at.level").alias("level"), F.col("at.up").alias("up")).agg(self._digest().alias("digest"))
        return leaves.unionByName(above.select("level", F.col("up").alias("node"), "digest"))

    def with_root(self, levels: DataFrame) -> DataFrame:
        """The levels and the root, which covers the at most `fanout` nodes of level 1."""
        root = levels.where("level = 1").groupBy(F.lit(0).alias("l")).agg(self._digest().alias("digest"))
        return levels.unionByName(root.select(F.col("l").alias("level"), F.lit(0).cast("long").alias("node"), "digest"))

    def tree(self, leaves: DataFrame) -> DataFrame:
        """All levels, the root at level 0."""
        return self.with_root(self.levels(leaves))

    def bucket_of(self, node: Column, level: Column, buckets: int) -> Column:
        """The bucket of a node; buckets divides the fanout, so a bucket holds whole nodes of every level."""
        return F.floor(node / (F.pow(F.lit(float(self.fanout)), level) / buckets)).cast("int")

    def changed_leaves(self, current: DataFrame, saved: DataFrame) -> DataFrame:
        """(node): leaves whose digests differ, found from the root down; below an equal node nothing is joined."""
        differing = None
        for level in range(self.depth + 1):
            a = current.where(F.col("level") == level).select("node", F.col("digest").alias("a"))
            b = saved.where(F.col("level") == level).select("node", F.col("digest").alias("b"))
            if differing is not None:
                parent = F.floor(F.col("node") / self.fanout).cast("long")
                up = differing.select(F.col("node").alias("up"))
                a = a.join(up, parent == F.col("up"), "left_semi")
                b = b.join(up, parent == F.col("up"), "left_semi")
            differing = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        return differing


def _due(current: DataFrame, saved: DataFrame) -> DataFrame:
    """The rows of current whose state is not the one and only saved state of their key."""
    there = saved.groupBy("key").agg(F.count("*").alias("n"), F.max("state").alias("known"), F.count("state").alias("n_known"))
    same = (F.col("n") == 1) & (F.col("n_known") == 1) & (F.col("known") == F.col("state"))
    return current.join(there, "key", "left").where(~F.coalesce(same, F.lit(False))).select(*current.columns)


def due_records(raw_record: DataFrame, book_source: DataFrame, tree: MerkleTree | None = None) -> DataFrame:
    """(record_id): the newest record of every listing whose content has not been taken over, each once; without a
    ledger, by two trees built on the spot."""
    current, saved = stage(newest_records(raw_record)), stage(taken_over(book_source, raw_record))
    tree = (tree or MerkleTree()).sized_for(current.count())
    trees = [cut(tree.tree(tree.leaves(x, mark))) for x, mark in ((current.select("key", "state"), "?now"), (saved, "?then"))]
    leaves = tree.changed_leaves(*trees)
    inside = current.join(leaves, tree.leaf_of(F.col("key")) == F.col("node"), "left_semi")
    return _due(inside, saved).select("record_id")


class Ledger:
    """Output, state and tree of each run, published together: all are written under a new version, then one rename of a
    small pointer file makes them current. A run that dies before the rename leaves the previous version in force, so
    the next run finds the same records again; one that dies after it has repeated nothing. State and tree lie in
    buckets of leaves; a version names the folder of each bucket, of which a run writes only those that changed."""

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = 50_000):
        self.spark, self.path, self.rows_per_bucket = spark, path.rstrip("/"), rows_per_bucket
        jvm = spark.sparkContext._jvm
        self._P = jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        """The published version: {"version", "output", "state", "tree", "depth", "buckets"}; None before the first.
        state and tree map a bucket to its folder."""
        pointers = [s.getPath().getName() for s in (self._fs.globStatus(self._P(f"{self.path}/current-*.json")) or [])]
        if not pointers:
            return None
        newest = max(pointers, key=lambda x: int(x.split("-")[1].split(".")[0]))
        line = self.spark.read.text(f"{self.path}/{newest}").first()
        return json.loads(line[0])

    def _read(self, folders: dict[str, str], schema: str, only: set[str] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(folders.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self, entry: dict, only: set[str] | None = None) -> DataFrame:
        """(key, state) of a version, of all buckets or only some."""
        return self._read(entry["state"], "key string, state string", only)

    def tree(self, entry: dict) -> DataFrame:
        """The saved levels of a version, without the root."""
        return self._read(entry["tree"], "level int, node bigint, digest struct<n: bigint, x: bigint, y: bigint>")

    def _folders(self, base: str) -> dict[str, str]:
        return {s.getPath().getName().split("=")[1]: f"{base}/{s.getPath().getName()}" for s in (self._fs.globStatus(self._P(f"{base}/bucket=*")) or [])}

    def publish(self, output: DataFrame, state: DataFrame, tree: MerkleTree, buckets: int, kept: dict | None = None, fail_before_commit: bool = False) -> dict:
        """Writes output, the state (key, state) and its tree, then commits. kept is a version whose folders stay in
        force for the buckets named in its state and tree. fail_before_commit is for tests."""
        old = self.current()
        number = (old["version"] if old else 0) + 1
        base = f"{self.path}/v{number}-{uuid.uuid4().hex[:8]}"
        output.write.parquet(f"{base}/output")
        leaf = tree.leaf_of(F.col("key"))
        state.select("key", "state", tree.bucket_of(leaf, F.lit(tree.depth), buckets).alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/state")
        folders = self._folders(f"{base}/state")
        saved = self._read(folders, "key string, state string")
        levels = tree.levels(tree.leaves(saved, "?then"))
        levels.withColumn("bucket", tree.bucket_of(F.col("node"), F.col("level"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/tree")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        entry = {"version": number, "output": f"{base}/output", "depth": tree.depth, "buckets": buckets}
        entry |= {"state": (kept["state"] if kept else {}) | folders, "tree": (kept["tree"] if kept else {}) | self._folders(f"{base}/tree")}
        tmp, final = self._P(f"{base}/pointer"), self._P(f"{self.path}/current-{number}.json")
        stream = self._fs.create(tmp)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if not self._fs.rename(tmp, final):
            raise RuntimeError(f"another run published version {number}")
        return entry

    def _sized(self, rows: int) -> tuple[MerkleTree, int]:
        tree = MerkleTree().sized_for(rows)
        most = max(1, rows // self.rows_per_bucket)
        return tree, max(d for d in range(1, tree.fanout + 1) if tree.fanout % d == 0 and d <= most)

    def adopt(self, state: DataFrame) -> dict:
        """Publishes what was taken over before there was a ledger, (key, state), as the first version."""
        state = stage(state.select("key", "state"))
        tree, buckets = self._sized(state.count())
        nothing = self.spark.createDataFrame([], "record_id bigint, key string, state string")
        return self.publish(nothing, state, tree, buckets)

    def run(self, raw_record: DataFrame, fail_before_commit: bool = False) -> DataFrame:
        """One incremental run: the newest records whose (key, state) the last published version does not have."""
        current = stage(newest_records(raw_record))  # one snapshot for the output and the state
        old, pairs, kept = self.current(), current.select("key", "state"), None
        tree, buckets = self._sized(current.count())
        if old is None:
            due, state = current, pairs
        else:
            if tree.depth > old["depth"]:  # outgrown: all leaves change
                saved = inside_saved = self.state(old)
                due = _due(current, saved)
            else:
                tree, buckets = MerkleTree(depth=old["depth"]), old["buckets"]
                leaf, leaf_bucket = tree.leaf_of(F.col("key")), tree.bucket_of(tree.leaf_of(F.col("key")), F.lit(tree.depth), buckets)
                mine = cut(tree.levels(tree.leaves(pairs, "?now")))
                leaves = cut(tree.changed_leaves(tree.with_root(mine), tree.with_root(self.tree(old))))
                touched = {str(r[0]) for r in leaves.select(tree.bucket_of(F.col("node"), F.lit(tree.depth), buckets)).distinct().collect()}  # at most the fanout
                inside_saved = self.state(old, touched)
                due = _due(current.join(leaves, leaf == F.col("node"), "left_semi"), inside_saved.join(leaves, leaf == F.col("node"), "left_semi"))
                pairs = pairs.where(leaf_bucket.cast("string").isin(sorted(touched))) if touched else pairs.limit(0)
                kept = {k: {b: p for b, p in old[k].items() if b not in touched} for k in ("state", "tree")}
            # what was taken over and is gone from the records stays known
            state = pairs.unionByName(inside_saved.join(pairs.select("key"), "key", "left_anti").select("key", "state"))
        entry = self.publish(due.select("record_id", "key", "state"), state, tree, buckets, kept, fail_before_commit)
        return self.spark.read.parquet(entry["output"])
