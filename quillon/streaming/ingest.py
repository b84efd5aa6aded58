"""The same transforms over a landing directory that grows: Structured Streaming with a content-hash gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.normalize import content_hash, normalize_books


def read_reports(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of raw reports as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_reports(reports: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Each content once per source within the watermark; state older than it is dropped."""
    hashed = reports.withColumn("content_hash", content_hash(reports))
    return hashed.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["source_id", "content_hash"])


def reports_per_window(reports: DataFrame, window: str = "1 day", watermark: str = "7 days") -> DataFrame:
    """(source_id, from, reports): counts by tumbling window of event time; rows later than the watermark drop out."""
    return reports.withWatermark("fetched_at", watermark).groupBy(F.window("fetched_at", window), "source_id").agg(F.count("*").alias("reports")).select("source_id", F.col("window.start").alias("from"), "reports")


def ingest(reports: DataFrame, target: str, checkpoint: str, as_of_year: int, once: bool = True, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Normalised books of new content, appended to a folder per batch. The gate is exact and has no horizon: each batch
    is anti-joined with the hashes already written. A batch that is run again overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        hashed = df.withColumn("content_hash", content_hash(df))
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(target)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        earlier = [p.toString() for p in done if p.getName().startswith("batch=") and p.getName() != f"batch={number}"]
        first = hashed.groupBy("source_id", "content_hash").agg(F.min_by(F.struct(*df.columns), "raw_id").alias("r"))
        if earlier:
            seen = spark.read.parquet(*earlier).select("source_id", "content_hash").distinct()
            first = first.join(seen, ["source_id", "content_hash"], "left_anti")
        new = first.select("content_hash", "r.*")
        books = normalize_books(new.drop("content_hash"), as_of_year).join(new.select("raw_id", "content_hash"), "raw_id")
        books.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if then:
            then(spark.read.parquet(f"{target}/batch={number}"), number)

    writer = reports.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
