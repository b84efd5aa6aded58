"""Session helpers: tables by path, lineage cuts in the shared folder, size checks before a broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quillon", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder this process chose for a session whose settings name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (as in tests) a temporary one of this session, which
    only a local master may use."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _OWN.setdefault(context.applicationId, os.path.join(tempfile.gettempdir(), f"quillon-{context.applicationId}"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stage(df: DataFrame) -> DataFrame:
    """df written as a compressed Parquet table in the shared folder and read back; smaller on disk than a
    checkpoint, and its later reads prune columns. The folder's owner clears it with the other checkpoints."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint for df if it is proven to have at most max_rows rows, else df as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, so that helper columns never clash with the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held(x: Column) -> Column:
    """x, formally not deterministic: a later filter on it then stays above the projection that computes it, and later
    projections use its value. Pushed down or inlined, it would be computed again at every use."""
    return F.when(F.monotonically_increasing_id() >= 0, x)
