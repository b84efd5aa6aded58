"""Exports: every row leaves through one function that applies the suppression list."""

from __future__ import annotations

import codecs
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.leads import suppressed


def exportable(rows: DataFrame, suppression: DataFrame, email_cols: list[str], name_col: str) -> DataFrame:
    """rows that no suppression entry covers."""
    return suppressed(rows, suppression, email_cols, name_col).where("suppression_reason is null").drop("suppression_reason")


def write_csv(rows: DataFrame, suppression: DataFrame, path: str, email_cols: list[str], name_col: str) -> None:
    """A folder of CSV parts with a header, nulls as empty fields; arrays and maps become text."""
    flat = exportable(rows, suppression, email_cols, name_col)
    text = [F.array_join(c, "; ").alias(c) if t.startswith("array<") else F.to_json(c).alias(c) if t.startswith(("map<", "struct<")) else F.col(c) for c, t in flat.dtypes]
    flat.select(*text).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def write_single_csv(rows: DataFrame, suppression: DataFrame, path: str, email_cols: list[str], name_col: str) -> None:
    """One local file with a byte order mark, for spreadsheet programs; for exports small enough for one task."""
    parts = path + ".parts"
    write_csv(rows.coalesce(1), suppression, parts, email_cols, name_col)
    with open(path, "wb") as out:
        out.write(codecs.BOM_UTF8)
        for name in sorted(x for x in os.listdir(parts) if x.startswith("part-")):
            with open(os.path.join(parts, name), "rb") as f:
                shutil.copyfileobj(f, out)
    shutil.rmtree(parts)


def write_parquet(rows: DataFrame, suppression: DataFrame, path: str, email_cols: list[str], name_col: str, partition_by: list[str] | None = None) -> None:
    exportable(rows, suppression, email_cols, name_col).write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
