"""Sinks (A10-A13).

Writes are idempotent (``mode('overwrite')`` of a whole target, or of one
batch folder in the incremental job), so a retried task or job rewrites the
same files instead of duplicating rows.  Large tables are written by the
executors in parallel; nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conform import sort_by_date
from ..schema import PROCESSED_COLUMNS, STANDARD_COLUMNS
from ..session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "delayspark", name, uuid.uuid4().hex)


def sink_processed(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "Year",
                   columns: Sequence[str] = PROCESSED_COLUMNS) -> None:
    """A10: the processed table (existing columns of the 37, in order).
    Parquet partitioned by Year by default; ``fmt='csv'`` writes a headed CSV
    like the notebook's export."""
    out = df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])
    w = out.write.mode("overwrite")
    if partition_by and partition_by in out.columns:
        # one task per partition value, large ones split by size: no task x value small files
        w = out.hint("rebalance", F.col(partition_by)).write.mode("overwrite").partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def sink_unified(df: DataFrame, path: str, date_col: str = "Date") -> None:
    """The 11-column table sorted by date, as headed CSV.  The sort is a
    range-partitioned global order (ties by the other columns, so one busy
    date is spread over several tasks); part files are date-ordered."""
    out = df.select(*[F.col(f"`{c}`") for c in STANDARD_COLUMNS if c in df.columns])
    sort_by_date(out, date_col).write.mode("overwrite").option("header", True).csv(path)


def land_yearly_csv(df: DataFrame, path: str, stem: str, date_col: str = "Date") -> None:
    """Headed CSV files named ``<stem>-<year>-<n>.csv`` in one folder (file system renames only)."""
    spark, key = df.sparkSession, "__year"
    df.withColumn(key, F.year(date_col)).hint("rebalance", F.col(key)).write.mode("overwrite") \
        .partitionBy(key).option("header", True).csv(f"{path}/parts")
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        year = folder.getPath().getName().removeprefix(f"{key}=")
        if not folder.isDirectory():
            continue
        files = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
        for n, f in enumerate(files):
            fs.rename(f, jvm.org.apache.hadoop.fs.Path(f"{path}/{stem}-{year}-{n}.csv"))
    fs.delete(root, True)


def sink_catalogue(datasets: DataFrame, path: str, source_url: str = "", api_endpoint: str = "") -> None:
    """Catalogue datasets as JSON lines under ``path/datasets`` and a
    one-row header (total, timestamp, source) under ``path/header``.  The
    total is counted by the executors, not by gathering the datasets."""
    datasets.write.mode("overwrite").json(os.path.join(path, "datasets"))
    header = datasets.agg(F.count(F.lit(1)).alias("total_datasets")).select(
        "total_datasets", F.lit(dt.datetime.now(dt.timezone.utc).isoformat()).alias("scraped_at"),
        F.lit(source_url).alias("source_url"), F.lit(api_endpoint).alias("api_endpoint"))
    header.coalesce(1).write.mode("overwrite").json(os.path.join(path, "header"))


def sink_manifest(files: DataFrame, path: str, file_col: str = "path") -> None:
    """Download manifest - one row per file (with its status) plus a
    header row with the total and the time of the run."""
    files.write.mode("overwrite").json(os.path.join(path, "files"))
    files.agg(F.count(F.lit(1)).alias("total_files"), F.count_distinct(F.col(file_col)).alias("distinct_files")) \
         .withColumn("downloaded_at", F.lit(dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))) \
         .coalesce(1).write.mode("overwrite").json(os.path.join(path, "header"))
