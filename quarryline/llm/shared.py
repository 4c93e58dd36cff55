"""Shared storage and heavy-hitter helpers of the corpus operators."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder (tests, a laptop).
LOCAL_FALLBACK = "file:///tmp/checkpoints"

#: A value in over this share of the rows is treated on its own. The number of
#: such values is at most its reciprocal, whatever the size of the input.
HEAVY_SHARE = 1 / 2000

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_FALLBACK
    # a path without a scheme is in Spark's file system, whoever reads it
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    base = re.sub(r"^file:/+", "file:///", base)
    path = f"{base.rstrip('/')}/quarryline-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_remove_at_exit, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has already ended: the folder stays for the cluster's own clean-up
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a
    lost executor costs a reread of files, not a rerun of what made them."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables in the shared folder that are dropped when they have been used."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop_but()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop_but(self, *tables: DataFrame) -> None:
        self.drop(*[df for df, _ in self.paths if not any(df is t for t in tables)])

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for df, p in self.paths if any(df is t for t in tables)]:
            remove(self.spark, path)
        self.paths = [(df, p) for df, p in self.paths if not any(df is t for t in tables)]


def heavy_values(df: DataFrame, column: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Misra-Gries: every value of `column` in over `share` of the rows is among the
    at most 1/share rows returned; others may be among them."""
    return df.freqItems([column], share).select(F.explode(f"{column}_freqItems").alias(column))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't among those of dropped(id); nulls are equal to nulls."""
    (name,) = unused(docs, "dropped_id")
    return docs.join(dropped.toDF(name), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among those of ids(id); nulls are equal to nulls."""
    (name,) = unused(rows, "wanted_id")
    return rows.join(ids.toDF(name), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def repeated_ids(rows: DataFrame, id_col: str = "doc_id") -> DataFrame | None:
    """The ids of several rows, as a table of one column, or None if there are none."""
    found = materialize(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col), "repeated-ids")
    return None if found.isEmpty() else found
