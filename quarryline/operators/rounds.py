"""Tables between the rounds of an iterative operator."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local session that names no folder (tests, a laptop).
LOCAL_FALLBACK = "file:///tmp/checkpoints"
#: A table of up to so many rows is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 200_000
_cleaned: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below the one that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_FALLBACK
    # a path without a scheme is in Spark's file system, whoever reads it
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    path = f"{re.sub(r'^file:/+', 'file:///', base).rstrip('/')}/quarryline-rounds-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_remove_at_exit, spark, path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove_folder(spark, path)
    except Exception:  # the session has already ended: the folder stays for the cluster's own clean-up
        pass


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def table_between_rounds(df: DataFrame) -> DataFrame:
    """Cuts lineage: a table in the folder that the cluster shares."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_count(table: DataFrame) -> DataFrame:
    """A saved table as one side of a join: broadcast if its rows are few, else never. Spark alone
    goes by the size of its files, and ids that compress well are many times that in the driver."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


class Rounds:
    """Tables of successive rounds: those of a round that is over can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop_but(self, *tables: DataFrame) -> None:
        for df, path in self.paths:
            if not any(df is t for t in tables):
                remove_folder(self.spark, path)
        self.paths = [(df, p) for df, p in self.paths if any(df is t for t in tables)]
