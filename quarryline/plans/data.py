"""The test tables as repositories: files, chunks, snapshots, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.chunkers import window_chunks
from quarryline.operators.rounds import by_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: the source is the repo, lang and id make the path."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("repo"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_chunks(files(spark, sf_dir)).withColumn("hash", F.md5("body"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("repo", "path", F.md5("text").alias("hash"), "doc_id")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the files: some ids missing, some texts changed in the first; others missing in the second."""
    all_files = files(spark, sf_dir)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    prev = all_files.filter("doc_id % 7 <> 0").withColumn("text", text)
    return prev, all_files.filter("doc_id % 11 <> 0")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as definitions: the name is ambiguous, the brand is the file."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("p"), key.cast("string")).alias("id"), F.lit("function").alias("kind"), F.lit("c").alias("lang"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"),
        (key % 1000).cast("int").alias("start_line"), (key % 1000 + 5).cast("int").alias("end_line"), key.cast("long").alias("seq"),
    )


def named_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call per line item: from the part with the supplier's number to the name of the part sold."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part")
    to = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    own = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_brand").alias("path"))
    # the first line of each name before the file is looked up: calls are far fewer than line items
    calls = item.join(by_count(to), "l_partkey").groupBy("l_suppkey", "name").agg(F.min("l_orderkey").alias("first")).join(by_count(own.distinct()), "l_suppkey")
    return calls.select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("src"), "name", "path", (F.col("first") % 1000).cast("int").alias("line"), F.lit("CALLS").alias("kind"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct calls: supplier to part, once each."""
    item = table(spark, sf_dir, "lineitem")
    one = item.groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return one.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("CALLS").alias("kind"), F.lit("EXACT").alias("resolution"), F.lit(1.0).alias("confidence"), "line")


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as watch events of a path per user."""
    kind = F.when(F.col("event_type") == "click", "MODIFY").when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", "DELETE").otherwise("RENAME")
    return table(spark, sf_dir, "events").select(F.lit("r").alias("repo"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))
