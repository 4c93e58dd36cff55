"""Exact duplicates: a heavy-hitter split around an ordinary shuffle.

Misra-Gries finds the digests that could fill a task on their own. Their winners are
verified by an exact count and broadcast (at most 1/HEAVY_SHARE rows), so rows of such
digests are settled where they are read. The other digests, each in under HEAVY_SHARE of
the rows, are dealt out by an ordinary shuffle of narrow rows; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HEAVY_SHARE, heavy_values, materialize, repeated_ids, text_or_empty, unused, with_ids, without_ids

#: Characters that don't count when texts are compared.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, "")


def _order() -> Column:
    """The row that stays: most code points, smallest id (none: last), first row."""
    return F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("row_no").alias("row_no"))


def duplicate_groups(docs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per row of docs.

    Texts are equal when identical after SPACES are deleted; null counts as empty. Of
    equal texts the one with the most code points stays, then the one with the smallest
    doc_id; a null doc_id comes last. Rows that repeat a text and a doc_id count each,
    and one of them stays. Columns other than doc_id and text play no part.
    """
    keys = docs.select(
        F.col("doc_id"),
        F.sha2(normalised("text"), 256).alias("text_sha256"),
        F.length(text_or_empty("text")).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    keys = materialize(keys, "digests")
    least = keys.count() * share
    best, size = F.min(_order()), F.count(F.lit(1))
    winners = (
        keys.join(F.broadcast(heavy_values(keys, "text_sha256", share)), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(best.alias("best"), size.alias("group_size")).filter(F.col("group_size") >= least)
    )
    winners = materialize(winners, "winners")  # at most 1/share rows
    hot = keys.join(F.broadcast(winners), "text_sha256")
    rest = keys.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # groups are combined where they are read; a text of one row needs no group
    groups = rest.groupBy("text_sha256").agg(best.alias("best"), size.alias("group_size")).filter("group_size > 1")
    rest = rest.join(groups, "text_sha256", "left").withColumn("best", F.coalesce("best", _order())).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    return hot.unionByName(rest).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only the ids of dropped rows meet the texts again. Rows whose doc_id repeats, and no
    others, are told apart by their digest; of rows that repeat both, one stays.
    """
    groups = materialize(duplicate_groups(docs, share), "groups")
    repeated = repeated_ids(groups)
    if repeated is None:
        return without_ids(docs, groups.filter("NOT kept").select("doc_id"))
    keep = with_ids(groups.filter("kept").select("doc_id", "text_sha256"), repeated)
    dropped = groups.filter("NOT kept").select("doc_id").unionByName(repeated)
    return without_ids(docs, dropped).unionByName(_with_repeated_ids(with_ids(docs, repeated), keep))


def _with_repeated_ids(docs: DataFrame, keep: DataFrame) -> DataFrame:
    sha, size, rank, key, key_sha = unused(docs, "sha", "size", "rank", "key", "key_sha")
    marked = docs.withColumn(sha, F.sha2(normalised("text"), 256)).withColumn(size, F.length(text_or_empty("text")))
    keep = keep.toDF(key, key_sha)
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(key_sha)), "left_semi")
    order = Window.partitionBy("doc_id", sha).orderBy(F.desc(size))
    return kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)
