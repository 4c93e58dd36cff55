"""Change detection: chunk sets, manifests of files, directory rollups, incremental passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.hashing import fingerprint_md5
from quarryline.operators.rounds import table_between_rounds


class NullKey(ValueError):
    """A chunk without a key: the whole sync fails and the table stays as it was."""


def latest_per_key(incoming: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows with one key the one with the largest `order`; combined before the shuffle."""
    rest = [c for c in incoming.columns if c not in (*keys, order)]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("row")
    return incoming.groupBy(*keys).agg(best).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def check_keys(incoming: DataFrame, key: str = "key") -> None:
    if not incoming.filter(F.col(key).isNull()).isEmpty():
        raise NullKey(f"a chunk has no {key}")


def sync_changes(table: DataFrame, incoming: DataFrame, scope: tuple[str, ...] = ("repo",)) -> DataFrame:
    """(scope, key, id, op, hash): op is added, modified, deleted or unchanged.

    table: scope, key, id, hash. incoming: scope, key, hash, one row per key. One full outer
    join on the key; added rows have no id yet.
    """
    on = [*scope, "key"]
    old = table.select(*on, F.col("id"), F.col("hash").alias("old_hash"))
    both = old.join(incoming.select(*on, F.col("hash").alias("new_hash")), on, "full_outer")
    op = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    )
    return both.select(*on, "id", op.alias("op"), F.coalesce("new_hash", "old_hash").alias("hash"))


def with_new_ids(changes: DataFrame, next_ids: DataFrame, scope: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Gives added rows ids from next_id on, by key; ids of deleted rows aren't used again.

    next_ids: scope, next_id. Rows are numbered within spans of 1/1024 of a scope's hash range,
    whose sizes are summed first, so a scope with most of the rows isn't ranked in one task.
    """
    added = changes.filter("op = 'added'").drop("id").withColumn("span", F.shiftrightunsigned(F.xxhash64("key"), 54))
    sizes = added.groupBy(*scope, "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*scope).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*scope, "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*scope, "span").orderBy("key"))
    numbered = added.withColumn("rank", rank).join(offsets, [*scope, "span"]).join(next_ids, list(scope), "left")
    new = numbered.withColumn("id", F.coalesce("next_id", F.lit(1)) + F.col("offset") + F.col("rank") - 1)
    return changes.filter("op <> 'added'").unionByName(new.select(*changes.columns))


def apply_changes(changes: DataFrame) -> DataFrame:
    """The table after a sync."""
    return changes.filter("op <> 'deleted'").drop("op")


def sync(table: DataFrame, incoming: DataFrame, next_ids: DataFrame, scope: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Validates, drops repeated keys (the last by seq stays) and gives every change its id."""
    check_keys(incoming)
    last = latest_per_key(incoming, [*scope, "key"]) if "seq" in incoming.columns else incoming
    return with_new_ids(sync_changes(table, last, scope), next_ids, scope)


def manifest_diff(prev: DataFrame, now: DataFrame, scope: tuple[str, ...] = ("repo",)) -> DataFrame:
    """(scope, path, op) of added, modified and deleted paths. prev, now: scope, path, hash."""
    on = [*scope, "path"]
    both = prev.select(*on, F.col("hash").alias("a")).join(now.select(*on, F.col("hash").alias("b")), on, "full_outer")
    op = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select(*on, op.alias("op")).filter("op IS NOT NULL")


def directory_rollup(leaves: DataFrame) -> DataFrame:
    """(repo, dir, depth, fingerprint, n) of every directory, '' being the root.

    leaves: repo, path, hash. Directories are combined from the deepest level up; a level's
    children meet in one shuffle. There are as many levels as the deepest path has; each is a
    table before the one above it is made.
    """
    rows = leaves.select("repo", F.split("path", "/").alias("parts"), F.col("hash"))
    rows = rows.withColumn("depth", F.size("parts") - 1)
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    out, below = None, None
    for depth in range(deepest, -1, -1):
        here = rows.filter(F.col("depth") == depth).select("repo", F.array_join(F.slice("parts", 1, depth), "/").alias("dir"), F.element_at("parts", -1).alias("key"), "hash")
        if below is not None:
            up = F.split("dir", "/")
            child = below.select("repo", F.array_join(F.slice(up, 1, depth), "/").alias("dir"), F.element_at(up, -1).alias("key"), F.col("fingerprint").alias("hash"))
            here = here.unionByName(child)
        below = table_between_rounds(fingerprint_md5(here, ["repo", "dir"]))
        level = below.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return out.select("repo", "dir", "depth", "fingerprint", "n")


def changed_repos(prev_rollup: DataFrame, now_rollup: DataFrame) -> DataFrame:
    """Repos whose root digest differs: the gate before any other comparison."""
    root = lambda d, name: d.filter("dir = ''").select("repo", F.col("fingerprint").alias(name))
    both = root(prev_rollup, "a").join(root(now_rollup, "b"), "repo", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("repo")


#: Parts of a manifest that is stored by directory; what a diff lists at the driver is at most that.
PARTS = 256


def by_directory(leaves: DataFrame, parts: int = PARTS) -> DataFrame:
    """leaves(repo, path, hash) with dir and part, for a table that is written with
    partitionBy("part"): the leaves of a directory are in one part."""
    rows = leaves.select("repo", "path", "hash", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"))
    return rows.withColumn("part", F.pmod(F.xxhash64("repo", "dir"), F.lit(parts)).cast("int"))


def changed_directories(prev_rollup: DataFrame, now_rollup: DataFrame) -> DataFrame:
    """(repo, dir) of directories that differ or are in one of two directory_rollup() only."""
    one = lambda d, name: d.select("repo", "dir", F.col("fingerprint").alias(name))
    both = one(prev_rollup, "a").join(one(now_rollup, "b"), ["repo", "dir"], "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("repo", "dir")


def pruned_manifest_diff(prev: DataFrame, now: DataFrame, prev_rollup: DataFrame, now_rollup: DataFrame, parts: int = PARTS) -> DataFrame:
    """manifest_diff() of two stored manifests (by_directory(), written by part) that reads only the
    parts which hold a directory whose digest differs. Equal trees read no leaf at all."""
    changed = table_between_rounds(changed_directories(prev_rollup, now_rollup).withColumn("part", F.pmod(F.xxhash64("repo", "dir"), F.lit(parts)).cast("int")))
    touched = [r["part"] for r in changed.select("part").distinct().collect()]
    inside = lambda d: d.filter(F.col("part").isin(touched)).join(changed.select("repo", "dir"), ["repo", "dir"], "left_semi")
    return manifest_diff(inside(prev), inside(now))


def needs_hash(prev: DataFrame, stats: DataFrame) -> DataFrame:
    """Files whose content must be read: no earlier leaf has their size and mtime.

    prev: repo, path, size, mtime, hash. stats: repo, path, size, mtime. Only metadata is read.
    """
    return stats.join(prev.select("repo", "path", "size", "mtime"), ["repo", "path", "size", "mtime"], "left_anti")


def rebuilt_manifest(prev: DataFrame, stats: DataFrame, hashed: DataFrame) -> DataFrame:
    """Leaves from known digests, and from `hashed` (repo, path, hash) for the others."""
    known = stats.join(prev.select("repo", "path", "size", "mtime", F.col("hash").alias("known")), ["repo", "path", "size", "mtime"], "left")
    both = known.join(hashed.select("repo", "path", F.col("hash").alias("fresh")), ["repo", "path"], "left")
    return both.select("repo", "path", "size", "mtime", F.coalesce("known", "fresh").alias("hash"), F.col("known").isNull().alias("rehashed"))


def carry_over(table: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of untouched paths as they were, and those of touched paths anew."""
    kept = table.join(touched.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    return kept.unionByName(fresh)
