"""Watch events: merging kinds per path, in batch and as a stream, and draining to a re-index.

events(repo, path, kind, ts, seq). DELETE wins over what was before; CREATE after DELETE is CREATE;
anything else after DELETE stays DELETE; otherwise the latest kind counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.operators.rounds import Rounds

DEBOUNCE = "75 milliseconds"
DRAIN_EVENTS = 256


class Overflow(RuntimeError):
    """More dirty paths than a drain takes; nothing has been taken."""


def merge_kinds(events: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """(keys, kind, ts): the merged kind of each path.

    Only three facts about a path are needed, and each is a maximum, so events are combined
    before the shuffle: the last event, the last DELETE, and the first CREATE behind it.
    """
    at = F.struct("ts", "seq")
    facts = events.groupBy(*keys).agg(
        F.max(at).alias("last"), F.max_by("kind", at).alias("latest"),
        F.max(F.when(F.col("kind") == "DELETE", at)).alias("deleted"), F.max(F.when(F.col("kind") == "CREATE", at)).alias("created"),
    )
    gone = F.col("deleted").isNotNull() & (F.col("created").isNull() | (F.col("created") < F.col("deleted")))
    return facts.select(*keys, F.when(gone, "DELETE").otherwise(F.col("latest")).alias("kind"), F.col("last.ts").alias("ts"))


def merge_kind(before: str | None, kind: str) -> str:
    if before == "DELETE" and kind != "CREATE":
        return "DELETE"
    return kind


def _merge_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    kind = state.get[0] if state.exists else None
    for frame in frames:
        for k in frame.sort_values(["ts", "seq"])["kind"]:
            kind = merge_kind(kind, k)
    state.update((kind,))
    state.setTimeoutDuration(24 * 3600 * 1000)
    yield pd.DataFrame({"repo": [key[0]], "path": [key[1]], "kind": [kind]})


def merged_stream(events: DataFrame) -> DataFrame:
    """The merged kind of each path after every micro-batch; a path's state is one word and goes
    after a day without events."""
    return events.groupBy("repo", "path").applyInPandasWithState(_merge_state, "repo string, path string, kind string", "kind string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def bursts(events: DataFrame, gap: str = DEBOUNCE, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Events of a path that follow each other within a gap count as one burst."""
    return events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("w.start").alias("first"), "events")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by kind and hour; with a watermark, so that a stream's state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("hour"), "kind", "events")


def dirty_paths(merged: DataFrame, limit: int | None = None) -> DataFrame:
    """The paths to index anew; over the limit the drain fails and takes nothing."""
    if limit is not None and merged.limit(limit + 1).count() > limit:
        raise Overflow(f"more than {limit} dirty paths")
    return merged.select("repo", "path", "kind")


class DirtySet:
    """The merged kinds of paths that wait to be indexed, as a table that grows by batches of events
    and is emptied by a drain."""

    def __init__(self, spark: SparkSession):
        self.rounds, self.waiting = Rounds(spark), None

    def add(self, events: DataFrame) -> None:
        """Merges events(repo, path, kind, ts, seq) into what waits: a state counts as an event
        before all of the batch, and a CREATE in it undoes a DELETE that waits."""
        facts = events.select("repo", "path", "kind", "ts", F.col("seq").cast("long").alias("seq"), F.lit(1).alias("_age"))
        if self.waiting is not None:
            facts = self.waiting.withColumn("_age", F.lit(0)).withColumn("seq", F.lit(0).cast("long")).unionByName(facts)
        # merge_kinds() orders by (ts, seq): what waits comes first by its age
        aged = facts.select("repo", "path", "kind", F.struct("_age", "ts").alias("ts"), "seq")
        merged = merge_kinds(aged).select("repo", "path", "kind", F.col("ts.ts").alias("ts"))
        self.waiting = self.rounds.save(merged)
        self.rounds.drop_but(self.waiting)

    def drain(self, limit: int | None = None) -> DataFrame | None:
        """What waits (repo, path, kind), which waits no longer; None if nothing does. Over the limit
        it fails and all of it still waits. The table stays until the next batch is added."""
        if self.waiting is None:
            return None
        taken = dirty_paths(self.waiting, limit)
        self.waiting = None
        return taken


def fsevent_kind(flags: str = "flags"):
    """Kind of a raw event of macOS by the names of its flags: one that says removed, renamed and
    created is a removal first, then a renaming."""
    m = F.upper(flags)
    return F.when(m.contains("REMOVED"), "DELETE").when(m.contains("RENAMED"), "RENAME").when(m.contains("CREATED"), "CREATE").otherwise("MODIFY")


def event_kind(mask: str = "mask"):
    """Kind of a raw inotify-like mask by name."""
    m = F.upper(mask)
    return F.when(m.contains("DELETE") | m.contains("MOVED_FROM"), "DELETE").when(m.contains("CREATE") | m.contains("MOVED_TO"), "CREATE").when(m.contains("MOVE"), "RENAME").otherwise("MODIFY")


def snapshot_events(prev: DataFrame, now: DataFrame) -> DataFrame:
    """Watching by polling: CREATE, MODIFY and DELETE from two listings(repo, path, mtime)."""
    both = prev.select("repo", "path", F.col("mtime").alias("a")).join(now.select("repo", "path", F.col("mtime").alias("b")), ["repo", "path"], "full_outer")
    kind = F.when(F.col("a").isNull(), "CREATE").when(F.col("b").isNull(), "DELETE").when(F.col("a") < F.col("b"), "MODIFY")
    return both.select("repo", "path", kind.alias("kind")).filter("kind IS NOT NULL")


def run_incremental(events: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is merged per path and handed to step(changes, batch_id). A batch that
    failed comes again with its id, so a step that writes under that id is safe to repeat."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        step(merge_kinds(frame), batch_id)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ordered_kinds(events: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Every event with the merged kind so far, for tracing a path's history."""
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    at = F.struct("ts", "seq")
    deleted = F.max(F.when(F.col("kind") == "DELETE", at)).over(order)
    created = F.max(F.when(F.col("kind") == "CREATE", at)).over(order)
    gone = deleted.isNotNull() & (created.isNull() | (created < deleted))
    return events.withColumn("merged", F.when(gone, "DELETE").otherwise(F.col("kind")))
