"""Shards of near equal bytes: longest processing time first.

Documents of equal text form a group, which stays together. Groups are taken by falling size, and
each goes to the shard with the least load so far (of equal loads the first), by a heap. Groups of
one size are alike, so a run of them is scheduled at once: the heap's choices for a run are, after
some levelling, a fixed round of shards. What the driver schedules is a table of runs whose length
is bounded: EXACT_SIZES sizes are runs of their own, larger ones share a run if their first
SIZE_BITS bits agree, but the at most LARGE groups of over 1/LARGE of all bytes are single runs.
Where runs of several sizes exist, the shards' loads are measured after them, and the exact sizes
that follow level what they left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ordering import numbered

from .shared import materialize, text_or_empty

SHARDS = 8
#: Groups below this size are scheduled by their exact size.
EXACT_SIZES = 1 << 16
#: Bits by which larger groups are told apart.
SIZE_BITS = 12
#: Groups in over this share of bytes, or of rows, are handled each on its own.
LARGE = 8192


def round_of(loads: list[int], size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How a heap of loads deals `count` groups of one size: [(first rank, shards in turn)], and the loads after.

    A shard whose load is size * level + rest takes part from that level on; within a level, shards
    are served by rest, then by number. So the turn changes only at levels where a shard joins in.
    """
    shards = sorted(range(len(loads)), key=lambda i: (loads[i] % size, i))
    level = {i: loads[i] // size for i in shards}
    joins = sorted(set(level.values()))
    turns, rank, loads = [], 0, list(loads)
    for at, until in zip(joins, [*joins[1:], None], strict=True):
        turn = [i for i in shards if level[i] <= at]
        n = count - rank if until is None else min(count - rank, (until - at) * len(turn))
        if n:
            turns.append((rank, turn))
            for k, i in enumerate(turn):
                loads[i] += size * (n // len(turn) + (k < n % len(turn)))
            rank += n
    return turns, loads


def _run() -> Column:
    """The run of a group: its bytes, or the least number with the same first SIZE_BITS bits."""
    size = F.col("bytes")
    return F.when(size < EXACT_SIZES, size).otherwise(size - F.pmod(size, F.expr(f"shiftleft(1L, length(bin(bytes)) - {SIZE_BITS})")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, large: int = LARGE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, a row per row of docs.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and shares a group with
    empty ones. The law is `bytes`: shards are near equal in bytes, as far as groups can be dealt;
    grown_shard is null. slot numbers a shard's rows from 0 by doc_id (null first), then by the
    text's digest. Rows that repeat a doc_id, or both, are rows like others. Only doc_id and text
    are read. An empty table gives an empty result.
    """
    text = text_or_empty("text")
    keys = materialize(
        docs.select(
            "doc_id", F.sha2(text, 256).alias("sha"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "shard-keys",
    )
    groups = materialize(keys.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("run", _run()), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    placed = materialize(_placed(groups, total["bytes"], shards, large), "shard-groups-placed")
    # groups of many rows are joined where the rows are read
    often = F.col("n") * large > total["n"]
    hot = F.broadcast(placed.filter(often).select("sha", "shard"))
    rest = keys.join(hot, "sha", "left_anti").join(placed.filter(~often).select("sha", "shard"), "sha")
    rows = materialize(keys.join(hot, "sha").unionByName(rest), "shard-rows")
    slots = numbered(rows, ["doc_id", "sha", "row_no"], ["shard"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _placed(groups: DataFrame, total: int, shards: int, large: int) -> DataFrame:
    """groups and a column shard."""
    spark = groups.sparkSession
    # at most `large` groups
    alone = (F.col("bytes") >= EXACT_SIZES) & (F.col("bytes") * large > total)
    single = [(r["bytes"], r["sha"]) for r in groups.filter(alone).select("bytes", "sha").orderBy(F.desc("bytes"), "sha").collect()]
    runs = groups.filter(~alone).groupBy("run").agg(F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes")).collect()  # bounded: see the module's docstring
    wide = sorted(((r["run"], r["bytes"] / r["count"], r["count"]) for r in runs if r["run"] >= EXACT_SIZES), reverse=True)
    ranked = numbered(groups.filter(~alone), [F.desc("bytes"), "sha"], ["run"], "rank")

    heap = [(0, i) for i in range(shards)]
    own = []
    steps = sorted([(b, 1, sha, 1) for b, sha in single] + [(round(mean), 0, run, count) for run, mean, count in wide], key=lambda s: (-s[0], -s[1], s[2]))
    plan: list[tuple[int, list]] = []
    for size, one, key, count in steps:
        if one:
            load, i = heapq.heappop(heap)
            own.append((key, i))
            heapq.heappush(heap, (load + size, i))
        else:
            turns, loads = round_of(_loads(heap), size, count)
            plan.append((key, turns))
            heap = [(load, i) for i, load in enumerate(loads)]
            heapq.heapify(heap)
    out = groups.filter(alone).join(F.broadcast(_frame(spark, own, "sha string, shard int")), "sha")
    loads = _loads(heap)
    if wide:
        first = materialize(out.unionByName(_dealt(ranked.filter(F.col("run") >= EXACT_SIZES), plan)), "shard-wide")
        measured = {r["shard"]: r["bytes"] for r in first.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
        out, loads = first, [measured.get(i, 0) for i in range(shards)]
    plan = []
    for r in sorted((r for r in runs if r["run"] < EXACT_SIZES), key=lambda r: -r["run"]):
        turns, loads = round_of(loads, r["run"], r["count"])
        plan.append((r["run"], turns))
    return out.unionByName(_dealt(ranked.filter(F.col("run") < EXACT_SIZES), plan))


def _loads(heap: list[tuple[int, int]]) -> list[int]:
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _dealt(ranked: DataFrame, plan: list[tuple[int, list]]) -> DataFrame:
    """The shard of each group: the turn that its rank in the run falls into."""
    spark = ranked.sparkSession
    steps = F.broadcast(_frame(spark, [(run, turns) for run, turns in plan], "planned long, turns array<struct<first: long, turn: array<int>>>"))
    last = F.element_at(F.filter("turns", lambda t: t["first"] <= F.col("rank")), -1)
    shard = F.get(last["turn"], F.pmod(F.col("rank") - last["first"], F.size(last["turn"])).cast("int"))
    return ranked.join(steps, F.col("run") == F.col("planned")).select("sha", "bytes", "n", "run", shard.alias("shard"))
