"""The engine's own steps: roots, lookups, bootstrap, the drain step, retries, tool calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import diff
from quarryline.operators.search import clamp_k
from quarryline.sources.files import Snapshots

#: Events that one step takes; retries of a vector write and the pause before each, in seconds
#: for the first; bytes of a blame that are shown; rows of a batch to embed (fixed values).
DRAIN_EVENTS, RETRIES, PAUSE_S, BLAME_BYTES, EMBED_BATCH = 256, 3, 0.1, 131072, 32
RETRIABLE = ("IO", "TIMEOUT", "INTERNAL")


class NotFound(LookupError):
    """A repository, tool or session that isn't known."""


class InvalidArgument(ValueError):
    """Arguments that a tool doesn't take."""


class PathEscape(ValueError):
    """A path that leads out of a repository."""


class StoreError(RuntimeError):
    """A vector store's failure; `code` says whether it's worth another try."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


# --- roots and repositories


def roots_of_records(lines: DataFrame) -> DataFrame:
    """(line_no, key, root) of records `key<TAB>path`; those without a key or a path are left out."""
    at = F.instr("line", "\t")
    key, root = F.substring(F.col("line"), F.lit(1), at - 1), F.substring(F.col("line"), at + 1, F.length("line"))
    return lines.select("line_no", F.when(at > 0, key).alias("key"), F.when(at > 0, root).alias("root")).filter("key <> '' AND root <> ''")


def safe_relative(path: str) -> str:
    """The path with its . components and doubled slashes gone; absolute ones and those that lead
    above their start are errors."""
    plain = path.replace("\\", "/")
    out: list[str] = []
    if plain.startswith("/"):
        raise PathEscape(path)
    for part in plain.split("/"):
        if part == "..":
            if not out:
                raise PathEscape(path)
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out) or "."


def in_repo(rows: DataFrame, repos: DataFrame, repo: str | None) -> DataFrame:
    """rows of one repo, or of all without a name; a name that isn't among repos(repo) is an error."""
    if not repo:
        return rows
    if repos.filter(F.col("repo") == repo).isEmpty():
        raise NotFound(repo)
    return rows.filter(F.col("repo") == repo)


def find_by_id(chunks: DataFrame, repo: str, chunk_id: int) -> DataFrame:
    return chunks.filter((F.col("repo") == repo) & (F.col("id") == chunk_id))


def find_by_key(chunks: DataFrame, repo: str, key: str) -> DataFrame:
    return chunks.filter((F.col("repo") == repo) & (F.col("key") == key))


def hits_with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits(repo, id, score, …) with their chunks; ids that are gone are dropped."""
    return hits.join(chunks, ["repo", "id"])


def fan_out(hits: DataFrame, ready: DataFrame, k: int | None = None) -> DataFrame:
    """The best hits(query_id, repo, id, score) over the repos that are ready(repo), at most 64."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "repo", "id")
    return hits.join(ready.select("repo"), "repo", "left_semi").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= clamp_k(k))


def normalised_hits(raw: DataFrame) -> DataFrame:
    """Hits of any tool in one form. raw: id, repo, path, symbol, lines ('10-20' or '10'),
    start_line, end_line, score, snippet, body; hits without a path are dropped."""
    trimmed = F.trim("lines")
    range_ = F.regexp_extract(trimmed, r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(trimmed, r"^(\d+)-(\d+)$", 2).try_cast("int")
    one = F.when(trimmed.try_cast("int") > 0, trimmed.try_cast("int"))
    start = F.coalesce(range_[0], one, F.col("start_line"), F.lit(0))
    end = F.coalesce(range_[1], one, F.col("end_line"), F.col("start_line"), F.lit(0))
    body = F.substring(F.coalesce("body", F.lit("")), 1, 400)
    return raw.filter("path <> ''").select(
        F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.when(F.col("repo") != "", F.col("repo")).alias("repo"), "path", F.coalesce("symbol", F.lit("")).alias("symbol"),
        start.alias("start_line"), end.alias("end_line"), F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("snippet", body).alias("snippet"),
    )


# --- from a tree to a table


@dataclass
class Bootstrap:
    """changes(repo, path, op) that must be indexed, and how they were found."""

    changes: DataFrame
    warm: bool


def bootstrap(previous: DataFrame | None, now: DataFrame) -> Bootstrap:
    """With the leaves(repo, path, hash) of an earlier run only what differs is read again; without
    them, or where they are of another form, everything is new."""
    if previous is None or not {"repo", "path", "hash"} <= set(previous.columns):
        return Bootstrap(now.select("repo", "path", F.lit("added").alias("op")), False)
    return Bootstrap(diff.manifest_diff(previous, now), True)


def drain(events: DataFrame, limit: int = DRAIN_EVENTS) -> tuple[DataFrame, DataFrame]:
    """(taken, left) of events(seq, …): a step takes the earliest `limit` of them."""
    taken = events.orderBy("seq").limit(limit)
    return taken, events.join(taken.select("seq"), "seq", "left_anti")


def with_retries(write: Callable[[], None], rebuild: Callable[[], None], retries: int = RETRIES, pause: float = PAUSE_S) -> str:
    """Runs a vector write; failures worth it are tried again with growing pauses, then the index
    is built anew. Says which of the two ended it. Other failures are the caller's."""
    for attempt in range(retries + 1):
        try:
            write()
            return "written"
        except StoreError as e:
            if e.code not in RETRIABLE:
                raise
            if attempt < retries:
                time.sleep(pause * (attempt + 1))
    rebuild()
    return "rebuilt"


def embedding_batches(texts: DataFrame, size: int = EMBED_BATCH, text: str = "text") -> DataFrame:
    """texts with the task's batch number: texts of like length share a batch, to waste little
    padding. Lengths are sorted within each task; nothing is shuffled."""
    near = texts.withColumn("n_chars", F.length(F.coalesce(F.col(text), F.lit("")))).sortWithinPartitions("n_chars")
    numbered = near.withColumn("_no", F.monotonically_increasing_id())
    place = F.col("_no").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("batch", F.concat(F.shiftright("_no", 33).cast("string"), F.lit("-"), F.floor(place / size).cast("string"))).drop("_no")


# --- sessions and version control


def resolve_session(sessions: DataFrame, wanted: str) -> DataFrame:
    """The session with this id, else the only one whose id begins so, else none."""
    like = sessions.filter(F.col("id").startswith(wanted)).withColumn("exact", F.col("id") == wanted)
    found = like.agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("any_exact"))
    return like.crossJoin(found).filter(F.col("exact") | ((F.col("n") == 1) & ~F.col("any_exact"))).drop("exact", "n", "any_exact")


def remove_sessions(rows: DataFrame, ids: DataFrame, key: str = "conv_id") -> DataFrame:
    """rows without the sessions of ids(id); an id that isn't there is no error."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def git_blame(lines: DataFrame) -> DataFrame:
    """(line_no, hash, author, date, text) of captured blame lines; others are dropped."""
    pattern = r"^\^?([0-9a-f]{7,40})\s+(?:\S+\s+)?\((.*?)\s+(\d{4}-\d\d-\d\d)[^)]*?\s+(\d+)\)\s?(.*)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.filter(F.col("line").rlike(pattern)).select(part(4).cast("int").alias("line_no"), part(1).alias("hash"), part(2).alias("author"), part(3).alias("date"), part(5).alias("text"))


def capped(outputs: DataFrame, limit: int = BLAME_BYTES) -> DataFrame:
    """outputs(…, text) cut to `limit` bytes, and whether they were."""
    from quarryline.operators.chunkers import cut_bytes

    return outputs.withColumn("truncated", F.octet_length("text") > limit).withColumn("text", cut_bytes(F.col("text"), limit))


# --- tools


def in_name_order(names: Iterable[str]) -> list[str]:
    """Tools are declared in the order of their names, whatever the order of registration."""
    return sorted(names)


@dataclass
class Tool:
    name: str
    call: Callable[..., object]
    #: Argument names and the types they take.
    args: dict[str, type] = field(default_factory=dict)
    required: tuple[str, ...] = ()


class Tools:
    """Named tools with typed arguments. Registering a name again replaces the tool in its place."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def names(self) -> list[str]:
        return list(self._tools)

    def call(self, name: str, args: dict | None = None) -> object:
        tool, args = self._tools.get(name), args or {}
        if tool is None:
            raise NotFound(name)
        missing = [a for a in tool.required if a not in args]
        odd = [a for a, v in args.items() if a not in tool.args or not isinstance(v, tool.args[a]) or (isinstance(v, bool) and tool.args[a] is not bool)]
        if missing or odd:
            raise InvalidArgument(f"{name}: missing {missing}, not taken {odd}")
        return tool.call(**args)


def error_code(error: Exception) -> str:
    """The code by which a caller is told of a failure."""
    from quarryline.operators.workspace import UnsafePipe, UnsafeSed

    for kind, code in ((UnsafePipe, "UNSAFE_PIPE"), (UnsafeSed, "UNSAFE_SED"), (PathEscape, "FORBIDDEN"), (NotFound, "NOT_FOUND"), (InvalidArgument, "INVALID_ARGS"), (NotImplementedError, "NOT_IMPLEMENTED")):
        if isinstance(error, kind):
            return code
    return "INTERNAL"


def index_tree(store: Snapshots, files: DataFrame, prefixes: DataFrame | None = None) -> Bootstrap:
    """One run over files(repo, path, text): chunks, manifest and graph of the tree are saved.

    Where an earlier run is stored, only files whose hash differs are chunked and read for the graph;
    what the others contributed is carried over. Imports are resolved over the whole tree. The tables
    are saved together.
    """
    leaves = files.select("repo", "path", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    earlier, _ = store.load_all()
    found = bootstrap(earlier.get("manifest"), leaves)
    changed = found.changes.filter("op <> 'deleted'").select("repo", "path")
    store.save_all(_indexed(earlier if found.warm else {}, files.join(changed, ["repo", "path"], "left_semi"), found.changes, leaves, prefixes))
    return found


def _indexed(earlier: dict[str, DataFrame], fresh: DataFrame, touched: DataFrame, leaves: DataFrame, prefixes: DataFrame | None) -> dict[str, DataFrame]:
    """The index with the files `fresh` in place of all that the paths `touched` contributed."""
    from quarryline.operators import chunkers, graph
    from quarryline.operators.rounds import table_between_rounds

    # the files that changed are found once, and read by each of the steps that follow
    fresh = table_between_rounds(fresh)
    chunks = chunkers.chunk_files(fresh)
    nodes, refs = map(table_between_rounds, graph.fragments(fresh))
    if earlier:
        chunks = diff.carry_over(earlier["chunks"], touched, chunks)
        nodes, refs = graph.apply_fragment(earlier["nodes"].filter("kind <> 'module'"), earlier["refs"], nodes, refs, touched.select("repo", "path").distinct())
    nodes, refs = graph.linked(nodes, refs, prefixes)
    return {"chunks": chunks, "nodes": nodes, "refs": refs, "manifest": leaves}


def index_step(store: Snapshots, files: DataFrame, touched: DataFrame, batch: str, prefixes: DataFrame | None = None) -> bool:
    """One incremental step: touched(repo, path) are indexed as they are in files(repo, path, text)
    now, or dropped where they aren't there. A batch that the store has already is left out, so a
    step that comes again changes nothing. True if the step was made.
    """
    earlier, done = store.load_all()
    if done == batch:
        return False
    paths = touched.select("repo", "path").distinct()
    fresh = files.join(paths, ["repo", "path"], "left_semi")
    leaves = fresh.select("repo", "path", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    if earlier:
        leaves = earlier["manifest"].join(paths, ["repo", "path"], "left_anti").unionByName(leaves)
    store.save_all(_indexed(earlier, fresh, paths, leaves, prefixes), batch)
    return True
