"""The tools of an indexed workspace, by name and with typed arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import engine, graph, pipes, search, vectors, workspace
from quarryline.operators.chunkers import cut_bytes
from quarryline.operators.engine import InvalidArgument, NotFound, Tool, Tools, safe_relative
from quarryline.schemas import FILE_BYTES


@dataclass
class Workspace:
    """What the tools read. files(repo, path, text); chunks(repo, id, key, path, kind, symbol,
    start_line, end_line, body); nodes and edges of the graph; vectors(repo, id, vector) and what
    embeds a query; captured output of version control: log(repo, path, line_no, line; path null
    for the whole repository), blame(repo, path, line_no, line) and diffs(repo, base, head, text).
    Parts that are left out make their tools NOT_IMPLEMENTED."""

    repos: DataFrame
    files: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    log: DataFrame | None = None
    blame: DataFrame | None = None
    diffs: DataFrame | None = None

    def one(self, rows: DataFrame, repo: str | None) -> DataFrame:
        return engine.in_repo(rows, self.repos, repo)

    def file(self, repo: str | None, path: str) -> DataFrame:
        """The file of a path within its repository; a path that leads out of it is an error."""
        return found(self.one(self.files, repo).filter(F.col("path") == safe_relative(path)), path)

    def lines(self, rows: DataFrame) -> DataFrame:
        each = rows.select("repo", "path", F.posexplode(workspace.lines_of()).alias("pos", "line"))
        return each.select("repo", "path", (F.col("pos") + 1).alias("line_no"), "line")


def found(rows: DataFrame, what: object) -> DataFrame:
    if rows.isEmpty():
        raise NotFound(str(what))
    return rows


def part(value: DataFrame | None, name: str) -> DataFrame:
    if value is None:
        raise NotImplementedError(f"a workspace without {name}")
    return value


def capped(limit: int | None, default: int, most: int) -> int:
    if limit is not None and limit < 0:
        raise InvalidArgument(f"limit {limit}")
    return min(limit or default, most)


HIT = ["repo", "id", "path", "symbol", "start_line", "end_line"]


def search_chunks(ws: Workspace, query: str, k: int | None = None, repo: str | None = None, path_glob: str | None = None, kind: str | None = None, min_score: float = 0.0) -> DataFrame:
    """The chunks nearest to a query, filtered before they are ranked, best first."""
    if ws.embed is None:
        raise NotImplementedError("a workspace without an embedding")
    chunks = search.chunk_filter(ws.one(ws.chunks, repo), None, kind, path_glob)
    own = part(ws.vectors, "vectors").join(chunks.select("repo", "id"), ["repo", "id"], "left_semi")
    asked = own.sparkSession.createDataFrame([(0, [float(x) for x in ws.embed(query)])], "query_id long, q array<double>")
    k = search.clamp_k(k)
    hits = engine.fan_out(vectors.knn(own, asked, k, "id", "vector", ["repo"]).drop("rank"), ws.repos, k)
    hits = engine.hits_with_chunks(hits.select("repo", "id", "score"), chunks).withColumn("snippet", search.snippet())
    hits = hits.filter(F.col("score") >= min_score) if min_score and min_score > 0 else hits
    return hits.select(*HIT, "score", "snippet").orderBy(F.desc("score"), "repo", "id")


def hybrid_search(ws: Workspace, query: str, k: int | None = None, repo: str | None = None, path_glob: str | None = None, kind: str | None = None, min_score: float = 0.0) -> DataFrame:
    """search_chunks() for twice as many, reranked by the query's words."""
    k = capped(k, 8, 64)
    hits = search_chunks(ws, query, min(2 * k, 64), repo, path_glob, kind, min_score)
    return search.hybrid(hits.join(ws.files.select("repo", "path", "text"), ["repo", "path"], "left"), search.significant_terms(F.lit(query)), k).drop("text")


def detect_changes(ws: Workspace, base: str, head: str = "HEAD", repo: str | None = None, depth: int = 2, limit: int | None = None) -> DataFrame:
    diffs = ws.one(part(ws.diffs, "diffs"), repo).filter((F.col("base") == base) & (F.col("head") == head))
    hunks = workspace.diff_hunks(found(diffs, f"{base}...{head}").select(F.col("repo").alias("diff_id"), "text")).withColumnRenamed("diff_id", "repo")
    outline = ws.chunks.select("repo", "path", "symbol", "start_line", "end_line")
    return graph.changed_symbols(hunks, outline, ws.edges, ws.nodes, min(depth, 8), capped(limit, 40, 256))


def find_references(ws: Workspace, symbol: str, repo: str | None = None, path_prefix: str | None = None, path_glob: str | None = None, limit: int | None = None) -> DataFrame:
    files = ws.one(ws.files, repo)
    if path_glob:
        files = files.filter(F.col("path").rlike(workspace.search_glob(path_glob)))
    out = graph.find_references(ws.nodes, ws.edges, ws.lines(files), symbol, capped(limit, 50, 64), repo)
    return out.filter(graph.under_prefix("path", path_prefix)) if path_prefix else out


def read_file(ws: Workspace, path: str, repo: str | None = None, start_line: int = 1, end_line: int | None = None) -> DataFrame:
    if start_line < 0 or (end_line is not None and end_line < 0):
        raise InvalidArgument(f"lines {start_line} to {end_line}")
    return workspace.read_file(ws.file(repo, path), start_line, end_line or None)


def sed(ws: Workspace, path: str, script: str, repo: str | None = None, quiet: bool = False) -> DataFrame:
    """(repo, path, content, truncated): a file as a script leaves it, at most FILE_BYTES of it."""
    rows, copies = workspace.edited(ws.lines(ws.file(repo, path)), script, quiet)
    copy: Column = F.col("copy") if copies else F.lit(0)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", copy.alias("copy"), "line"))), lambda r: r["line"])
    out = rows.groupBy("repo", "path").agg(F.array_join(lines, "\n").alias("content"))
    return out.select("repo", "path", cut_bytes(F.col("content"), FILE_BYTES).alias("content"), (F.octet_length("content") > FILE_BYTES).alias("truncated"))


def git_log(ws: Workspace, repo: str | None = None, path: str | None = None, limit: int | None = None) -> DataFrame:
    rows = ws.one(part(ws.log, "a log"), repo)
    rows = rows.filter(F.col("path") == safe_relative(path)) if path else rows.filter("path IS NULL")
    return workspace.git_log(rows, capped(limit, 20, 200))


def git_blame(ws: Workspace, path: str, repo: str | None = None, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
    rows = found(ws.one(part(ws.blame, "a blame"), repo).filter(F.col("path") == safe_relative(path)), path)
    out = engine.git_blame(rows)
    return out.filter(F.col("line_no").between(start_line or 1, end_line or (1 << 30)))


NUMBER = (int, float)
_FOUND = {"query": str, "k": int, "repo": str, "path_glob": str, "kind": str, "min_score": NUMBER}


def workspace_tools(ws: Workspace) -> Tools:
    """The registry of a workspace's tools. What they give is a DataFrame. Arguments that a tool
    doesn't take are an error; a limit of 0 is the tool's own."""
    tools = Tools()

    def add(name: str, call: Callable[..., DataFrame], args: dict, *required: str) -> None:
        tools.register(Tool(name, call, args, required))

    at = {"repo": str, "path": str}
    add("repos", lambda: ws.repos, {})
    add("search", lambda **a: search_chunks(ws, **a), _FOUND, "query")
    add("get_chunk", lambda repo, id: found(search.get_chunk(ws.one(ws.chunks, repo), repo, id), id), {"repo": str, "id": int}, "repo", "id")
    add("find_symbol", lambda name, repo=None, kind=None, limit=None: search.find_symbol(ws.one(ws.chunks, repo), name, kind, None, capped(limit, 20, 64)), {"name": str, "repo": str, "kind": str, "limit": int}, "name")
    add("file_outline", lambda repo, path: found(search.file_outline(ws.one(ws.chunks, repo), repo, safe_relative(path)), path), at, "repo", "path")
    add("hybrid_search", lambda **a: hybrid_search(ws, **a), _FOUND, "query")
    add("search_graph", lambda name=None, repo=None, kind=None, path_prefix=None, limit=None: graph.find_nodes(ws.one(ws.nodes, repo), name, kind, path_prefix, capped(limit, 20, 64)), {"name": str, "repo": str, "kind": str, "path_prefix": str, "limit": int})
    add(
        "trace_path", lambda name, repo=None, direction="both", edge_kind="CALLS", max_depth=graph.DEFAULT_DEPTH, limit=None, path=None: graph.trace_path(ws.one(ws.nodes, repo), ws.edges, name, path, edge_kind, direction, min(max_depth, 16), capped(limit, 64, 256), repo),
        {"name": str, "repo": str, "direction": str, "edge_kind": str, "max_depth": int, "limit": int, "path": str}, "name",
    )
    add("detect_changes", lambda **a: detect_changes(ws, **a), {"repo": str, "base": str, "head": str, "depth": int, "limit": int}, "base")
    add("get_architecture", lambda repo=None, hub_limit=None: graph.architecture(ws.one(ws.nodes, repo), ws.one(ws.edges, repo), capped(hub_limit, 10, 64)), {"repo": str, "hub_limit": int})
    add("find_references", lambda **a: find_references(ws, **a), {"symbol": str, "repo": str, "path_prefix": str, "path_glob": str, "limit": int}, "symbol")
    add("grep", lambda pattern, literal=False, repo=None, path_glob=None, limit=None: workspace.grep(ws.one(ws.files, repo), pattern, literal, path_glob, capped(limit, 200, 200)), {"pattern": str, "literal": bool, "repo": str, "path_glob": str, "limit": int}, "pattern")
    add("glob", lambda pattern, repo=None, limit=None: workspace.glob(ws.one(ws.files, repo), pattern, capped(limit, 500, 500)), {"pattern": str, "repo": str, "limit": int}, "pattern")
    add("read_file", lambda **a: read_file(ws, **a), {**at, "start_line": int, "end_line": int}, "path")
    add("list_dir", lambda repo=None, path="": workspace.list_dir(ws.one(ws.files, repo), "" if safe_relative(path or ".") == "." else safe_relative(path)), at)
    add("tree", lambda repo=None, path="", max_depth=workspace.TREE_DEPTH: workspace.tree(_below(ws.one(ws.files, repo), path), max_depth or workspace.TREE_DEPTH), {**at, "max_depth": int})
    add("head", lambda path, repo=None, lines=None: workspace.head(ws.file(repo, path), capped(lines, workspace.HEAD_LINES, 1 << 20)), {**at, "lines": int}, "path")
    add("tail", lambda path, repo=None, lines=None: workspace.tail(ws.file(repo, path), capped(lines, workspace.HEAD_LINES, 1 << 20)), {**at, "lines": int}, "path")
    add("wc", lambda path, repo=None: workspace.wc(ws.file(repo, path)), at, "path")
    add("sed", lambda **a: sed(ws, **a), {**at, "script": str, "quiet": bool}, "path", "script")
    add("pipe", lambda command, repo=None: pipes.run_pipe_on_files(ws.one(ws.files, repo), command), {"command": str, "repo": str}, "command")
    add("git_log", lambda **a: git_log(ws, **a), {**at, "limit": int})
    add("git_blame", lambda **a: git_blame(ws, **a), {**at, "start_line": int, "end_line": int}, "path")
    return tools


def _below(files: DataFrame, path: str) -> DataFrame:
    directory = safe_relative(path or ".")
    return files if directory == "." else files.filter(graph.under_prefix("path", directory))
