"""The structural graph: name resolution, edges, traces, hubs, references, imports.

nodes(repo, id, kind, lang, name, path, start_line, end_line, seq), ids strings; refs(repo, src,
dst, name, path, line, kind, rev, resolution), dst null where the name is resolved at query time.
A node is known by repo and id, and no name, import or edge leads from one repository to another.
Tables of a single repository may do without the column repo.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import language_of, under_prefix
from quarryline.operators.lexing import around
from quarryline.operators.rounds import Rounds, by_count, table_between_rounds
from quarryline.schemas import SYMBOL_NODES, edge_kinds, node_kinds

#: Confidence of edges (fixed values): exact, import, same file, other file, and the number of
#: candidates up to which the last isn't lowered.
EXACT, IMPORT, SAME_FILE, OTHER_FILE, FULL_CANDIDATES = 1.0, 0.95, 0.90, 0.75, 3
MAX_CANDIDATES = 8
DEFAULT_DEPTH, TRACE_LIMIT, HUB_LIMIT = 2, 64, 10


def _repo(*tables: DataFrame) -> list[str]:
    """The column that keeps repositories apart, if all tables have it."""
    return ["repo"] if all("repo" in t.columns for t in tables) else []


def resolve_names(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """([repo,] src, dst, name, path, kind, line, confidence) of refs([repo,] src, name, path, kind, line).

    A candidate has the name and is a definition. Candidates in the ref's own file shadow the
    others. At most MAX_CANDIDATES are kept, latest first; confidence counts all. Both kinds of
    candidates are cut per name before they meet the refs, so a name with very many definitions
    costs no more than one with eight.
    """
    return _resolved(refs, nodes)


def _resolved(refs: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """resolve_names() with more columns of refs."""
    repo = _repo(refs, nodes)
    defs = nodes.filter(F.col("kind").isin(*SYMBOL_NODES)).select(*repo, "id", "name", F.col("path").alias("def_path"), "seq")

    def best(keys: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq"), "id"))
        total = defs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
        return defs.withColumn("k", rank).filter(F.col("k") <= MAX_CANDIDATES).groupBy(*keys).agg(F.collect_list("id").alias("ids")).join(total, keys)

    here = best([*repo, "name", "def_path"]).select(*repo, "name", F.col("def_path").alias("path"), F.col("ids").alias("near"))
    anywhere = best([*repo, "name"]).select(*repo, "name", F.col("ids").alias("far"), "total")
    own = refs.select(*repo, "src", "name", "path", "kind", "line", *more).join(here, [*repo, "name", "path"], "left").join(anywhere, [*repo, "name"])
    far = F.round(F.lit(OTHER_FILE) * F.least(F.lit(1.0), F.lit(float(FULL_CANDIDATES)) / F.col("total")), 6)
    return own.select(*repo, "src", F.explode(F.coalesce("near", "far")).alias("dst"), "name", "path", "kind", "line", F.when(F.col("near").isNotNull(), SAME_FILE).otherwise(far).alias("confidence"), *more)


def edges_view(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """([repo,] src, dst, kind, resolution, confidence, line) of all edges: files define symbols, direct
    refs, names resolved now, and refs that name their container instead (rev)."""
    repo = _repo(refs, nodes)
    defines = nodes.filter(F.col("kind").isin(*SYMBOL_NODES) & F.col("path").isNotNull()).select(
        *repo, F.concat(F.lit("file:"), "path").alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("kind"), F.lit("EXACT").alias("resolution"), F.lit(EXACT).alias("confidence"), F.col("start_line").alias("line")
    )
    conf = F.when(F.col("resolution") == "IMPORT", IMPORT).otherwise(EXACT)
    direct = refs.filter("dst IS NOT NULL").select(*repo, "src", "dst", "kind", "resolution", conf.alias("confidence"), "line")
    cols = ["src", "dst", "kind", "resolution", "confidence", "line"]
    named = _resolved(refs.filter("dst IS NULL").withColumn("turned", F.coalesce("rev", F.lit(False))), nodes, "turned").withColumn("resolution", F.lit("TEXTUAL"))
    end = lambda one, other: F.when(F.col("turned"), F.col(other)).otherwise(F.col(one)).alias(one)
    return defines.unionByName(direct).unionByName(named.select(*repo, end("src", "dst"), end("dst", "src"), *cols[2:]))


def edges_from(edges: DataFrame, node: str, mask: str | None = None, repo: str | None = None) -> DataFrame:
    return in_repo(_masked(edges, mask), repo).filter(F.col("src") == node)


def edges_to(edges: DataFrame, node: str, mask: str | None = None, repo: str | None = None) -> DataFrame:
    return in_repo(_masked(edges, mask), repo).filter(F.col("dst") == node)


def in_repo(rows: DataFrame, repo: str | None) -> DataFrame:
    return rows if repo is None else rows.filter(F.col("repo") == repo)


def _masked(edges: DataFrame, mask: str | None) -> DataFrame:
    kinds = edge_kinds(mask)
    return edges.filter(F.col("kind").isin(*kinds)) if kinds else edges


def find_nodes(nodes: DataFrame, name: str | None = None, mask: str | None = None, prefix: str | None = None, limit: int = 20, repo: str | None = None) -> DataFrame:
    """Nodes of exactly this name, latest first; without a name, in order of insertion."""
    nodes = in_repo(nodes, repo)
    kinds = node_kinds(mask)
    if kinds:
        nodes = nodes.filter(F.col("kind").isin(*kinds))
    if prefix:
        nodes = nodes.filter(under_prefix("path", prefix))
    if name:
        return nodes.filter(F.col("name") == name).orderBy(F.desc("seq")).limit(min(limit, 64))
    return nodes.orderBy("seq").limit(min(limit, 64))


def trace(edges: DataFrame, seeds: DataFrame, mask: str | None = "CALLS", direction: str = "both", max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """([repo,] seed, node, depth, src, dst, kind, confidence, line): breadth-first from every
    seed([repo,] seed).

    A node is reported once per seed, at its least depth, by its first edge (src, dst, line order).
    All seeds advance together: one join and one anti join per level.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(direction)
    own, repo, rounds = _masked(edges, mask), _repo(edges, seeds), Rounds(edges.sparkSession)
    if "repo" in edges.columns and not repo:
        raise ValueError("seeds of a graph of repositories have a column repo")
    out = own.select(*repo, F.col("src").alias("at"), F.col("dst").alias("node"), "src", "dst", "kind", "confidence", "line")
    back = own.select(*repo, F.col("dst").alias("at"), F.col("src").alias("node"), "src", "dst", "kind", "confidence", "line")
    hops = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    frontier = rounds.save(seeds.select(*repo, "seed", F.col("seed").alias("node")).distinct())
    visited, found = frontier, None
    for depth in range(1, max_depth + 1):
        reach = by_count(frontier.withColumnRenamed("node", "at")).join(hops, [*repo, "at"])
        first = F.min(F.struct("src", "dst", "line", "kind", "confidence")).alias("e")
        new = reach.join(by_count(visited), [*repo, "seed", "node"], "left_anti").groupBy(*repo, "seed", "node").agg(first)
        new = rounds.save(new.select(*repo, "seed", "node", F.lit(depth).alias("depth"), "e.src", "e.dst", "e.kind", "e.confidence", "e.line"))
        found = new if found is None else found.unionByName(new)
        frontier = new.select(*repo, "seed", "node")
        visited = visited.unionByName(frontier)
    return found


def within(edges: DataFrame, starts: DataFrame, mask: str | None = "CALLS", max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """([repo,] node, depth): what is within max_depth hops of any of starts([repo,] node), either way,
    at its least depth; the starts themselves aren't among it.

    All starts are one frontier: a node is met once, not once for each start that reaches it, so a
    level costs at most one look at each end of each edge.
    """
    own, repo, rounds = _masked(edges, mask), _repo(edges, starts), Rounds(edges.sparkSession)
    hop = lambda a, b: own.select(*repo, F.col(a).alias("at"), F.col(b).alias("node"))
    hops = hop("src", "dst").unionByName(hop("dst", "src"))
    frontier = rounds.save(starts.select(*repo, "node").distinct())
    visited, found = frontier, None
    for depth in range(1, max_depth + 1):
        reach = hops.join(by_count(frontier.withColumnRenamed("node", "at")), [*repo, "at"], "left_semi").select(*repo, "node").distinct()
        new = rounds.save(reach.join(by_count(visited), [*repo, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        found = new if found is None else found.unionByName(new)
        frontier = new.select(*repo, "node")
        visited = visited.unionByName(frontier)
    return found


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names and paths of both ends, null where a node isn't known."""
    repo = _repo(edges, nodes)
    end = lambda p: nodes.select(*repo, F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.col("path").alias(f"{p}_path"))
    return edges.join(end("src"), [*repo, "src"], "left").join(end("dst"), [*repo, "dst"], "left")


def hubs(edges: DataFrame, nodes: DataFrame | None = None, k: int = HUB_LIMIT) -> DataFrame:
    """([repo,] id, degree) of the nodes with most CALLS edges in and out; files and modules don't count."""
    repo = _repo(edges)
    ends = edges.filter("kind = 'CALLS'").select(*repo, F.explode(F.array("src", "dst")).alias("id"))
    degree = ends.groupBy(*repo, "id").agg(F.count(F.lit(1)).alias("degree"))
    if nodes is not None:
        degree = degree.join(nodes.filter(F.col("kind").isin(*SYMBOL_NODES)).select(*repo, "id"), [*repo, "id"], "left_semi")
    return degree.orderBy(F.desc("degree"), "id", *repo).limit(min(k, 64))


def references(edges: DataFrame, nodes: DataFrame, name: str, path: str | None = None, limit: int = 50, repo: str | None = None) -> DataFrame:
    """Incoming CALLS, INHERITS and IMPORTS edges of all nodes of a name; with a path, of those
    in it if there are any."""
    named, own = in_repo(nodes, repo).filter(F.col("name") == name), _repo(edges, nodes)
    if path:
        exact = named.filter(F.col("path") == path)
        named = exact if not exact.isEmpty() else named
    # saved, so that Spark knows how many there are and need not shuffle all edges for a few
    named = table_between_rounds(named.select(*own, F.col("id").alias("dst")))
    hit = edges.filter(F.col("kind").isin("CALLS", "INHERITS", "IMPORTS")).join(named, [*own, "dst"], "left_semi")
    return hit.orderBy("src", "dst", "line", *own).limit(min(limit, 64))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))


def apply_fragment(nodes: DataFrame, refs: DataFrame, new_nodes: DataFrame, new_refs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces all that files of paths([repo,] path) contributed; with no new rows it removes the files."""
    keep = lambda d: d.join(paths.select(*_repo(d, paths), "path"), [*_repo(d, paths), "path"], "left_anti").select(*d.columns)
    return keep(nodes).unionByName(new_nodes, allowMissingColumns=True), keep(refs).unionByName(new_refs, allowMissingColumns=True)


def live_modules(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Nodes without modules that nothing imports."""
    repo = _repo(nodes, refs)
    used = refs.filter("kind = 'IMPORTS'").select(*repo, F.col("dst").alias("id")).distinct()
    modules = nodes.filter("kind = 'module'").join(used, [*repo, "id"], "left_semi")
    return nodes.filter("kind <> 'module'").unionByName(modules)


def enclosing(positions: DataFrame, defs: DataFrame, strict: bool = False) -> DataFrame:
    """The smallest definition around each position, by file.

    positions(path, pos, …); defs(path, id, start, end). An interval join by cells: a definition
    covers the cells of 64 units between its ends, a position lies in one, so rows meet by
    (path, cell) and never all with all.
    """
    cell = defs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    at = positions.withColumn("cell", F.floor(F.col("pos") / 64))
    inside = (F.col("pos") > F.col("start")) if strict else (F.col("pos") >= F.col("start"))
    met = at.join(cell, ["path", "cell"]).filter(inside & (F.col("pos") < F.col("end") + (0 if strict else 1)))
    return met.groupBy(*positions.columns).agg(F.min_by("id", F.struct(F.col("end") - F.col("start"), "id")).alias("inside"))


def containers(defs: DataFrame) -> DataFrame:
    """([repo,] path, id, container): the smallest class, struct or interface strictly around a
    definition. defs([repo,] path, id, kind, start, end).

    Definitions of a file nest or stand apart, as blocks of code do. In order of their starts, the
    longer first, the containers that are open at a place form a stack; one fold over a file's
    definitions keeps it, so the work is linear in the definitions but for their sort.
    """
    repo = _repo(defs)
    schema = ", ".join([*(f"`{c}` {defs.schema[c].dataType.simpleString()}" for c in [*repo, "path", "id"]), "container string"])
    ordered = defs.select(*repo, "path", "id", "start", "end", F.col("kind").isin("class", "struct", "interface").alias("holds"))
    ordered = ordered.repartition(*repo, "path").sortWithinPartitions(*repo, "path", "start", F.desc("end"), F.desc("holds"), "id")
    return ordered.mapInArrow(_innermost(len(repo) + 1), schema)


def _innermost(n_keys: int):
    def run(batches):
        import pyarrow as pa

        file, stack = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = [[] for _ in range(n_keys + 2)]
            for *own, id_, start, end, holds in zip(*columns, strict=True):
                if own != file:
                    file, stack = own, []
                inside = around(stack, start, end)
                if inside:
                    for c, v in zip(out, [*own, id_, inside[0]], strict=True):
                        c.append(v)
                if holds:
                    stack.append((id_, start, end))
            kinds = [*batch.schema.types[: n_keys + 1], pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [*batch.schema.names[: n_keys + 1], "container"])

    return run


#: Where calls, imports and bases stand, per language (patterns with the name as group 1). Of
#: bases the pattern gives the list.
_CALL = r"\b([A-Za-z_]\w*)!?\s*\("
_NOT_CALLS = "if for while switch catch return function func fn def class sizeof match when elif except with and or not in is print new await super require require_relative".split()
IMPORT_PATTERNS = {
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "c": r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]",
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "javascript": r"^\s*(?:import\b|export\b.*?\bfrom\b|\}\s*from\b).*?['\"]([^'\"]+)['\"]",
    "typescript": r"^\s*(?:import\b|export\b.*?\bfrom\b|\}\s*from\b).*?['\"]([^'\"]+)['\"]", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "kotlin": r"^\s*import\s+([\w.]+)",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+?)(?:::\{.*)?(?:\s+as\s+\w+)?;?\s*$", "ruby": r"^\s*require(?:_relative)?\s*\(?['\"]([^'\"]+)['\"]",
}
INHERIT_PATTERNS = {
    "python": r"^\s*class\s+\w+\(([^)]*)\)", "javascript": r"\bclass\s+\w+\s+extends\s+([\w.]+)", "typescript": r"\b(?:class|interface)\s+\w+(?:<[^>]*>)?\s+(?:extends|implements)\s+([^{]+)",
    "java": r"\b(?:class|interface)\s+\w+(?:<[^>]*>)?\s+(?:extends|implements)\s+([^{]+)", "kotlin": r"\bclass\s+\w+(?:\([^)]*\))?\s*:\s*([^{]+)", "ruby": r"^\s*class\s+\w+\s*<\s*([\w:]+)",
}


def _by_language(patterns: dict[str, str], line: str = "line") -> Column:
    name = F.lit("")
    for lang, pattern in patterns.items():
        groups = [F.regexp_extract(line, pattern, g + 1) for g in range(re.compile(pattern).groups)]
        got = groups[0] if len(groups) == 1 else F.when(groups[0] != "", groups[0]).otherwise(groups[1])
        name = F.when(F.col("lang") == lang, got).otherwise(name)
    return name


def _base_names(clause: Column) -> Column:
    """Names in a list of bases: without arguments, keywords and named arguments, last parts."""
    bare = F.regexp_replace(F.regexp_replace(clause, r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", ""), r"\w+\s*=[^,]*|\b(?:extends|implements|by)\b", ",")
    last = F.transform(F.split(bare, r"[,\s]+"), lambda x: F.regexp_extract(x, r"(\w+)$", 1))
    return F.filter(last, lambda x: x != "")


#: Lines that begin no call: what they name is imported or a class.
_NO_CALLS = r"^\s*(?:#|import\b|use\b|package\b)"
_CLASS_HEAD = r"^\s*(?:[\w@]+\s+)*(?:class|struct|interface|trait|impl)\b"


def extract_refs(read: DataFrame) -> DataFrame:
    """refs(repo, src, name, path, line, kind, rev) of code: calls, imports and bases by line.

    read: chunkers.read_code(); strings and comments refer to nothing. A ref belongs to the smallest definition around its
    line, else to the file; the first line of equal refs counts. A line that begins a definition doesn't call it.
    Go receivers and functions in member blocks name their container (rev). All that a line's refs
    need stands in the row of its file, so nothing is joined.
    """
    own = ["repo", "path", "lang"]
    split = read.select(*own, "defs", F.split("text", "\n", -1).alias("line"), F.split("bare", "\n", -1).alias("bare"), "owner", "first", "here")
    each = split.select(*own, "defs", F.posexplode(F.arrays_zip("line", "bare", "owner", "first", "here")).alias("pos", "x"))
    # blank lines, comments and brackets name nothing
    each = each.filter(F.col("x.bare").rlike(r'[\w"]'))
    inside = F.get("defs", F.col("x.owner"))
    begun = F.transform(F.slice("defs", F.col("x.first") + 1, F.col("x.here")), lambda d: d["symbol"])
    rows = each.select(*own, (F.col("pos") + 1).alias("pos"), "x.line", "x.bare", inside["key"].alias("inside"), inside["kind_name"].alias("inside_kind"), begun.alias("begun"))
    signature = F.col("lang").isin("typescript") & F.col("bare").rlike(r"^\s*\w+\s*(?:<[^>]*>)?\([^)]*\)\s*:\s*[^{]+;?\s*$")
    # JavaScript and the like: `class A extends B(` calls nothing by a class's name; what an interface declares isn't called there
    calling = F.col("bare").contains("(") & ~signature & ~F.col("bare").rlike(_NO_CALLS) & ~F.col("bare").rlike(_CLASS_HEAD) & (F.coalesce("inside_kind", F.lit("")) != "interface")
    calls = F.when(calling, F.filter(F.regexp_extract_all("bare", F.lit(_CALL), F.lit(1)), lambda n: ~n.isin(*_NOT_CALLS) & ~F.array_contains("begun", n)))
    # an import's name may be a string, but its line must be one without what strings hold too
    imported = F.when(_by_language(IMPORT_PATTERNS, "bare") != "", F.array(_by_language(IMPORT_PATTERNS)))
    clause = _by_language(INHERIT_PATTERNS, "bare")
    bases = F.when(clause != "", _base_names(clause))
    receiver = F.when(F.col("lang") == "go", F.array(F.regexp_extract("bare", r"^func\s+\(\s*\w+\s+\*?(\w+)", 1)))
    none = F.array().cast("array<string>")
    said = lambda names, kind: F.transform(F.coalesce(names, none), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    refs = F.concat(said(calls, "CALLS"), said(imported, "IMPORTS"), said(bases, "INHERITS"), said(receiver, "CONTAINS"))
    out = rows.select("repo", "path", "pos", "inside", F.explode(refs).alias("said")).filter("said.name <> ''").select("repo", "path", "pos", "inside", "said.name", "said.kind")
    held = read.select("repo", "path", "defs", "owner", F.explode("defs").alias("d")).filter("d.kind_name = 'function' AND d.member_of IS NOT NULL")
    held = held.select("repo", "path", F.col("d.start_line").alias("pos"), F.get("defs", F.get("owner", F.col("d.start_line") - 1))["key"].alias("inside"), F.col("d.member_of").alias("name"), F.lit("CONTAINS").alias("kind"))
    file = F.concat(F.lit("file:"), "path")
    owned = out.unionByName(held).withColumn("src", F.when(F.col("kind") == "IMPORTS", file).otherwise(F.coalesce("inside", file))).withColumn("name", F.substring("name", 1, 255))
    return owned.groupBy("repo", "src", "name", "path", "kind").agg(F.min("pos").alias("line")).withColumn("rev", F.col("kind") == "CONTAINS")


def module_prefixes(files: DataFrame) -> DataFrame:
    """([repo,] prefix): names by which a repository's own files import each other, from its go.mod,
    package.json and Cargo.toml files."""
    base = F.element_at(F.split("path", "/"), -1)
    name = (
        F.when(base == "go.mod", F.regexp_extract("text", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1))
        .when(base == "package.json", F.get_json_object("text", "$.name"))
        .when(base == "Cargo.toml", F.regexp_replace(F.regexp_extract("text", r"(?ms)^\[package\].*?^\s*name\s*=\s*\"([^\"]+)\"", 1), "-", "_"))
    )
    return files.select(*_repo(files), name.alias("prefix")).filter("prefix <> ''").distinct()


#: Endings by which an import's name says that it is a file of the repository.
_SOURCE_END = r"\.(?:c|h|cc|cpp|hpp|go|js|jsx|ts|tsx|py|java|kt|rs|rb)$"


def import_map(files: DataFrame) -> DataFrame:
    """([repo,] name, file): the names by which files can be imported as a whole: their path without
    its ending, with ./ too; of Python dotted, of Rust from crate:: on; a Go package by `go:` and its
    directory. Of several files of a name the first stays, by seq if files have it, then by path."""
    repo = _repo(files)
    ending = F.regexp_extract("path", r"\.([^./]+)$", 1)
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    dotted = F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"\.__init__$", "")
    crate = F.concat(F.lit("crate::"), F.replace(F.regexp_replace(bare, "^src/", ""), F.lit("/"), F.lit("::")))
    plain = [bare, F.concat(F.lit("./"), bare)]
    names = (
        F.when(ending.isin("js", "jsx", "ts", "tsx"), F.array(*plain)).when(ending == "py", F.array(*plain, dotted)).when(ending == "rs", F.array(*plain, crate))
        .when(ending == "go", F.array(F.concat(F.lit("go:"), F.regexp_replace("path", r"/?[^/]*$", ""))))
    )
    order = F.struct(*(["seq"] if "seq" in files.columns else []), "path")
    return files.select(*repo, F.explode(names).alias("name"), order.alias("at")).groupBy(*repo, "name").agg(F.min("at")["path"].alias("file"))


def resolve_imports(imports: DataFrame, files: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """([repo,] src, name, dst, resolution, confidence): imports([repo,] src, name) to files([repo,]
    path[, seq]) of the repository, else to a module.

    Only names that may mean a file are led to one: relative ones, those with ::, dots but no
    slash, the ending of a source file, or a known module prefix(prefix). A bare word or
    `encoding/json` stays a module, whatever files there are. import_map() comes first; then a
    file fits if its path, with or without its ending, ends in the name, or if it lies in the
    directory of the name: one file that fits is taken, several are none.

    Names lose quotes, ./ and ../, the module prefix and crate::; dots and :: become slashes. Every
    end of a path and every directory is a row, so all of this is by equi-joins; a name's
    beginnings meet the prefixes by one too.
    """
    name = F.regexp_replace(F.regexp_replace("name", r"^(?:\.{1,2}/)+", ""), r"^(?:crate|self|super)::", "")
    repo = _repo(imports, files)
    key = [*repo, "src", "name"]
    rows = imports.select(*key).distinct().withColumn("wanted", name)
    if prefixes is not None:
        parts = F.split("wanted", "/|::")
        begin = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        of = _repo(rows, prefixes)
        own = rows.select(*key, F.explode(begin).alias("prefix")).join(prefixes.select(*of, "prefix").distinct(), [*of, "prefix"])
        longest = own.groupBy(*key).agg(F.max(F.length("prefix")).alias("cut"))
        rows = rows.join(longest, key, "left").withColumn("wanted", F.when(F.col("cut").isNotNull(), F.regexp_replace(F.substring("wanted", F.col("cut") + 1, F.lit(1 << 20)), "^(?:/|::)", "")).otherwise(F.col("wanted")))
    else:
        rows = rows.withColumn("cut", F.lit(None).cast("int"))
    said = F.col("name")
    local = F.col("cut").isNotNull() | said.rlike(r"^\.|::") | said.rlike(_SOURCE_END) | (said.contains(".") & ~said.contains("/"))
    rows = rows.withColumn("local", local).withColumn("mapped", F.when(F.col("cut").isNotNull(), F.concat(F.lit("go:"), F.col("wanted"))).otherwise(said))
    rows = rows.withColumn("wanted", F.when(F.col("wanted").contains("/") | F.col("wanted").rlike(_SOURCE_END), F.col("wanted")).otherwise(F.regexp_replace("wanted", r"::|\.", "/")))
    parts = F.split("path", "/")
    suffix = lambda arr: F.transform(F.sequence(F.lit(1), F.size(arr)), lambda i: F.array_join(F.slice(arr, i, F.size(arr)), "/"))
    bare = F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")
    inside = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    each = files.select(*repo, "path", F.explode(F.array_distinct(F.concat(suffix(parts), suffix(bare), inside))).alias("wanted"))
    one = each.groupBy(*repo, "wanted").agg(F.min("path").alias("file"), F.max("path").alias("other")).filter("file = other").drop("other")
    known = import_map(files).select(*repo, F.col("name").alias("mapped"), F.col("file").alias("whole"))
    met = rows.join(known, [*repo, "mapped"], "left").join(one, [*repo, "wanted"], "left").withColumn("to", F.when(F.col("local"), F.coalesce("whole", "file")))
    hit = F.col("to").isNotNull()
    return met.select(*key, F.when(hit, F.concat(F.lit("file:"), "to")).otherwise(F.concat(F.lit("mod:"), "name")).alias("dst"), F.when(hit, "IMPORT").otherwise("EXACT").alias("resolution"), F.when(hit, IMPORT).otherwise(EXACT).alias("confidence"))


def rewrite_imports(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """refs with the IMPORTS of resolve_imports() led to what they were resolved to; idempotent."""
    repo = _repo(refs, resolved)
    found = resolved.select(*repo, "src", "name", F.col("dst").alias("new_dst"), F.col("resolution").alias("new_resolution"), F.lit("IMPORTS").alias("kind"))
    imports = F.col("kind").eqNullSafe("IMPORTS")
    met = refs.filter(imports).join(found, [*repo, "src", "name", "kind"], "left")
    met = met.withColumn("dst", F.coalesce("new_dst", "dst")).withColumn("resolution", F.coalesce("new_resolution", "resolution")).select(*refs.columns)
    return refs.filter(~imports).unionByName(met)


def build_graph(files: DataFrame, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and refs of code files(repo, path, text, and seq if they have an order).

    Definitions are nodes by their chunk key; files and imported modules are nodes too. Refs hold
    the import of a file or module, the container of a nested definition, and names to be resolved
    at query time. Rows of other languages are left out.
    """
    return linked(*fragments(files), prefixes)


def linked(nodes: DataFrame, refs: DataFrame, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and refs of fragments() with imports led to files or modules. What an import led to
    before is forgotten first, so a graph whose files changed is linked anew by the same call."""
    unset = lambda of, new: F.when(F.col("kind") == "IMPORTS", new).otherwise(F.col(of)).alias(of)
    said = refs.select(*[unset("dst", F.concat(F.lit("mod:"), "name")) if c == "dst" else unset("resolution", F.lit("EXACT")) if c == "resolution" else F.col(c) for c in refs.columns])
    nodes = nodes.filter("kind <> 'module'")
    refs = table_between_rounds(rewrite_imports(said, resolve_imports(said.filter("kind = 'IMPORTS'"), nodes.filter("kind = 'file'"), prefixes)))
    none = F.lit(None).cast("int")
    modules = refs.filter("kind = 'IMPORTS' AND dst LIKE 'mod:%'").select("repo", F.col("dst").alias("id")).distinct()
    modules = modules.select("repo", "id", F.lit("module").alias("kind"), F.lit(None).cast("string").alias("lang"), F.substring("id", 5, 1 << 20).alias("name"), F.lit(None).cast("string").alias("path"), none.alias("start_line"), none.alias("end_line"), F.lit(0).cast("long").alias("seq"))
    return nodes.unionByName(modules), refs


def fragments(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each file contributes by itself: nodes without modules, and refs whose imports aren't
    led to files yet."""
    # nodes and refs are both made from it: saved, so that no file is read by its tokens again
    read = table_between_rounds(_read(files))
    said = extract_refs(read)
    said = said.select("repo", "src", F.when(F.col("kind") == "IMPORTS", F.concat(F.lit("mod:"), "name")).alias("dst"), "name", "path", "line", "kind", "rev", F.when(F.col("kind") == "IMPORTS", "EXACT").otherwise("TEXTUAL").alias("resolution"))
    defs = read.select("repo", "path", "defs", F.explode("defs").alias("d"))
    nested = defs.filter("d.container IS NOT NULL").select("repo", F.get("defs", F.col("d.container"))["key"].alias("src"), F.col("d.key").alias("dst"), F.col("d.symbol").alias("name"), "path", F.col("d.start_line").alias("line"), F.lit("CONTAINS").alias("kind"), F.lit(False).alias("rev"), F.lit("EXACT").alias("resolution"))
    # linking reads the imports by themselves and with the rest
    return _nodes(read), table_between_rounds(said.unionByName(nested))


def own_nodes(files: DataFrame) -> DataFrame:
    """The nodes of fragments() where nobody asks for refs: every file is read by its tokens, once."""
    return _nodes(_read(files))


def _read(files: DataFrame) -> DataFrame:
    from quarryline.operators import chunkers

    order = F.col("seq").cast("long") if "seq" in files.columns else F.pmod(F.xxhash64("repo", "path"), F.lit(1 << 42))
    code = files.withColumn("lang", language_of("path")).filter(F.col("lang").isin(*chunkers.DEFINITIONS))
    return chunkers.read_code(code.select("repo", "path", "lang", "text", order.alias("file_seq")))


def _nodes(read: DataFrame) -> DataFrame:
    """A file and its definitions, in one look at its row."""
    begin, none = F.col("file_seq") * (1 << 20), F.lit(None).cast("int")
    node = lambda id_, kind, name, first, last, seq: F.struct(id_.alias("id"), kind.alias("kind"), name.alias("name"), first.alias("start_line"), last.alias("end_line"), seq.alias("seq"))
    file = node(F.concat(F.lit("file:"), "path"), F.lit("file"), F.element_at(F.split("path", "/"), -1), none, none, begin)
    defs = F.transform("defs", lambda d: node(d["key"], d["kind_name"], d["symbol"], d["start_line"], d["end_line"], begin + d["start_line"]))
    each = read.select("repo", "path", "lang", F.explode(F.concat(F.array(file), defs)).alias("n"))
    return each.select("repo", "n.id", "n.kind", "lang", "n.name", "path", "n.start_line", "n.end_line", "n.seq")


#: Names of functions where programs begin (fixed values).
ENTRYPOINTS = ("main", "Main", "ServeHTTP", "Handler")


def trace_path(nodes: DataFrame, edges: DataFrame, name: str, path: str | None = None, mask: str | None = "CALLS", direction: str = "both", max_depth: int = DEFAULT_DEPTH, limit: int = TRACE_LIMIT, repo: str | None = None) -> DataFrame:
    """trace() from the latest node of a name, of those under path if given, with one exactly at
    path before the others; at most `limit` hops, those of least depth first."""
    found, own = in_repo(nodes, repo).filter(F.col("name") == name), _repo(edges, nodes)
    if path:
        found = found.filter(under_prefix("path", path)).withColumn("exact", F.col("path") == path)
    else:
        found = found.withColumn("exact", F.lit(False))
    seed = found.orderBy(F.desc("exact"), F.desc("seq"), *own).limit(1).select(*own, F.col("id").alias("seed"))
    hops = trace(edges, seed, mask, direction, max_depth)
    hops = table_between_rounds(hops.orderBy("depth", "src", "dst", "line").limit(min(limit, 256)))
    ends = hops.select(*own, F.explode(F.array("src", "dst")).alias("id")).distinct()
    return with_endpoints(hops, nodes.select(*own, "id", "name", "path").join(F.broadcast(ends), [*own, "id"], "left_semi")).orderBy("depth", "src", "dst", "line").limit(min(limit, 256))


def find_references(nodes: DataFrame, edges: DataFrame, lines: DataFrame, name: str, limit: int = 50, repo: str | None = None) -> DataFrame:
    """([repo,] source, path, line, src, text): the graph's references of a name; if it has none, the
    lines(path, line_no, line) that hold it as a whole word."""
    own = _repo(edges, nodes, lines)
    hit = table_between_rounds(references(edges, nodes, name, limit=limit, repo=repo))
    ends = nodes.select(*own, F.col("id").alias("src"), "path").join(F.broadcast(hit.select(*own, "src").distinct()), [*own, "src"], "left_semi")
    hit = hit.join(ends, [*own, "src"], "left")
    graph = table_between_rounds(hit.select(*own, F.lit("graph").alias("source"), "path", "line", "src", F.lit(None).cast("string").alias("text")))
    if not graph.isEmpty():
        return graph
    word = in_repo(lines, repo).filter(F.col("line").rlike(rf"\b\Q{name}\E\b"))
    return word.select(*own, F.lit("grep").alias("source"), "path", F.col("line_no").alias("line"), F.lit(None).cast("string").alias("src"), F.col("line").alias("text")).orderBy("path", "line", *own).limit(limit)


def language_mix(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(lang, files) of a graph's code files. With files(path, text) (lang, files, n_bytes,
    graph_files, symbols): those themselves, whatever their language, and the graph's files and
    definitions of it."""
    if files is None:
        return nodes.filter("kind = 'file'").groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    known = nodes.groupBy("lang").agg(F.count_if(F.col("kind") == "file").alias("graph_files"), F.count_if(F.col("kind").isin(*SYMBOL_NODES)).alias("symbols"))
    whole = files.groupBy(language_of("path").alias("lang")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))
    held = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("graph_files", "symbols")]
    return whole.join(known, "lang", "left").select("lang", "files", "n_bytes", *held)


def architecture(nodes: DataFrame, edges: DataFrame, hub_limit: int = HUB_LIMIT, each: int = 8, repo: str | None = None) -> DataFrame:
    """(part, name, path, kind, n): a repository at a glance. Parts: size, languages by number of
    files, hubs by degree, and of each of ENTRYPOINTS the latest definitions."""
    nodes, edges, own = in_repo(nodes, repo), in_repo(edges, repo), _repo(nodes, edges)
    none = F.lit(None).cast("string")
    size = counts(nodes, edges)
    size = size.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("nodes", "edges")])).alias("s"))
    size = size.select(F.lit("size").alias("part"), "s.name", none.alias("path"), none.alias("kind"), "s.n")
    langs = language_mix(nodes).select(F.lit("language").alias("part"), F.col("lang").alias("name"), none.alias("path"), none.alias("kind"), F.col("files").alias("n"))
    top = hubs(edges, nodes, hub_limit).join(nodes.select(*own, "id", "name", "path", "kind"), [*own, "id"])
    top = top.select(F.lit("hub").alias("part"), "name", "path", "kind", F.col("degree").alias("n"))
    begins = nodes.filter(F.col("name").isin(*ENTRYPOINTS) & F.col("kind").isin(*SYMBOL_NODES))
    latest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq"), *own))
    begins = begins.withColumn("k", latest).filter(F.col("k") <= each).select(F.lit("entrypoint").alias("part"), "name", "path", "kind", F.lit(None).cast("long").alias("n"))
    return size.unionByName(langs).unionByName(top).unionByName(begins)


def changed_symbols(hunks: DataFrame, outline: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, limit: int = 40) -> DataFrame:
    """(name, path, risk): symbols whose lines a diff touches (direct; at most half the limit when
    that is 4 or more), then what calls them or they call within depth (transitive)."""
    own = _repo(hunks, outline, edges, nodes)
    spans = outline.filter("symbol IS NOT NULL").withColumn("line", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))))
    direct = spans.join(hunks.select(*own, "path", "line").distinct(), [*own, "path", "line"], "left_semi").groupBy(*own, F.col("symbol").alias("name"), "path").agg(F.min("start_line").alias("at"))
    budget = limit // 2 if limit >= 4 else limit
    direct = table_between_rounds(direct.orderBy("path", "at", "name", *own).limit(budget))
    key = [*own, "name", "path"]
    changed = nodes.join(F.broadcast(direct.select(*key)), key, "left_semi").select(*own, F.col("id").alias("node"))
    # each level reads them from both ends
    edges = table_between_rounds(_masked(edges, "CALLS").select(*own, "src", "dst", "kind"))
    reached = by_count(within(edges, changed, "CALLS", depth).withColumnRenamed("node", "id"))
    indirect = reached.join(nodes, [*own, "id"]).join(F.broadcast(direct.select(*key)), key, "left_anti").groupBy(*key).agg(F.min("depth").alias("depth"))
    rest = indirect.orderBy("depth", "path", "name", *own).limit(limit - budget)
    return direct.select(*key, F.lit("direct").alias("risk")).unionByName(rest.select(*key, F.lit("transitive").alias("risk")))
