"""Queries of the engine's own steps, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import hashing, paths, text
from quarryline.operators import engine, graph, vectors
from quarryline.plans import code_corpus, data
from quarryline.schemas import KIND_CODE
from quarryline.streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


FILES = "files AS (SELECT source AS repo, lang || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text, doc_id FROM documents)"


@query("""WITH l AS (SELECT p_partkey AS line_no, CASE p_partkey % 4 WHEN 0 THEN 'no tab' WHEN 1 THEN chr(9) || '/r' WHEN 2 THEN 'k' || p_partkey || chr(9) ELSE 'k' || p_partkey || chr(9) || '/r' || chr(9) || p_brand END AS line FROM part)
SELECT line_no, split_part(line, chr(9), 1) AS key, '/r' || chr(9) || split_part(line, chr(9), 3) AS root FROM l WHERE line_no % 4 = 3""")
def s6_index_roots(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("k"), k.cast("string"), F.lit("\t"))
    line = F.when(k % 4 == 0, "no tab").when(k % 4 == 1, "\t/r").when(k % 4 == 2, name).otherwise(F.concat(name, F.lit("/r\t"), "p_brand"))
    return engine.roots_of_records(data.table(spark, sf, "part").select(k.alias("line_no"), line.alias("line")))


@query("SELECT doc_id AS id, source AS repo FROM documents WHERE source = 'src3' ORDER BY id LIMIT 5")
def d3_find_by_key(spark, sf):
    files = data.files(spark, sf)
    keyed = files.select("repo", F.col("doc_id").alias("id"), F.col("path").alias("key"))
    first = engine.in_repo(keyed, files.select("repo").distinct(), "src3").orderBy("id").limit(5)
    found = [engine.find_by_key(keyed, "src3", r["key"]) for r in first.collect()]
    return reduce(DataFrame.unionByName, found).select("id", "repo")


@query("""WITH k AS (SELECT min(doc_id) AS id FROM documents WHERE source = 'src2') SELECT d.doc_id AS id, d.source AS repo, d.lang || '/' || d.doc_id || '.txt' AS key FROM documents d JOIN k ON d.doc_id = k.id""")
def d3_find_by_id(spark, sf):
    chunks = data.files(spark, sf).select("repo", F.col("doc_id").alias("id"), F.col("path").alias("key"))
    least = chunks.filter("repo = 'src2'").agg(F.min("id")).first()[0]
    one = engine.find_by_id(chunks, "src2", least)
    return engine.find_by_key(one, "src2", one.first()["key"]).select("id", "repo", "key")


@query(f"""WITH {FILES} SELECT repo, path, 'added' AS op FROM files""")
def d11_cold_bootstrap(spark, sf):
    return engine.bootstrap(None, data.leaves(spark, sf)).changes


@query(f"""WITH {FILES} SELECT repo, path, CASE WHEN doc_id % 7 = 0 THEN 'added' ELSE 'modified' END AS op FROM files WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""")
def d11_warm_bootstrap(spark, sf):
    now = data.leaves(spark, sf)
    before = now.filter("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("hash")))
    return engine.bootstrap(before, now).changes


@query("""SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 2 = 0 THEN 'r' END AS repo, p_brand AS path, '' AS symbol,
  CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN p_size ELSE 0 END::INT AS start_line,
  CASE p_partkey % 4 WHEN 0 THEN p_partkey + 5 WHEN 1 THEN p_partkey WHEN 2 THEN p_size ELSE 0 END::INT AS end_line, 1.0::DOUBLE AS score, p_name AS snippet FROM part WHERE p_partkey % 5 <> 0""")
def f10_normalised_hits(spark, sf):
    k = F.col("p_partkey")
    number = k.cast("string")
    lines = F.when(k % 4 == 0, F.concat(F.lit(" "), number, F.lit("-"), (k + 5).cast("string"))).when(k % 4 == 1, number).when(k % 4 == 2, "odd")
    none = F.lit(None)
    raw = data.table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 2 == 0, "r").otherwise("").alias("repo"), F.when(k % 5 == 0, "").otherwise(F.col("p_brand")).alias("path"), none.cast("string").alias("symbol"), lines.alias("lines"),
        F.when(k % 4 == 2, F.col("p_size")).alias("start_line"), none.cast("int").alias("end_line"), none.cast("double").alias("score"), none.cast("string").alias("snippet"), F.col("p_name").alias("body"),
    )
    return engine.normalised_hits(raw)


KNN = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, 'r' || e.label AS repo, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e, e q WHERE q.vec_id % 100 = 0)"""


def _hits(spark, sf, k):
    table = data.table(spark, sf, "embeddings").withColumn("repo", F.concat(F.lit("r"), F.col("label").cast("string")))
    queries = table.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.knn(table, queries, k, by=["repo"]).drop("rank")


@query(f"{KNN}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, repo ORDER BY score DESC, id) <= 5) SELECT query_id, repo, id, score, d.source, d.n_chars FROM t JOIN documents d ON d.doc_id = t.id")
def j1_hits_with_chunks(spark, sf):
    docs = data.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    repos = data.table(spark, sf, "embeddings").select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("repo"), F.col("vec_id").alias("id"))
    return engine.hits_with_chunks(_hits(spark, sf, 5), repos.join(docs, "id")).select("query_id", "repo", "id", "score", "source", "n_chars")


@query(f"{KNN} SELECT query_id, repo, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id)::INT AS rank FROM s WHERE repo IN ('r1', 'r2', 'r3') QUALIFY rank <= 64")
def v10_fan_out(spark, sf):
    ready = spark.range(1, 4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo"))
    return engine.fan_out(_hits(spark, sf, 64), ready, 100)


@query("SELECT doc_id, length(coalesce(text, '')) AS n_chars FROM documents")
def v3_embedding_batches(spark, sf):
    rows = engine.embedding_batches(data.table(spark, sf, "documents"))
    size = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") <= engine.EMBED_BATCH)
    return rows.join(size, "batch").select("doc_id", "n_chars")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber < 3) SELECT (l_orderkey * 10 + l_linenumber)::INT AS line_no, lpad(l_partkey::VARCHAR, 8, '0') AS hash, 'A B' || l_linenumber AS author, '2024-01-02' AS date, 'x = (' || l_partkey || ')' AS text FROM l""")
def w12_git_blame(spark, sf):
    item = data.table(spark, sf, "lineitem")
    no = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    good = F.concat(F.when(F.col("l_linenumber") == 1, "^").otherwise(""), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit(" (A B"), F.col("l_linenumber").cast("string"), F.lit(" 2024-01-02 10:00:00 +0100 "), no, F.lit(") x = ("), F.col("l_partkey").cast("string"), F.lit(")"))
    line = F.when(F.col("l_linenumber") < 3, good).otherwise("fatal: no such path")
    return engine.git_blame(item.select(line.alias("line")))


@query("""SELECT doc_id, md5(CASE WHEN strlen(text) <= 1000 THEN text ELSE list_max(list_transform(list_filter(range(1, 1001), lambda i: strlen(substr(text, 1, i)) <= 1000), lambda i: lpad(i::VARCHAR, 5, '0') || substr(text, 1, i)))[6:] END) AS text, strlen(text) > 1000 AS truncated FROM documents""")
def w12_capped_output(spark, sf):
    return engine.capped(data.table(spark, sf, "documents").select("doc_id", "text"), 1000).withColumn("text", F.md5("text"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 256")
def k6_drained_events(spark, sf):
    taken, left = engine.drain(data.watch_events(spark, sf))
    return taken.join(left.select("seq"), "seq", "left_anti").select(F.col("seq").alias("event_id"))


@query("SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def s22_removed_sessions(spark, sf):
    rows = data.table(spark, sf, "conversations")
    gone = rows.filter("conv_id % 3 = 0").select(F.col("conv_id").alias("id")).distinct()
    return engine.remove_sessions(rows, gone).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("SELECT p_partkey, NOT (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS safe FROM part")
def f8_safe_paths(spark, sf):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/"), "p_name")).when(k % 5 == 0, F.concat(F.lit("a\\..\\"), "p_name")).otherwise(F.concat(F.lit("a/..b/"), "p_name"))
    return data.table(spark, sf, "part").select("p_partkey", paths.is_safe_relative(path).alias("safe"))


PRIVATE = {"10.1.2.3": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.9.9": True, "169.254.1.1": True, "127.0.0.1": True, "8.8.8.8": False, "[::1]": True, "[fd00::1]": True, "[2001:db8::1]": False, "localhost": True, "x.local": True, "example.org": False, "999.1.1.1": True, "224.0.0.1": True}


@query(f"""WITH h(i, host, private) AS (VALUES {", ".join(f"({i}, '{h}', {p})" for i, (h, p) in enumerate(PRIVATE.items()))}) SELECT page_id, host, private, NOT private AS fetchable FROM pages JOIN h ON page_id % {len(PRIVATE)} = i""")
def f9_private_hosts(spark, sf):
    host = F.element_at(F.array(*map(F.lit, PRIVATE)), (F.col("page_id") % len(PRIVATE)).cast("int") + 1)
    return data.table(spark, sf, "pages").select("page_id", host.alias("host"), text.is_private_host(host).alias("private"), text.is_fetchable(F.concat(F.lit("http://"), host, F.lit("/x"))).alias("fetchable"))


@query(f"""WITH k(i, name, code) AS (VALUES {", ".join(f"({i}, '{n}', {c})" for i, (n, c) in enumerate(KIND_CODE.items()))}) SELECT p_partkey, code FROM part JOIN k ON p_partkey % {len(KIND_CODE)} = i""")
def c10_kind_codes(spark, sf):
    names = F.array(*map(F.lit, KIND_CODE))
    name = F.element_at(names, (F.col("p_partkey") % len(KIND_CODE)).cast("int") + 1)
    codes = F.create_map(*[F.lit(x) for pair in KIND_CODE.items() for x in pair])
    return data.table(spark, sf, "part").select("p_partkey", codes[name].alias("code"))


@query("SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def t8_last_user_message(spark, sf):
    return text.last_user_message(data.table(spark, sf, "conversations"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'CREATE' WHEN 3 THEN 'CREATE' ELSE 'MODIFY' END AS kind FROM events""")
def k3_event_kinds(spark, sf):
    masks = F.array(*map(F.lit, ("IN_DELETE", "IN_MOVED_FROM|IN_ISDIR", "in_create", "IN_MOVED_TO", "IN_CLOSE_WRITE")))
    rows = data.table(spark, sf, "events").select("event_id", F.element_at(masks, (F.col("event_id") % 5).cast("int") + 1).alias("mask"))
    return rows.select("event_id", watch.event_kind("mask").alias("kind"))


@query(f"""WITH ev AS (SELECT 'u/' || user_id AS path, CASE event_type WHEN 'click' THEN 'MODIFY' WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'RENAME' END AS kind, ts, event_id AS seq FROM events),
l AS (SELECT path, list(kind ORDER BY ts, seq) AS kinds FROM ev GROUP BY path) SELECT 'r' AS repo, path, list_reduce(kinds, lambda a, b: CASE WHEN a = 'DELETE' AND b <> 'CREATE' THEN 'DELETE' ELSE b END) AS kind FROM l""")
def k1_dirty_paths(spark, sf):
    return watch.dirty_paths(watch.merge_kinds(data.watch_events(spark, sf)))


@query(f"""WITH ev AS (SELECT 'u/' || user_id AS path, CASE event_type WHEN 'click' THEN 'MODIFY' WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'RENAME' END AS kind, ts, event_id AS seq FROM events),
l AS (SELECT path, list(kind ORDER BY ts, seq) AS kinds FROM ev GROUP BY path) SELECT 'r' AS repo, path, list_reduce(kinds, lambda a, b: CASE WHEN a = 'DELETE' AND b <> 'CREATE' THEN 'DELETE' ELSE b END) AS kind FROM l""")
def k1_dirty_set(spark, sf):
    events = data.watch_events(spark, sf)
    middle = events.agg(F.timestamp_seconds(F.avg(F.unix_timestamp("ts"))).alias("at")).first()["at"]
    dirty = watch.DirtySet(spark)
    dirty.add(events.filter(F.col("ts") < F.lit(middle)))
    dirty.add(events.filter(F.col("ts") >= F.lit(middle)))
    return dirty.drain()


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'RENAME' WHEN 2 THEN 'CREATE' ELSE 'MODIFY' END AS kind FROM events")
def k3_fsevent_kinds(spark, sf):
    flags = F.array(*map(F.lit, ("ItemCreated|ItemRemoved", "ItemCreated|ItemRenamed", "itemcreated|ItemModified", "ItemXattrMod")))
    rows = data.table(spark, sf, "events").select("event_id", F.element_at(flags, (F.col("event_id") % 4).cast("int") + 1).alias("flags"))
    return rows.select("event_id", watch.fsevent_kind("flags").alias("kind"))


@query(f"""WITH {code_corpus.FILES_SQL} SELECT DISTINCT 'pkg' || (k % 20) || '.example' AS prefix FROM code""")
def g19_module_prefixes(spark, sf):
    base = F.split("path", "/")[0]
    made = code_corpus.code_files(spark, sf).select(F.concat(base, F.lit("/go.mod")).alias("path"), F.concat(F.lit("// note\nmodule "), base, F.lit(".example\n\ngo 1.22\n")).alias("text"))
    return graph.module_prefixes(made)


@query()
def h3_node_ids(spark, sf):
    return data.files(spark, sf).select("path", hashing.file_node_id("path").alias("id"), hashing.module_node_id("repo").alias("module"))
