"""Registered queries of the engine's operators, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import hashing, pages, paths, text
from quarryline.operators import diff, graph, pipes, search, vector_index, vectors, workspace
from quarryline.operators.rounds import new_folder
from quarryline.plans import data
from quarryline.sources import files as sources
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
CHUNKS = FILES + r""", lines AS (SELECT *, string_split(text, chr(10)) AS l FROM files),
wins AS (SELECT *, unnest(CASE WHEN text = '' THEN [] ELSE range(0, len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END, 50) END) AS first FROM lines),
bodies AS (SELECT repo, path, doc_id, first // 50 AS n, first, array_to_string(l[first + 1 : first + 50], chr(10)) || CASE WHEN first + 50 < len(l) THEN chr(10) ELSE '' END AS body,
  CASE WHEN first = 0 THEN 0 ELSE strlen(array_to_string(l[1 : first], chr(10))) + 1 END AS start_byte, least(first + 50, len(l)) AS end_line FROM wins),
chunks AS (SELECT repo, path, doc_id, path || '::6::#' || n AS key, n::INT AS n, first, body, md5(body) AS hash, start_byte::INT AS start_byte, (start_byte + strlen(body))::INT AS end_byte, (first + 1)::INT AS start_line, end_line::INT AS end_line FROM bodies)"""
PREV = "prev AS (SELECT repo, path, CASE WHEN doc_id % 5 = 0 THEN 'x' || text ELSE text END AS text FROM files WHERE doc_id % 7 <> 0), now AS (SELECT repo, path, text FROM files WHERE doc_id % 11 <> 0)"
LINES = FILES + ", ll AS (SELECT repo, path, text, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM files)"


# --- chunks -----------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT repo, path, key, n, hash, start_byte, end_byte, start_line, end_line FROM chunks")
def c1_window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return data.chunks(spark, sf).select("repo", "path", "key", F.col("n").cast("int").alias("n"), "hash", "start_byte", "end_byte", "start_line", "end_line")


@query(f"WITH {CHUNKS} SELECT repo, count(*) AS chunks, count(DISTINCT path) AS files, sum(end_byte - start_byte)::BIGINT AS bytes FROM chunks GROUP BY repo")
def g17_counts_by_repo(spark, sf):
    return data.chunks(spark, sf).groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"), F.sum((F.col("end_byte") - F.col("start_byte")).cast("long")).alias("bytes"))


@query(f"""WITH {FILES}, p AS (SELECT repo, path, unnest(['vendor/' || path, 'a/' || path, 'x.' || repo]) AS q FROM files)
SELECT repo, q AS path FROM p WHERE NOT list_has_any(string_split(q, '/')[:-2], ['.git', 'node_modules', 'vendor', '.venv', '__pycache__', '.next', 'dist', 'build', 'target', '.gradle', '.idea', '.terraform'])""")
def s1_walk_skips(spark, sf):
    shown = F.explode(F.array(F.concat(F.lit("vendor/"), "path"), F.concat(F.lit("a/"), "path"), F.concat(F.lit("x."), "repo")))
    return data.files(spark, sf).select("repo", shown.alias("path")).filter(~paths.in_skipped_dir("path"))


@query("""WITH p AS (SELECT p_partkey, p_type, CASE p_partkey % 5 WHEN 0 THEN 'a/b.go' WHEN 1 THEN 'b.tsx' WHEN 2 THEN 'm.PY' WHEN 3 THEN 'x.y/noext' ELSE 'c.rake' END AS path FROM part)
SELECT p_partkey, path, CASE p_partkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' WHEN 4 THEN 'ruby' ELSE 'unknown' END AS lang FROM p""")
def s5_language_of(spark, sf):
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, "a/b.go").when(k == 1, "b.tsx").when(k == 2, "m.PY").when(k == 3, "x.y/noext").otherwise("c.rake")
    return data.table(spark, sf, "part").select("p_partkey", path.alias("path"), paths.language_of(path).alias("lang"))


@query("""WITH l AS (SELECT p_partkey AS line_no, CASE WHEN p_partkey % 7 = 0 THEN '# note' WHEN p_partkey % 11 = 0 THEN 'broken' ELSE p_brand || chr(9) || '/r/' || p_name END AS line FROM part),
s AS (SELECT line_no, trim(string_split(line, chr(9))[1]) AS key, trim(string_split(line, chr(9))[2]) AS root FROM l WHERE line NOT LIKE '#%' AND line LIKE '%' || chr(9) || '%'),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY line_no) = 1)
SELECT line_no, key, root FROM k QUALIFY row_number() OVER (PARTITION BY root ORDER BY line_no) = 1""")
def s7_registry(spark, sf):
    k = F.col("p_partkey")
    line = F.when(k % 7 == 0, "# note").when(k % 11 == 0, "broken").otherwise(F.concat("p_brand", F.lit("\t/r/"), "p_name"))
    return sources.registry(data.table(spark, sf, "part").select(k.alias("line_no"), line.alias("line")))


@query("""WITH r AS (SELECT DISTINCT '/src/' || s_nationkey || '/' || (s_suppkey % 40) AS root, (s_suppkey % 40)::VARCHAR AS name FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM r)
SELECT root, CASE WHEN n > 1 THEN name || '-' || substr(sha256(root), 1, 6) ELSE name END AS key FROM c""")
def s8_derived_keys(spark, sf):
    root = F.concat(F.lit("/src/"), F.col("s_nationkey").cast("string"), F.lit("/"), (F.col("s_suppkey") % 40).cast("string"))
    return sources.derive_keys(data.table(spark, sf, "supplier").select(root.alias("root")).distinct())


@query("""WITH v AS (SELECT vec_id, label FROM embeddings) SELECT vec_id AS query_id, vec_id * 10 + i AS id, 0.5::DOUBLE AS score FROM v, unnest([1, 2]) AS u(i)""")
def s19_parse_hits(spark, sf):
    one = lambda i: F.format_string('{"id": %d, "score": 0.5}', F.col("vec_id") * 10 + i)
    body = F.concat(F.lit('{"result": ['), one(1), F.lit(", "), one(2), F.lit('], "status": "ok"}'))
    return sources.parse_hits(data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), body.alias("body")))


@query("""SELECT page_id AS query_id, 0 AS rank, 't' AS title, url, '' AS content FROM pages""")
def s21_web_results(spark, sf):
    items = F.array(F.struct(F.lit(" t ").alias("title"), F.concat(F.lit(" "), "url").alias("url"), F.lit("").alias("content")), F.struct(F.lit("no url").alias("title"), F.lit(" ").alias("url"), F.lit("x").alias("content")))
    return sources.web_results(data.table(spark, sf, "pages").select(F.col("page_id").alias("query_id"), F.to_json(F.struct(items.alias("results"))).alias("body")))


@query(r"""WITH t AS (SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) AS turns, max(turn) AS last_turn, min_by(text, turn) FILTER (role = 'user') AS first FROM conversations GROUP BY conv_id),
c AS (SELECT *, trim(regexp_replace(first, '\s+', ' ', 'g')) AS clean FROM t)
SELECT conv_id, CASE WHEN coalesce(clean, '') = '' THEN 'New chat' WHEN length(clean) > 60 THEN substr(clean, 1, 59) || '…' ELSE clean END AS title, user_turns, turns, last_turn FROM c""")
def s22_sessions(spark, sf):
    return text.sessions(data.table(spark, sf, "conversations"))


# --- hashes and changes -----------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT repo, md5(string_agg(key || ':' || hash, ',' ORDER BY key)) AS fingerprint, count(*) AS n FROM chunks GROUP BY repo")
def h2_fingerprint(spark, sf):
    return hashing.fingerprint_md5(data.chunks(spark, sf), ["repo"], "key", "hash")


@query(f"""WITH {CHUNKS}, parts AS (SELECT repo, substr(md5(key), 1, 4) AS r, md5(string_agg(key || ':' || hash, ',' ORDER BY key)) AS h, count(*) AS n FROM chunks GROUP BY repo, r)
SELECT repo, md5(string_agg(r || ':' || h, ',' ORDER BY r)) AS fingerprint, sum(n)::BIGINT AS n FROM parts GROUP BY repo""")
def h2_range_fingerprint(spark, sf):
    return hashing.fingerprint_ranges(data.chunks(spark, sf), ["repo"], "key", "hash")


@query()
def h1_content_hash(spark, sf):
    return data.files(spark, sf).select("doc_id", F.hex(hashing.content_hash(F.encode("text", "UTF-8"))).alias("hash"))


SYNC = f"""WITH {FILES}, {PREV}, a AS (SELECT repo, path AS key, md5(text) AS h FROM prev), b AS (SELECT repo, path AS key, md5(text) AS h FROM now)
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.key, b.key) AS key, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS op, coalesce(b.h, a.h) AS hash
FROM a FULL JOIN b ON a.repo = b.repo AND a.key = b.key"""


@query(SYNC)
def d1_chunk_sync(spark, sf):
    prev, now = data.snapshots(spark, sf)
    known = prev.select("repo", F.col("path").alias("key"), F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    return diff.sync_changes(known, now.select("repo", F.col("path").alias("key"), F.md5("text").alias("hash"))).select("repo", "key", "op", "hash")


@query(f"""WITH {FILES}, {PREV} SELECT n.repo, count(*) AS added, max(x.m) + count(*) AS next_id, (count(*) * (2 * max(x.m) + count(*) + 1) / 2)::BIGINT AS id_sum
FROM now n ANTI JOIN prev p ON n.repo = p.repo AND n.path = p.path JOIN (SELECT repo, max(doc_id) AS m FROM files WHERE doc_id % 7 <> 0 GROUP BY repo) x ON n.repo = x.repo GROUP BY n.repo""")
def d1_new_ids(spark, sf):
    prev, now = data.snapshots(spark, sf)
    known = prev.select("repo", F.col("path").alias("key"), F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    next_ids = known.groupBy("repo").agg((F.max("id") + 1).alias("next_id"))
    changes = diff.sync(known, now.select("repo", F.col("path").alias("key"), F.md5("text").alias("hash")), next_ids)
    return changes.filter("op = 'added'").groupBy("repo").agg(F.count(F.lit(1)).alias("added"), F.max("id").alias("next_id"), F.sum("id").alias("id_sum"))


@query(f"""WITH {FILES}, {PREV} SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS op
FROM prev a FULL JOIN now b ON a.repo = b.repo AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR md5(a.text) <> md5(b.text)""")
def d9_manifest_diff(spark, sf):
    prev, now = data.snapshots(spark, sf)
    leaf = lambda d: d.select("repo", "path", F.md5("text").alias("hash"))
    return diff.manifest_diff(leaf(prev), leaf(now))


@query(f"""WITH {FILES}, {PREV} SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS op
FROM prev a FULL JOIN now b ON a.repo = b.repo AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR md5(a.text) <> md5(b.text)""")
def d9_pruned_diff(spark, sf):
    stored, dirs = [], []
    for d in data.snapshots(spark, sf):
        leaves = d.select("repo", "path", F.md5("text").alias("hash"))
        folder = new_folder(spark)
        diff.by_directory(leaves).repartition("part").write.partitionBy("part").parquet(folder)
        stored.append(spark.read.parquet(folder))
        dirs.append(diff.directory_rollup(leaves))
    return diff.pruned_manifest_diff(*stored, *dirs)


ROLLUP = f"""{FILES}, leaf AS (SELECT repo, split_part(path, '/', 1) AS dir, split_part(path, '/', 2) AS name, md5(text) AS h FROM files),
d1 AS (SELECT repo, dir, 1 AS depth, md5(string_agg(name || ':' || h, ',' ORDER BY name)) AS fingerprint, count(*) AS n FROM leaf GROUP BY repo, dir),
d0 AS (SELECT repo, '' AS dir, 0 AS depth, md5(string_agg(dir || ':' || fingerprint, ',' ORDER BY dir)) AS fingerprint, count(*) AS n FROM d1 GROUP BY repo)"""


@query(f"WITH {ROLLUP} SELECT * FROM d1 UNION ALL SELECT * FROM d0")
def d7_directory_rollup(spark, sf):
    return diff.directory_rollup(data.leaves(spark, sf))


@query(f"""WITH {FILES}, h AS (SELECT repo, bool_or(doc_id % 50 = 1) AS changed FROM files GROUP BY repo) SELECT repo FROM h WHERE changed""")
def d8_changed_repos(spark, sf):
    now = data.leaves(spark, sf)
    prev = now.withColumn("hash", F.when(F.col("doc_id") % 50 == 1, F.lit("0")).otherwise(F.col("hash")))
    return diff.changed_repos(diff.directory_rollup(prev), diff.directory_rollup(now))


@query(f"""WITH {FILES} SELECT repo, path, strlen(text)::BIGINT AS size, doc_id AS mtime, md5(text) AS hash, doc_id % 9 = 0 AS rehashed FROM files""")
def d6_rebuilt_manifest(spark, sf):
    now = data.files(spark, sf).withColumn("size", F.octet_length("text").cast("long")).withColumn("mtime", F.col("doc_id"))
    prev = now.filter("doc_id % 9 <> 0").select("repo", "path", "size", "mtime", F.md5("text").alias("hash"))
    stats = now.select("repo", "path", "size", "mtime")
    read = now.join(diff.needs_hash(prev, stats).select("repo", "path"), ["repo", "path"], "left_semi").select("repo", "path", F.md5("text").alias("hash"))
    return diff.rebuilt_manifest(prev, stats, read)


@query(f"""WITH {FILES}, {PREV}, t AS (SELECT DISTINCT n.repo, n.path FROM now n LEFT JOIN prev p ON n.repo = p.repo AND n.path = p.path WHERE p.path IS NULL OR md5(p.text) <> md5(n.text)),
gone AS (SELECT p.repo, p.path FROM prev p ANTI JOIN now n ON p.repo = n.repo AND p.path = n.path)
SELECT p.repo, p.path, md5(p.text) AS hash, 'carried' AS origin FROM prev p WHERE (repo, path) NOT IN (SELECT repo, path FROM t) AND (repo, path) NOT IN (SELECT repo, path FROM gone)
UNION ALL SELECT n.repo, n.path, md5(n.text), 'fresh' FROM now n JOIN t ON n.repo = t.repo AND n.path = t.path""")
def d10_incremental_pass(spark, sf):
    prev, now = data.snapshots(spark, sf)
    leaf = lambda d, origin: d.select("repo", "path", F.md5("text").alias("hash"), F.lit(origin).alias("origin"))
    changed = diff.manifest_diff(leaf(prev, ""), leaf(now, ""))
    fresh = leaf(now, "fresh").join(changed.filter("op <> 'deleted'").select("repo", "path"), ["repo", "path"], "left_semi")
    return diff.carry_over(leaf(prev, "carried"), changed, fresh)


# --- filters and search -----------------------------------------------------------------------


@query(f"""WITH {CHUNKS} SELECT repo, key FROM chunks WHERE repo = 'src3' AND regexp_matches(path, '^en/[^/]*[0-4]\\.txt$')""")
def f1_glob_filter(spark, sf):
    return search.chunk_filter(data.chunks(spark, sf), repo="src3", kind="window", path_glob="en/*[0-4].txt").select("repo", "key")


@query(f"WITH {FILES} SELECT repo, path FROM files WHERE path = 'fr' OR path LIKE 'fr/%'")
def f3_path_prefix(spark, sf):
    return data.files(spark, sf).filter(paths.under_prefix("path", "fr")).select("repo", "path")


@query(f"""WITH {CHUNKS} SELECT key, strlen(body)::INT AS body_bytes, CASE WHEN strlen(body) <= 399 THEN body
  WHEN strlen(substr(body, 1, 399)) = 399 THEN substr(body, 1, 399) ELSE list_max(list_transform(list_filter(range(1, 400), lambda i: strlen(substr(body, 1, i)) <= 399), lambda i: lpad(i::VARCHAR, 4, '0') || substr(body, 1, i)))[5:] END AS snippet FROM chunks""")
def f6_snippet(spark, sf):
    return data.chunks(spark, sf).select("key", F.octet_length("body").alias("body_bytes"), search.snippet().alias("snippet"))


@query(r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages) SELECT page_id, host LIKE '%.local' OR host = 'localhost' AS private, TRUE AS fetchable FROM h""")
def f9_fetchable(spark, sf):
    host = F.parse_url("url", F.lit("HOST"))
    return data.table(spark, sf, "pages").select("page_id", paths.any_of([text.is_private_host(host)]).alias("private"), text.is_fetchable("url").alias("fetchable"))


def _norm_sql(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, list_transform(v, lambda x: round(x / {_norm_sql('v')}, 6)) AS unit FROM e""")
def v1_normalized(spark, sf):
    return data.table(spark, sf, "embeddings").select("vec_id", F.transform(vectors.l2_normalize("embedding"), lambda x: vectors.rounded(x)).alias("unit"))


KNN = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e, e q WHERE q.vec_id % 100 = 0)"""


def _queries(spark, sf):
    return data.table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"{KNN} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10")
def v6_knn(spark, sf):
    return vectors.knn(data.table(spark, sf, "embeddings"), _queries(spark, sf), 10)


@query(f"{KNN} SELECT query_id, label, id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 3")
def v10_knn_per_repo(spark, sf):
    return vectors.knn(data.table(spark, sf, "embeddings"), _queries(spark, sf), 3, by=["label"])


@query(f"{KNN} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s WHERE label = 3 QUALIFY rank <= 10")
def v9_filtered_knn(spark, sf):
    return vectors.knn(data.table(spark, sf, "embeddings").filter("label = 3"), _queries(spark, sf), 10)


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: round(x / {_norm_sql('v')} * 127)) AS b FROM e),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.b, e.b), 6) AS score FROM u e, u q WHERE q.vec_id % 100 = 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def v8_quantized_knn(spark, sf):
    table = data.table(spark, sf, "embeddings").select("vec_id", vectors.quantize_i8("embedding").alias("embedding"))
    return vectors.knn(table, _queries(spark, sf).withColumn("q", vectors.quantize_i8("q")), 10)


@query(f"{KNN} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10")
def v7_bucketed_knn(spark, sf):
    """By the stored index with its bound: what a search of all vectors gives."""
    table = data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector_index.VectorIndex(spark, new_folder(spark)).create(table).search(_queries(spark, sf), 10)


@query("""WITH later AS (SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings WHERE vec_id % 9 <> 4),
s AS (SELECT q.vec_id AS query_id, e.id, round(list_cosine_similarity(e.v, list_transform(q.embedding, lambda x: x::DOUBLE)), 6) AS score FROM later e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 5""")
def s13_vector_store(spark, sf):
    """An index that is made, changed and opened again: a sixth is replaced, a ninth removed."""
    table = data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    folder = new_folder(spark)
    index = vector_index.VectorIndex(spark, folder).create(table)
    index.add(table.filter("id % 6 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    index.remove(table.filter("id % 9 = 4").select("id"))
    return vector_index.VectorIndex(spark, folder).search(_queries(spark, sf), 5)


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 8 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 8 = 4""")
def v5_upsert_remove(spark, sf):
    own = data.table(spark, sf, "embeddings").select("vec_id", "label")
    changed = own.filter("vec_id % 8 = 0").withColumn("label", F.lit(-1).cast("int"))
    absent = own.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"))
    return vectors.remove(vectors.upsert(own, changed, ["vec_id"]), absent, ["vec_id"])


@query(f"WITH {CHUNKS} SELECT key, strlen(body)::DOUBLE AS vector FROM chunks")
def v4_unique_bodies(spark, sf):
    return vectors.embed_unique(data.chunks(spark, sf), F.octet_length("_body").cast("double")).select("key", "vector")


TERMS = r"list_filter(list_transform(regexp_split_to_array(lower({0}), '\s+'), lambda w: trim(w, '.,;:!?""''()[]{{}}')), lambda w: strlen(w) >= 3 AND NOT list_contains(['the','a','an','is','are','was','where','how','what','which','does','do','in','of','to','for','and','or','with','from','by','on','at'], w))".replace('""', '"')


@query(f"SELECT item_id, {TERMS.format('text')} AS terms FROM benchmark")
def v11_terms(spark, sf):
    return data.table(spark, sf, "benchmark").select("item_id", search.significant_terms("text").alias("terms"))


@query(f"""WITH {FILES}, q AS (SELECT {TERMS.format("'Of the thand ering, nders and worthless'")} AS terms),
c AS (SELECT doc_id AS id, round((doc_id % 97) / 97.0::DOUBLE, 6) AS score, substr(text, 1, 60) AS snippet, text FROM files),
b AS (SELECT id, score, len(list_filter(terms, lambda t: contains(lower(chr(10) || snippet), t))) AS near, len(list_filter(terms, lambda t: contains(lower(text), t))) AS far FROM c, q)
SELECT id, score, (CASE WHEN near > 0 THEN near ELSE far END)::INT AS boost, round(score + (CASE WHEN near > 0 THEN near ELSE far END) * 0.05, 6) AS final_score FROM b ORDER BY final_score DESC, id LIMIT 8""")
def v12_hybrid(spark, sf):
    hits = data.files(spark, sf).select(F.col("doc_id").alias("id"), F.round((F.col("doc_id") % 97) / 97.0, 6).alias("score"), F.lit(None).cast("string").alias("symbol"), F.substring("text", 1, 60).alias("snippet"), "text")
    return search.hybrid(hits, search.significant_terms(F.lit("Of the thand ering, nders and worthless"))).select("id", "score", "boost", "final_score")


@query(f"WITH {CHUNKS}, big AS (SELECT repo, path FROM chunks GROUP BY repo, path ORDER BY count(*) DESC, repo, path LIMIT 1) SELECT key, start_line, end_line FROM chunks JOIN big USING (repo, path)")
def v13_outline(spark, sf):
    chunks = data.chunks(spark, sf)
    big = chunks.groupBy("repo", "path").count().orderBy(F.desc("count"), "repo", "path").first()
    return search.file_outline(chunks, big["repo"], big["path"]).select("key", "start_line", "end_line")


@query("SELECT p_partkey AS id, p_brand AS repo, p_name AS symbol, 1.0::DOUBLE AS score FROM part WHERE contains(lower(p_name), 'al') ORDER BY p_brand, p_partkey LIMIT 20")
def v14_find_symbol(spark, sf):
    rows = data.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.col("p_name").alias("symbol"))
    return search.find_symbol(rows, "AL")


@query(f"WITH {FILES} SELECT repo, doc_id AS id, text AS body, FALSE AS truncated FROM files WHERE repo = 'src2' AND doc_id = (SELECT min(doc_id) FROM files WHERE repo = 'src2')")
def v15_get_chunk(spark, sf):
    rows = data.files(spark, sf).select("repo", F.col("doc_id").alias("id"), F.col("text").alias("body"))
    first = rows.filter("repo = 'src2'").agg(F.min("id")).first()[0]
    return search.get_chunk(rows, "src2", first)


# --- graph ------------------------------------------------------------------------------------

NODES = "nodes AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_brand AS path, p_partkey AS seq, (p_partkey % 1000)::INT AS start_line, (p_partkey % 1000 + 5)::INT AS end_line FROM part)"
REFS = """refs AS (SELECT 'p' || l_suppkey AS src, t.p_name AS name, o.p_brand AS path, (min(l_orderkey) % 1000)::INT AS line FROM lineitem JOIN part t ON t.p_partkey = l_partkey JOIN part o ON o.p_partkey = l_suppkey GROUP BY 1, 2, 3)"""
RESOLVED = NODES + ", " + REFS + """, c AS (SELECT r.*, n.id AS dst, n.seq, n.path = r.path AS near, count(*) OVER (PARTITION BY r.src, r.name, r.path) AS total, bool_or(n.path = r.path) OVER (PARTITION BY r.src, r.name, r.path) AS shadow FROM refs r JOIN nodes n ON n.name = r.name),
k AS (SELECT *, row_number() OVER (PARTITION BY src, name, path ORDER BY seq DESC) AS rk FROM c WHERE near OR NOT shadow),
named AS (SELECT src, dst, name, path, line, CASE WHEN near THEN 0.9 ELSE round(0.75 * least(1.0, 3.0 / total), 6) END::DOUBLE AS confidence FROM k WHERE rk <= 8)"""
CALLS = "calls AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {RESOLVED} SELECT src, dst, name, path, 'CALLS' AS kind, line, confidence FROM named")
def g9_resolve_names(spark, sf):
    return graph.resolve_names(data.named_refs(spark, sf), data.nodes(spark, sf)).select("src", "dst", "name", "path", "kind", "line", "confidence")


@query(f"""WITH {RESOLVED} SELECT src, dst, 'CALLS' AS kind, 'TEXTUAL' AS resolution, confidence, line FROM named
UNION ALL SELECT 'file:' || path, id, 'DEFINES', 'EXACT', 1.0, start_line FROM nodes""")
def g10_edges(spark, sf):
    refs = data.named_refs(spark, sf).withColumn("dst", F.lit(None).cast("string")).withColumn("rev", F.lit(False)).withColumn("resolution", F.lit("TEXTUAL"))
    return graph.edges_view(refs, data.nodes(spark, sf))


@query(f"WITH {CALLS} SELECT src, dst, line FROM calls WHERE dst = 'p7'")
def g11_edges_to(spark, sf):
    return graph.edges_to(data.call_edges(spark, sf), "p7", "calls").select("src", "dst", "line")


@query(f"WITH {NODES}, one AS (SELECT name FROM nodes ORDER BY seq LIMIT 1) SELECT id, name, path, seq FROM nodes WHERE name = (SELECT name FROM one) ORDER BY seq DESC LIMIT 20")
def g13_find_nodes(spark, sf):
    nodes = data.nodes(spark, sf)
    return graph.find_nodes(nodes, nodes.orderBy("seq").first()["name"], "symbol").select("id", "name", "path", "seq")


@query(f"""WITH RECURSIVE {CALLS}, hop AS (SELECT src AS a, dst AS b FROM calls UNION ALL SELECT dst, src FROM calls),
w AS (SELECT 's1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN hop ON a = node WHERE depth < 2)
SELECT 's1' AS seed, node, min(depth)::INT AS depth FROM w WHERE node <> 's1' GROUP BY node""")
def g14_trace(spark, sf):
    seeds = spark.createDataFrame([("s1",)], "seed string")
    return graph.trace(data.call_edges(spark, sf), seeds).select("seed", "node", "depth")


@query(f"""WITH {CALLS}, e AS (SELECT unnest([src, dst]) AS id FROM calls) SELECT id, count(*) AS degree FROM e GROUP BY id ORDER BY degree DESC, id LIMIT 10""")
def g16_hubs(spark, sf):
    return graph.hubs(data.call_edges(spark, sf))


@query(f"""WITH {RESOLVED}, one AS (SELECT name FROM nodes ORDER BY seq LIMIT 1) SELECT src, dst, line FROM named WHERE dst IN (SELECT id FROM nodes WHERE name = (SELECT name FROM one)) ORDER BY src, dst, line LIMIT 50""")
def g18_references(spark, sf):
    nodes = data.nodes(spark, sf)
    name = nodes.orderBy("seq").first()["name"]
    edges = graph.resolve_names(data.named_refs(spark, sf), nodes)
    return graph.references(edges, nodes, name).select("src", "dst", "line")


@query(f"""WITH {CALLS}, {NODES} SELECT c.src, c.dst, c.line, NULL::VARCHAR AS src_name, n.name AS dst_name, n.path AS dst_path FROM calls c LEFT JOIN nodes n ON n.id = c.dst""")
def j5_endpoints(spark, sf):
    return graph.with_endpoints(data.call_edges(spark, sf), data.nodes(spark, sf)).select("src", "dst", "line", "src_name", "dst_name", "dst_path")


@query(f"""WITH {NODES}, pos AS (SELECT DISTINCT p_brand AS path, (p_partkey * 7 % 1000)::INT AS pos FROM part)
SELECT p.path, p.pos, (SELECT n.id FROM nodes n WHERE n.path = p.path AND p.pos BETWEEN n.start_line AND n.end_line ORDER BY n.end_line - n.start_line, n.id LIMIT 1) AS inside FROM pos p
WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.path = p.path AND p.pos BETWEEN n.start_line AND n.end_line)""")
def j6_enclosing(spark, sf):
    at = data.table(spark, sf, "part").select(F.col("p_brand").alias("path"), (F.col("p_partkey") * 7 % 1000).cast("int").alias("pos")).distinct()
    defs = data.nodes(spark, sf).select("path", "id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return graph.enclosing(at, defs)


@query("""SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, 0.95::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'mod:none', 'mod:x', 1.0""")
def g12_confidence(spark, sf):
    rows = data.table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.lit("IMPORT").alias("resolution"))
    extra = spark.createDataFrame([("mod:none", "mod:x", "EXACT")], "src string, dst string, resolution string")
    refs = rows.unionByName(extra).select("src", "dst", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(1).alias("line"), F.lit("IMPORTS").alias("kind"), F.lit(False).alias("rev"), "resolution")
    none = data.nodes(spark, sf).limit(0)
    return graph.edges_view(refs, none).select("src", "dst", "confidence")


# --- workspace --------------------------------------------------------------------------------


@query(rf"""WITH {LINES}, e AS (SELECT repo, path, unnest(l) AS line, generate_subscripts(l, 1)::INT AS line_no FROM ll) SELECT repo, path, line_no, line FROM e WHERE regexp_matches(line, '[Ll]icense[,.]? ') ORDER BY repo, path, line_no LIMIT 200""")
def w1_grep(spark, sf):
    return workspace.grep(data.files(spark, sf), "[Ll]icense[,.]? ")


@query(rf"""WITH {LINES}, e AS (SELECT repo, path, unnest(l) AS line, generate_subscripts(l, 1)::INT AS line_no FROM ll WHERE path LIKE 'en/%') SELECT repo, path, line_no, line FROM e WHERE contains(line, 'MIT License.')""")
def w1_grep_literal(spark, sf):
    return workspace.grep(data.files(spark, sf), "MIT License.", literal=True, path_glob="en/*.txt", limit=None)


@query(rf"WITH {FILES} SELECT repo, path FROM files WHERE regexp_matches(path, '^(.*/)?[^/]*7\.txt$') ORDER BY repo, path LIMIT 500")
def w2_glob(spark, sf):
    return workspace.glob(data.files(spark, sf), "**/*7.txt")


@query(rf"""WITH {LINES} SELECT repo, path, least(2, greatest(len(l), 1))::INT AS start_line, (CASE WHEN len(l) = 0 THEN 0 ELSE greatest(least(5, len(l)), least(2, len(l))) END)::INT AS end_line, len(l)::INT AS total_lines,
array_to_string(l[least(2, greatest(len(l), 1)) : greatest(least(5, len(l)), least(2, len(l)))], chr(10)) AS content FROM ll""")
def w3_read_file(spark, sf):
    return workspace.read_file(data.files(spark, sf), 2, 5)


@query(f"WITH {FILES} SELECT DISTINCT repo, split_part(path, '/', 1) AS name, TRUE AS is_dir FROM files")
def w4_list_dir(spark, sf):
    return workspace.list_dir(data.files(spark, sf))


@query(f"WITH {FILES} SELECT DISTINCT repo, split_part(path, '/', 1) AS path, 1 AS depth, TRUE AS is_dir FROM files UNION ALL SELECT repo, path, 2, FALSE FROM files")
def w5_tree(spark, sf):
    return workspace.tree(data.files(spark, sf), limit=None)


@query(rf"WITH {LINES} SELECT repo, path, array_to_string(l[1:3], chr(10)) AS content FROM ll")
def w6_head(spark, sf):
    return workspace.head(data.files(spark, sf), 3)


@query(rf"WITH {LINES} SELECT repo, path, array_to_string(l[greatest(len(l) - 2, 1) : len(l)], chr(10)) AS content FROM ll")
def w6_tail(spark, sf):
    return workspace.tail(data.files(spark, sf), 3)


@query(rf"WITH {LINES} SELECT repo, path, len(l)::BIGINT AS lines, len(regexp_extract_all(text, '[^ \t\n\r\x0B\f]+'))::BIGINT AS words, strlen(text)::BIGINT AS bytes FROM ll")
def w7_wc(spark, sf):
    return workspace.wc(data.files(spark, sf))


def _all_lines(spark, sf):
    each = data.files(spark, sf).select("doc_id", F.posexplode(workspace.lines_of()).alias("pos", "line"))
    return each.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("line_no"), "line")


ALL_LINES = rf"{LINES}, e AS (SELECT f.doc_id * 100000 + generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM ll JOIN files f USING (repo, path))"


@query(f"WITH {ALL_LINES} SELECT line_no, regexp_replace(regexp_replace(line, 'the', 'THE'), '[aeiou]', '_', 'g') AS line FROM e WHERE NOT regexp_matches(line, 'xyz')")
def w8_sed(spark, sf):
    return workspace.sed(_all_lines(spark, sf), "/xyz/d; s/the/THE/; s/[aeiou]/_/g")


@query(f"WITH {ALL_LINES}, w AS (SELECT split_part(line, ' ', 1) AS w FROM e WHERE regexp_matches(line, 'er')), u AS (SELECT w, count(*) AS n FROM w GROUP BY w) SELECT row_number() OVER (ORDER BY w) AS k, n || ' ' || w AS line FROM u")
def w10_pipe(spark, sf):
    out = pipes.run_pipe(_all_lines(spark, sf), "grep er | cut -d ' ' -f 1 | sort | uniq -c | nl")
    return out.select(F.split("line", "\t")[0].cast("long").alias("k"), F.split("line", "\t")[1].alias("line"))


@query(f"WITH {FILES} SELECT DISTINCT repo FROM files")
def w11_repos(spark, sf):
    return data.files(spark, sf).select("repo").distinct()


@query("SELECT o_orderkey AS line_no, 'h' || o_orderkey AS hash, o_orderpriority AS author, '2020-01-01' AS date, 'fix ' || o_custkey AS subject FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderkey LIMIT 200")
def w12_git_log(spark, sf):
    sep = F.lit("\u001f")
    whole = F.concat(F.lit("h"), F.col("o_orderkey").cast("string"), sep, "o_orderpriority", sep, F.lit("2020-01-01"), sep, F.lit("fix "), F.col("o_custkey").cast("string"))
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("broken")).otherwise(whole)
    return workspace.git_log(data.table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("line")))


@query("""WITH p AS (SELECT p_partkey AS d, p_brand AS path, (p_size + 1)::INT AS s, (p_partkey % 4)::INT AS c FROM part) SELECT d AS diff_id, path, unnest(range(s, s + greatest(c, 1)))::INT AS line FROM p""")
def w13_diff_hunks(spark, sf):
    k = F.col("p_partkey")
    body = F.concat(F.lit("diff\n--- a/x\n+++ b/"), "p_brand", F.lit("\n@@ -1,2 +"), (F.col("p_size") + 1).cast("string"), F.lit(","), (k % 4).cast("string"), F.lit(" @@ fn\n+new\n--- a/y\n+++ /dev/null\n@@ -1 +5,2 @@"))
    return workspace.diff_hunks(data.table(spark, sf, "part").select(k.alias("diff_id"), body.alias("text")))


@query(f"""WITH RECURSIVE {RESOLVED}, hop AS (SELECT src AS a, dst AS b FROM named UNION ALL SELECT dst, src FROM named),
d AS (SELECT name, path, min(start_line) AS first FROM nodes WHERE EXISTS (SELECT 1 FROM part h WHERE h.p_partkey % 97 = 5 AND h.p_brand = path AND start_line <= h.p_partkey % 1000 AND end_line >= h.p_partkey % 1000) GROUP BY name, path ORDER BY path, first, name LIMIT 20),
w AS (SELECT id AS node, 0 AS depth FROM nodes JOIN d USING (name, path) UNION SELECT b, depth + 1 FROM w JOIN hop ON a = node WHERE depth < 2),
i AS (SELECT n.name, n.path, min(depth) AS depth FROM w JOIN nodes n ON n.id = node WHERE depth > 0 AND (n.name, n.path) NOT IN (SELECT name, path FROM d) GROUP BY 1, 2 ORDER BY 3, 2, 1 LIMIT 20)
SELECT name, path, 'direct' AS risk FROM d UNION ALL SELECT name, path, 'transitive' FROM i""")
def g22_changed_symbols(spark, sf):
    nodes = data.nodes(spark, sf)
    hunks = data.table(spark, sf, "part").filter("p_partkey % 97 = 5").select(F.col("p_brand").alias("path"), (F.col("p_partkey") % 1000).cast("int").alias("line"))
    outline = nodes.select("path", F.col("name").alias("symbol"), "start_line", "end_line")
    return graph.changed_symbols(hunks, outline, graph.resolve_names(data.named_refs(spark, sf), nodes), nodes)


# --- text and conversations -------------------------------------------------------------------


@query(r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script.*?</script>', ' ', 'gsi'), '<style.*?</style>', ' ', 'gsi'), '<head.*?</head>', ' ', 'gsi') AS h FROM pages),
a AS (SELECT page_id, h, regexp_extract(h, '<main[^>]*>(.*?)</main>', 1, 'si') AS m, list_filter(regexp_extract_all(h, '<article[^>]*>(.*?)</article>', 1, 'si'), lambda x: regexp_matches(x, '\S')) AS arts FROM n),
c AS (SELECT page_id, CASE WHEN h IS NULL THEN NULL WHEN regexp_matches(m, '\S') THEN m WHEN len(arts) > 0 THEN list_reduce(arts, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END)
  ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<nav.*?</nav>', ' ', 'gsi'), '<header.*?</header>', ' ', 'gsi'), '<footer.*?</footer>', ' ', 'gsi'), '<aside.*?</aside>', ' ', 'gsi') END AS b FROM a),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '<br\s*/?>', chr(10), 'gi'), '</(p|div|section|article|header|footer|li|ul|ol|tr|table|h[1-6]|pre|blockquote|figure|main|nav|aside)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM c),
d AS (SELECT page_id, replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS t FROM t)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\f\x0B\r]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM d""")
def t1_html_text(spark, sf):
    return data.table(spark, sf, "pages").select("page_id", pages.html_text("html").alias("text"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def t3_titles(spark, sf):
    return data.table(spark, sf, "pages").select("page_id", text.html_title("html").alias("title"))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def t1_links(spark, sf):
    return text.links(data.table(spark, sf, "pages"))


@query("SELECT conv_id, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def t4_tokens(spark, sf):
    return data.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(text.tokens("text")).alias("tokens"))


@query("""WITH s AS (SELECT conv_id, sum(ceil(length(text) / 4.0)) AS tokens, count(*) AS n FROM conversations GROUP BY conv_id), o AS (SELECT conv_id, CASE WHEN tokens > 300 AND n > 2 THEN n - 2 ELSE 0 END AS omitted FROM s),
k AS (SELECT c.*, omitted, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS rk FROM conversations c JOIN o USING (conv_id))
SELECT conv_id, turn, role, text FROM k WHERE rk > omitted UNION ALL SELECT conv_id, -1, 'user', '[' || omitted || ' earlier message(s) omitted to fit the context window]' FROM o WHERE omitted > 0""")
def t5_fit_history(spark, sf):
    return text.fit_history(data.table(spark, sf, "conversations"), 300, 2)


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t = '' THEN 'New chat' WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS title FROM c""")
def t9_titles(spark, sf):
    return data.table(spark, sf, "conversations").select("conv_id", "turn", text.title_of("text").alias("title"))


@query("SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def t10_last_user_message(spark, sf):
    return text.last_user_message(data.table(spark, sf, "conversations"))


@query("""WITH h AS (SELECT user_id AS session, event_id AS seq, event_type AS repo, event_id % 50 AS id, 'f' || (event_id % 9) AS path, (event_id % 30)::INT AS start_line FROM events),
k AS (SELECT session, min(seq) AS seq, CASE WHEN id > 0 THEN repo || ':' || id ELSE 'at:' || path || ':' || start_line END AS key, min_by(struct_pack(repo := repo, path := path, a := start_line), seq) AS h FROM h GROUP BY session, key)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq DESC)::INT AS rank, '- [' || h.repo || '] ' || h.path || ':' || h.a || '-' || (h.a + 4) AS row FROM k QUALIFY rank <= 40""")
def t7_evidence(spark, sf):
    e = F.col("event_id")
    hits = data.table(spark, sf, "events").select(F.col("user_id").alias("session"), e.alias("seq"), F.col("event_type").alias("repo"), (e % 50).alias("id"), F.concat(F.lit("f"), (e % 9).cast("string")).alias("path"), (e % 30).cast("int").alias("start_line"), (e % 30 + 4).cast("int").alias("end_line"), F.lit("").alias("symbol"))
    return text.evidence(hits)


@query("""WITH p AS (SELECT p_partkey AS id, 'x/' || p_size || '.c:3-9' AS a, 'y.c:' || p_size AS b FROM part) SELECT id, a AS source, split_part(a, ':', 1) AS path, split_part(a, ':', 2) AS lines, 1 AS ordinal FROM p UNION ALL SELECT id, b, split_part(b, ':', 1), split_part(b, ':', 2), 2 FROM p""")
def t11_citations(spark, sf):
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit("see [x/"), size, F.lit(".c:3-9] and `[z.c:1]` or [y.c:"), size, F.lit("], again [x/"), size, F.lit(".c:3-9]; [link:1](http://u)\n```\n[q.c:2]\n```"))
    return text.citations(data.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), body.alias("text")))


@query("""SELECT p_partkey, '[' || p_brand || '] ' || p_name || ':1-' || p_size || CASE WHEN p_partkey % 2 = 1 THEN ' (id=' || p_partkey % 2 || ')' ELSE '' END AS source FROM part""")
def t12_format_source(spark, sf):
    return data.table(spark, sf, "part").select("p_partkey", text.format_source(F.col("p_brand"), F.col("p_name"), F.lit(1), F.col("p_size"), F.col("p_partkey") % 2).alias("source"))


# --- watching ---------------------------------------------------------------------------------

EVENTS = "ev AS (SELECT 'r' AS repo, 'u/' || user_id AS path, CASE event_type WHEN 'click' THEN 'MODIFY' WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'RENAME' END AS kind, ts, event_id AS seq FROM events)"


@query(f"""WITH {EVENTS}, l AS (SELECT repo, path, list(kind ORDER BY ts, seq) AS kinds, max(ts) AS ts FROM ev GROUP BY repo, path)
SELECT repo, path, list_reduce(kinds, lambda a, b: CASE WHEN a = 'DELETE' AND b <> 'CREATE' THEN 'DELETE' ELSE b END) AS kind, ts FROM l""")
def k2_merged_kinds(spark, sf):
    return watch.merge_kinds(data.watch_events(spark, sf))


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, new DESC, seq ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT repo, path, min(ts) AS first, count(*) AS events FROM s GROUP BY repo, path, burst""")
def k5_bursts(spark, sf):
    return watch.bursts(data.watch_events(spark, sf), "1 hour")


@query(f"WITH {FILES}, {PREV.replace('text FROM', 'text, doc_id FROM')} SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'CREATE' WHEN b.path IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS kind FROM prev a FULL JOIN now b ON a.repo = b.repo AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.doc_id % 5 = 0")
def k4_polled_changes(spark, sf):
    prev, now = data.snapshots(spark, sf)
    return watch.snapshot_events(prev.select("repo", "path", F.lit(1).alias("mtime")), now.select("repo", "path", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("mtime")))


@query(f"WITH {EVENTS} SELECT date_trunc('hour', ts) AS hour, kind, count(*) AS events FROM ev GROUP BY 1, 2")
def k6_windowed_counts(spark, sf):
    return watch.windowed_counts(data.watch_events(spark, sf))


# --- files of code ------------------------------------------------------------------------------

from quarryline.plans import code_queries, engine_queries  # noqa: E402

for more in (code_queries, engine_queries):
    QUERIES.update(more.QUERIES)
    ORACLES.update(more.ORACLES)
