"""The registered queries of the corpus operators, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, extraction, fingerprints, langid, licenses, mixing, neardup, negatives, packing, resampling, sharding, warc
from .shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_text(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_dictionaries(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    records = warc.read_records(index, folder, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path)


#: A conversation whose texts look like the template's own marks.
PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for k, role in enumerate(("user", "assistant"))]
    probe = spark.range(1).select(F.inline(F.array(*said)))
    records = chat.records_of_rows(rows.unionByName(probe))
    written = materialize(chat.format_turns(chat.canonical_turns(records)), "chats")
    parsed = written.withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        F.col("rec_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_license_scan, op3_language_id, op4_warc, op5_minhash_near_dedup,
        op6_source_mixing, op7_exact_dedup, op8_packing, op9_chat_formatting, op10_fingerprints,
        op11_sharding, op12_hard_negatives, op13_importance_resampling,
    )
}


def _license_sql() -> str:
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quote(label)}, [{', '.join(map(quote, words))}], {size}, {least})" for i, label, words, size, least in licenses.template_rows())
    phrases = ", ".join(f"([{', '.join(map(quote, p.split()))}], {quote(label)})" for p, label in licenses.PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS t FROM documents
), words AS (
  SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM low
), phrases(p, label) AS (VALUES {phrases}),
hits AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS place
  FROM words, phrases
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id
), templates(template, label, t_words, size, least) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, FALSE AS whole, unnest(string_split(t, chr(10))) AS b FROM low
  UNION ALL
  SELECT doc_id, TRUE, unnest(regexp_split_to_array(regexp_replace(t, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '\n[ \n]*\n')) FROM low
), sets AS (
  SELECT doc_id, whole, list_distinct(regexp_extract_all(b, '{word}')) AS b_words FROM blocks
), own AS (
  SELECT doc_id, label, len(list_intersect(b_words, t_words)) / size AS containment
  FROM sets, templates
  WHERE len(b_words) >= least AND (NOT whole OR size >= {licenses.LONG_TEMPLATE}) AND len(list_intersect(b_words, t_words)) >= least
), mine AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best FROM own GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.best, 0.0)::DOUBLE END AS score
FROM words w LEFT JOIN base b USING (doc_id) LEFT JOIN mine m USING (doc_id)"""


#: The table of a byte-wise crc32, and the crc32 of a string in SQL (the polynomial is a fixed value).
CRC_TABLE = """SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"""


def _crc_sql(text: str) -> str:
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _sharding_sql() -> str:
    """The crc of a long text is put together from those of pieces of 256 bytes: `far` carries a
    crc over 256 zero bytes, `z` the crc's first value over fewer."""
    least = "list_position(loads, list_min(loads))"
    zeros = "lambda c, k: xor(c >> 8, tab[(c & 255) + 1])"
    over = "xor(xor(far[(a & 255) + 1], far[((a >> 8) & 255) + 257]), xor(far[((a >> 16) & 255) + 513], far[(a >> 24) + 769]))"
    piece = "list_transform(range(256), lambda i: ('0x' || substr(p, (2 * i + 1)::INT, 2))::BIGINT)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS sha FROM documents),
tables AS ({CRC_TABLE}),
shifts AS (
  SELECT (SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(((i % 256) << (8 * (i // 256)))::BIGINT, range(256)), {zeros}) AS c FROM range(1024) r(i), tables)) AS far,
    (SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(4294967295::BIGINT, range(i)), {zeros}) AS c FROM range(256) r(i), tables)) AS z
), g AS (SELECT sha, any_value(t) AS t, strlen(any_value(t)) AS n, sum(strlen(t) + 1)::BIGINT AS bytes FROM d GROUP BY sha),
h AS (SELECT sha, (n + 255) // 256 AS parts, lpad(hex(encode(t)), ((n + 255) // 256 * 512)::INT, '0') AS h FROM g WHERE n > 0),
pieces AS (SELECT sha, i, substr(h, (512 * i + 1)::INT, 512) AS p FROM (SELECT sha, h, unnest(range(parts)) AS i FROM h)),
lists AS (
  SELECT sha, list(c ORDER BY i) AS cs FROM (SELECT sha, i, list_reduce(list_prepend(0::BIGINT, {piece}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])) AS c FROM pieces, tables)
  GROUP BY sha
), c AS (
  SELECT g.sha, CASE WHEN n = 0 THEN 0 ELSE xor(xor(list_reduce(cs, lambda a, b: xor(b, {over})), list_reduce(list_prepend(z[n % 256 + 1], range(n // 256)), lambda a, k: {over})), 4294967295) END AS crc
  FROM shifts, g LEFT JOIN lists USING (sha)
), o AS (SELECT sha, bytes, row_number() OVER (ORDER BY bytes DESC, sha) AS k FROM g),
s AS (
  SELECT 0::BIGINT AS k, ''::VARCHAR AS sha, -1::BIGINT AS shard, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT o.k, o.sha, {least} - 1, list_transform(range(8), lambda i: loads[i + 1] + CASE WHEN i + 1 = {least} THEN o.bytes ELSE 0 END)
  FROM s JOIN o ON o.k = s.k + 1
)
SELECT d.doc_id, (strlen(d.t) + 1)::BIGINT AS size, c.crc::BIGINT AS text_crc32, 'bytes' AS law, s.shard::INT AS shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY d.doc_id NULLS FIRST, d.sha) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN s ON s.sha = d.sha JOIN c ON c.sha = d.sha"""


ORACLES = {
    "op2_license_scan": _license_sql(),
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM s""",
    "op6_source_mixing": """
WITH RECURSIVE t AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN chars > 0 THEN (sum(chars) OVER ())::DOUBLE * 1.0 / (count(*) OVER ())::DOUBLE / chars::DOUBLE ELSE 1.0 END AS rate FROM t),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
u AS (SELECT *, ('0x' || substr(md5('7:' || doc_id || ':' || md5(coalesce(text, '')) || ':0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS x FROM documents),
n AS (
  SELECT u.doc_id, any_value(s.rate) AS rate, count(*) FILTER (s.c <= u.x) AS copies
  FROM u JOIN steps s ON u.source IS NOT DISTINCT FROM s.source GROUP BY u.doc_id
),
e AS (SELECT doc_id, rate, copies, unnest(range(copies)) AS copy FROM n)
SELECT d.*, e.rate AS mix_rate, e.copies::BIGINT AS mix_copies, e.copy::BIGINT AS mix_copy,
  md5('order7:' || d.doc_id || ':' || md5(coalesce(d.text, '')) || ':' || e.copy) AS mix_key
FROM documents d JOIN e USING (doc_id)""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    "op9_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[SEP\]')) AS n,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
      ELSE 22 + length(role) + length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, '</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[SEP\]')) END AS marks
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + marks)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
    "op11_sharding": _sharding_sql(),
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.k <= 5
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_importance_resampling": rf"""
WITH tables AS ({CRC_TABLE}),
words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), buckets AS (SELECT w, {_crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), tables),
counts AS (SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT doc_id, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM ranked""",
}
