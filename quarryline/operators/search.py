"""Search over chunks: filters, snippets, hybrid reranking, outline and symbol lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import pathname_glob
from quarryline.schemas import BODY_BYTES, SNIPPET_BYTES, kind_code

#: Words that say nothing about a hit (fixed values).
STOP_WORDS = "the a an is are was where how what which does do in of to for and or with from by on at".split()
#: Score that each term found adds (fixed value).
TERM_BOOST = 0.05
DEFAULT_K, MAX_K = 10, 64
OUTLINE_LIMIT = 256


def clamp_k(k: int | None) -> int:
    return min(k or DEFAULT_K, MAX_K)


def significant_terms(query: str | Column) -> Column:
    """Lower-case words of a query, without punctuation around, of 3 bytes or more, no stop words."""
    words = F.split(F.lower(F.col(query) if isinstance(query, str) else query), r"\s+")
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\[\]{}]+|[.,;:!?\"'()\[\]{}]+$", ""))
    return F.filter(trimmed, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP_WORDS))


def snippet(body: str | Column = "body") -> Column:
    """The first SNIPPET_BYTES bytes, without a broken character at the end."""
    b = F.col(body) if isinstance(body, str) else body
    head = F.make_valid_utf8(F.substring(F.encode(b, "UTF-8"), 1, SNIPPET_BYTES).cast("string"))
    return F.when(F.octet_length(b) <= SNIPPET_BYTES, b).otherwise(F.regexp_replace(head, "�+$", ""))


def chunk_filter(chunks: DataFrame, repo: str | None = None, kind: str | None = None, path_glob: str | None = None, min_score: float | None = None) -> DataFrame:
    """Filters before ranking; an unknown kind is an error."""
    if repo:
        chunks = chunks.filter(F.col("repo") == repo)
    if (code := kind_code(kind)) is not None:
        chunks = chunks.filter(F.col("kind") == code)
    if path_glob:
        chunks = chunks.filter(F.col("path").rlike(pathname_glob(path_glob)))
    if min_score and min_score > 0:
        chunks = chunks.filter(F.col("score") >= min_score)
    return chunks


def hybrid(candidates: DataFrame, terms: Column, k: int = 8, order_id: str = "id") -> DataFrame:
    """Reranks candidates(score, symbol, snippet, text): each term of the query found in symbol or
    snippet adds TERM_BOOST; where none is, terms found in the whole file count."""
    near = F.lower(F.concat_ws("\n", F.coalesce("symbol", F.lit("")), F.coalesce("snippet", F.lit(""))))
    hits = lambda hay: F.size(F.filter(terms, lambda t: F.contains(hay, t)))
    first = hits(near)
    boost = F.when(first > 0, first).otherwise(hits(F.lower(F.coalesce("text", F.lit("")))))
    scored = candidates.withColumn("boost", boost).withColumn("final_score", F.round(F.col("score") + F.col("boost") * TERM_BOOST, 6))
    return scored.orderBy(F.desc("final_score"), order_id).limit(k)


def file_outline(chunks: DataFrame, repo: str, path: str, limit: int = OUTLINE_LIMIT) -> DataFrame:
    return chunks.filter((F.col("repo") == repo) & (F.col("path") == path)).orderBy("start_line", "key").limit(limit)


def find_symbol(chunks: DataFrame, name: str, kind: str | None = None, repo: str | None = None, limit: int | None = None, column: str = "symbol") -> DataFrame:
    """Chunks whose symbol contains the name in any case, in table order, score 1."""
    found = chunk_filter(chunks, repo, kind).filter(F.contains(F.lower(column), F.lit(name.lower())))
    return found.withColumn("score", F.lit(1.0)).orderBy("repo", "id").limit(clamp_k(limit or 20))


def get_chunk(chunks: DataFrame, repo: str, chunk_id: int) -> DataFrame:
    """The chunk with its body, of which at most BODY_BYTES bytes, and whether it was cut."""
    size = F.octet_length("body")
    cut = F.make_valid_utf8(F.substring(F.encode("body", "UTF-8"), 1, BODY_BYTES).cast("string"))
    return chunks.filter((F.col("repo") == repo) & (F.col("id") == chunk_id)).withColumn("truncated", size > BODY_BYTES).withColumn("body", F.when(size > BODY_BYTES, F.regexp_replace(cut, "�+$", "")).otherwise(F.col("body")))
