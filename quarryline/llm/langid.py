"""Language ID by compression.

Every language has a raw-content zstandard dictionary: training texts of that language. A text is
reduced to its letters in lower case, with one space for all between words, and compressed with each
dictionary in pieces of PIECE_CHARS characters, each REPEATS times over: what is repeated costs
next to nothing, while a short piece on its own may not be worth compressing at all, and would have
the same size in every language. The dictionary that gives the fewest bytes is the prediction. A
narrow margin over the second best, a tie above all, means that no dictionary knows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty, unused

#: Bound of the training sample: pieces of each language, drawn from all pieces of its texts. What
#: is fitted is at most SAMPLE_PIECES * PIECE_CHARS characters a language, whatever the corpus.
SAMPLE_PIECES = 192
#: Characters compressed at once: within a piece, a text's own repetitions help every language.
PIECE_CHARS = 2000
REPEATS = 4
#: A prediction is rejected if the difference of the two smallest sizes is below this share of the
#: second smallest.
MIN_MARGIN = 0.004

UNDETERMINED = "und"
FOLDS, HELD_OUT = 5, 0
SCHEMA = "lang_pred string, score double, margin double, rejected boolean"


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod FOLDS; a null id counts as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % FOLDS


def letters(text: str | Column = "text") -> Column:
    """The words of a text in lower case, a space before, between and behind them; a text without a
    letter gives one space."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def fit_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Training texts per language, the most frequent language first, from documents outside the
    held-out fold with a non-null lang: of each language the at most SAMPLE_PIECES different pieces
    with the smallest hash of id, text and place. Every piece of every text can be drawn."""
    train = docs.filter((fold() != HELD_OUT) & F.col("lang").isNotNull()).select("lang", "doc_id", text_or_empty("text").alias("text"))
    # a row per language
    counts = train.filter(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.ceil(F.length("text") / PIECE_CHARS)).alias("pieces")).collect()
    counts.sort(key=lambda r: (-r["rows"], r["lang"]))
    if not counts:
        return {}
    place = F.explode(F.sequence(F.lit(0), F.floor((F.length("letters") - 1) / PIECE_CHARS)))
    pieces = train.select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), letters().alias("letters")).select("*", F.xxhash64("letters").alias("digest"), place.alias("place"))
    draw = F.pmod(F.xxhash64("id", "digest", "place", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    pieces = pieces.select("lang", draw.alias("draw"), F.substring(F.col("letters"), F.col("place") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece")).filter("trim(piece) <> ''")
    # the hash keeps about twice the pieces wanted: little is moved
    pairs = [x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * SAMPLE_PIECES / r["pieces"])))]
    best = Window.partitionBy("lang").orderBy("draw", "piece")
    picked = pieces.filter(F.col("draw") < F.create_map(*pairs)[F.col("lang")]).distinct().withColumn("k", F.row_number().over(best)).filter(F.col("k") <= SAMPLE_PIECES)
    texts: dict[str, list] = {r["lang"]: [] for r in counts}
    for r in picked.collect():
        texts[r["lang"]].append((r["draw"], r["piece"]))
    left = [lang for lang, own in texts.items() if not own]
    if left:  # rows that all repeat one text are drawn together or not at all
        for r in pieces.filter(F.col("lang").isin(left)).groupBy("lang").agg(F.min(F.struct("draw", "piece")).alias("first")).collect():
            texts[r["lang"]].append(tuple(r["first"]))
    return {lang: "".join(dict.fromkeys(t for _, t in sorted(own))).encode("utf-8", "replace") for lang, own in texts.items() if own}


def pieces(text: str) -> list[bytes]:
    """The pieces of what letters() gives, repeated."""
    return [text[i : i + PIECE_CHARS].encode("utf-8", "replace") * REPEATS for i in range(0, len(text), PIECE_CHARS)]


def coder(data: bytes):
    """A compressor with a dictionary (empty: none); greedy search with short matches tells languages best.
    Its tables and window grow with the dictionary."""
    import zstandard

    log = min(max(17, len(data).bit_length() - 1), 24)
    options = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "search_log": 4, "hash_log": log, "chain_log": log, "window_log": log + 2}
    params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **options)
    if not data:
        return zstandard.ZstdCompressor(compression_params=params)
    table = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    table.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=table, compression_params=params)


OUTPUTS = ("lang_pred", "score", "margin", "rejected")


def classify(dictionaries: dict[str, bytes], names=OUTPUTS):
    """A function from batches (…, letters) to batches (…, and what SCHEMA lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [(lang, coder(data)) for lang, data in dictionaries.items()]
        if len(coders) == 1:  # one language is told from none
            coders.append((UNDETERMINED, coder(b"")))
        for batch in batches:
            out = [_one(text, coders) for text in batch.column(batch.num_columns - 1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *names])

    return run


def _one(text: str, coders) -> tuple[str, float, float, bool]:
    if not coders or text.isspace():
        return UNDETERMINED, 0.0, 0.0, True
    parts = pieces(text)
    sizes = sorted((sum(len(c.compress(p)) for p in parts), k) for k, (_, c) in enumerate(coders))
    (best, k), (second, _) = sizes[:2]
    margin = (second - best) / second
    return coders[k][0], 1 - (1 - margin) ** 8, margin, margin < MIN_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected per row of docs.

    Only text is compressed; lang, source and doc_id are no inputs. Null texts and texts
    without a letter are `und` with score 0, rejected. Of a tie the language with more training
    rows is named, and it is rejected. Where one language is learned, it is told from none. Without training texts all rows are `und`.
    """
    rows = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), letters().alias("letters"))
    schema = rows.select("doc_id", "held_out").schema
    return rows.mapInArrow(classify(dictionaries), f"doc_id {schema['doc_id'].dataType.simpleString()}, held_out boolean, {SCHEMA}")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    text, *own = unused(docs, "text_again", "lang_pred", "score", "margin", "rejected")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    found = [f"`{n}` {t}" for n, t in zip(own, ("string", "double", "double", "boolean"), strict=True)]
    marked = docs.withColumn(text, letters()).mapInArrow(classify(dictionaries, own), ", ".join([*types, *found]))
    return marked.filter(~F.col(own[-1])).select(*docs.columns)
