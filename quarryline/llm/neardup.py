"""Near duplicates by consistent weighted sampling.

Documents are weighted sets of five-word shingles: term frequency times inverse document
frequency. Improved consistent weighted sampling (for shingle weight w: t = floor(ln w / r + b),
ln a = ln c - r (t + 1 - b), with r, c ~ Gamma(2, 1), b ~ U(0, 1) drawn per shingle and sample)
gives samples that agree with the probability of the weighted Jaccard similarity. BANDS bands of
ROWS samples make buckets; a link is a pair whose weighted Jaccard similarity, computed in full,
is at least SIMILARITY. Classes are the connected components of the links.

A bucket's members are first compared with its most popular member, the one that shares its
buckets with the most texts: copies of one text mostly meet there. Where a bucket then still has
several components, a pair of different components is compared only if the two share a shingle
of their prefixes, the rarest part of a text's weight without which no pair reaches SIMILARITY.
That bound is exact, so no pair of a bucket is given up, and no bucket's pairs are all made.

The weight's IDF part is bounded: shingles of at most RARE of the documents weigh 1, those of
all documents FLOOR. Only the former's complement is counted, exactly and over all documents;
its size is at most the mean number of shingles a document divided by RARE, for any corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HEAVY_SHARE, heavy_values, materialize, repeated_ids, Tables, text_or_empty, unused, with_ids, without_ids
from .spans import chunks, mix, span_hashes, text_buffer, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 5
RARE, FLOOR = 0.01, 0.5
#: Shingles that a task counts before it forgets those too rare to matter.
COUNTED = 1 << 18
#: Sizes of one slice differ by this factor at most.
SLICE = 1.02
#: A table of up to so many (node, id) rows is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 500_000
SEED = 20240917


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, term frequency, number of the text) of each text's distinct shingles, sorted.

    A text of one to four words has one shingle of all of them; one without words has none.
    """
    words, at = word_hashes(data, offsets)
    n_words = np.diff(at)
    count = np.where(n_words >= SHINGLE_WORDS, n_words - SHINGLE_WORDS + 1, (n_words > 0).astype(n_words.dtype))
    total = int(count.sum())
    text = np.repeat(np.arange(len(count)), count)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    starts = np.arange(total) - begin[text] + at[:-1][text]
    ends = np.minimum(starts + SHINGLE_WORDS, at[1:][text])
    hashes = span_hashes(words, starts, ends)
    # texts are in order already: one sort by (text, hash), with the hash's upper 44 bits
    order = np.argsort((text.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    hashes, text = hashes[order], text[order]
    new = np.ones(total, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    places = np.flatnonzero(new)
    return hashes[places], np.diff(np.append(places, total)), text[places]


def idf_weights(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Weights from FLOOR (in all documents) to 1 (in RARE of them or fewer)."""
    share = np.maximum(counts, 1) / max(n_docs, 1)
    rarity = np.clip(np.log(share) / np.log(RARE), 0.0, 1.0)
    return (FLOOR + (1 - FLOOR) * rarity).astype(np.float32)


def weights_of(hashes: np.ndarray, tf: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """idf: sorted hashes of frequent shingles and their weights; all others weigh 1."""
    out = tf.astype(np.float32)
    known, weight = idf
    if len(known):
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[place] == hashes
        out[hit] *= weight[place[hit]]
    return out


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at 65536 even steps of probability: F(x) = 1 - (1 + x) exp(-x), inverted."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(p.shape, 1.5)
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
        x = (low + high) / 2
    return x.astype(np.float32)


_tables: dict[str, np.ndarray] = {}


def samples(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, n_samples: int = BANDS * ROWS) -> np.ndarray:
    """The sampled values, one row per text (begin: where each text's shingles start; none empty).

    Two texts have equal values where they sampled the same shingle at the same t.
    """
    if not _tables:
        r = _gamma_quantiles()
        _tables.update(r=r, per_r=1 / r, c=np.log(r))
    keys = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, (n_samples, 2), dtype=np.uint64) | np.uint64(1)
    ln_w = np.log(weights).astype(np.float32)
    out = np.empty((len(begin), n_samples), np.float32)
    step = np.float32(1 / 65536)
    for k, (factor, shift) in enumerate(keys):
        u = (hashes ^ shift) * factor
        u ^= u >> np.uint64(32)
        parts = u.view(np.uint16).reshape(-1, 4)
        r_at = parts[:, 1]
        b = parts[:, 0] * step
        t = _tables["per_r"].take(r_at)
        t *= ln_w
        t += b
        np.floor(t, out=t)
        t += np.float32(1)
        t -= b
        t *= _tables["r"].take(r_at)
        np.subtract(_tables["c"].take(parts[:, 2]), t, out=t)
        out[:, k] = np.minimum.reduceat(t, begin)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per text and band; keys of different bands differ."""
    bits = values.view(np.uint32).astype(np.uint64).reshape(len(values), BANDS, -1)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        key = mix(key ^ bits[:, :, j]) + np.uint64(j)
    return key.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two (sorted hashes, weights)."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if not total:
        return 1.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    place = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    hit = b[0][place] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = float(np.minimum(a[1][hit], b[1][place[hit]]).sum(dtype=np.float64))
    return common / (total - common)


class FrequentShingles:
    """Lossy counting: after any number of documents it holds every shingle that is in more
    than `share` of them, with a count that is at most that share too low."""

    def __init__(self, share: float, room: int = COUNTED):
        self.share, self.room, self.docs = share, room, 0
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting, self.missed = 0, 0

    def add(self, hashes: np.ndarray, docs: int) -> None:
        self.waiting.append(hashes)
        self.n_waiting += len(hashes)
        self.docs += docs
        if self.n_waiting >= self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, count) of what is held. missed: what a shingle that comes anew may have lost."""
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        hashes, counts, lost = (np.concatenate(x) for x in zip(self.known, (new, n, np.full(len(new), self.missed)), strict=True))
        if len(hashes):
            order = np.argsort(hashes, kind="stable")
            begin = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[0]] + np.uint64(1)))
            hashes, counts, lost = hashes[order[begin]], np.add.reduceat(counts[order], begin), np.minimum.reduceat(lost[order], begin)
        self.missed = math.floor(self.share * self.docs)
        keep = counts + lost > self.missed
        self.known = hashes[keep], counts[keep], lost[keep]
        return self.known[:2]


def _of_each_chunk(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(column))
        for first, last in chunks(offsets):
            yield batch, first, last, *shingles(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of over RARE / 2 of a task's documents, with a lower bound of their number there;
    the number of documents in a row without a shingle."""
    held = FrequentShingles(RARE / 2)
    for _, first, last, hashes, _, _ in _of_each_chunk(batches, 0):
        held.add(hashes, last - first)
    hashes, counts = held.settle()
    found = pa.array(hashes.view(np.int64)), pa.array(counts)
    yield pa.RecordBatch.from_arrays([pa.concat_arrays([found[0], pa.array([None], pa.int64())]), pa.concat_arrays([found[1], pa.array([held.docs], pa.int64())])], ["shingle", "n"])


def _count(wanted):
    """Documents that hold each of the wanted shingles (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        counts = np.zeros(len(known), np.int64)
        for _, _, _, hashes, _, _ in _of_each_chunk(batches, 0):
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            counts += np.bincount(place[known[place] == hashes], minlength=len(known))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known[used].view(np.int64)), pa.array(counts[used])], ["shingle", "n"])

    return run


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are in over RARE of all rows, and their IDF weights.

    A shingle in over RARE of all rows is in over RARE / 2 of a task's rows so often that the
    tasks' lower bounds add up to over RARE / 2 of all; at most the mean number of shingles a
    row times 2 / RARE can. These are counted exactly by a second pass.
    """
    sc = texts.sparkSession.sparkContext
    kind = "shingle long, n long"
    found = texts.mapInArrow(_candidates, kind).groupBy("shingle").agg(F.sum("n").alias("n"))
    with Tables(texts.sparkSession) as tables:
        found = tables.save(found, "frequent")
        n_docs = int((found.filter("shingle IS NULL").agg(F.sum("n")).first()[0]) or 0)
        rows = found.filter(F.col("shingle").isNotNull() & (F.col("n") >= math.floor(RARE / 2 * n_docs))).select("shingle").toPandas()
        known = np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))
        if not len(known):
            return known, np.zeros(0, np.float32)
        wanted = sc.broadcast(known)
        rows = texts.mapInArrow(_count(wanted), kind).groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
        wanted.destroy()
    hashes, counts = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    often = counts > RARE * n_docs
    order = np.argsort(hashes[often])
    return hashes[often][order], idf_weights(counts[often][order], n_docs)


def _sign(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch, first, last, hashes, tf, text in _of_each_chunk(batches, 2):
            n = last - first
            keys: list = [None] * n
            size = np.zeros(n)
            if len(hashes):
                weights = weights_of(hashes, tf, table)
                begin = np.flatnonzero(np.diff(text, prepend=-1))
                found = band_keys(samples(hashes, weights, begin))
                size[text[begin]] = np.add.reduceat(weights.astype(np.float64), begin)
                for i, row in zip(text[begin].tolist(), found, strict=True):
                    keys[i] = row
            part = batch.slice(first, n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(size)], ["doc_id", "node", "bands", "weight"])

    return run


def _describe(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch, first, last, hashes, tf, text in _of_each_chunk(batches, 1):
            weights = weights_of(hashes, tf, table)
            at = np.searchsorted(text, np.arange(last - first + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (hashes.view(np.int64), weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], ["node", "hashes", "weights"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *lists = batch.columns
            held = []
            for x in lists:
                at = x.offsets.to_numpy()
                held.append((at - at[0], x.flatten().to_numpy(zero_copy_only=False)))
            keep, values = [], []
            for i in range(batch.num_rows):
                ha, wa, hb, wb = (v[at[i] : at[i + 1]] for at, v in held)
                s = weighted_jaccard((ha.view(np.uint64), wa), (hb.view(np.uint64), wb))
                if s >= similarity:
                    keep.append(i)
                    values.append(s)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge (a, b): the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so long chains shrink fast. Rounds end in a table, which cuts lineage; a round's
    table goes when the next one stands.
    """
    tables = Tables(edges.sparkSession)
    both = tables.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    last = labels = tables.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = step.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = tables.save(step.join(up, F.col("label") == F.col("up")).select("node", "old", F.least("label", "up_label").alias("label")), "labels")
        tables.drop(last)
        if new.filter(F.col("old") != F.col("label")).isEmpty():
            tables.drop(both)
            return new.select("node", "label")
        last, labels = new, new.select("node", "label")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of all components once links (a, b) are added: only links between different
    components take part, each component as one node."""
    ends = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    joined = components(ends)
    old = labels.join(joined.toDF("label", "new"), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    # a node that had no link yet is its own component
    return old.unionByName(joined.join(labels.select("node"), "node", "left_anti"))


def node_of(text: str | Column) -> Column:
    return F.unhex(F.substring(F.sha2(text_or_empty(text), 256), 1, 32))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept, node: one row per row of docs.

    class_id is the smallest doc_id of the class (null only if it has no other); kept is true
    on that document (rows that repeat it too). Null text counts as empty. Equal texts are one
    node of the graph, whatever their number; texts without words link to equal texts only.
    node is a hash of the text.
    """
    return _labelled(docs, similarity).drop("label")


def _labelled(docs: DataFrame, similarity: float) -> DataFrame:
    """near_duplicates() with the label of the class, which no other class has."""
    spark = docs.sparkSession
    tables = Tables(spark)
    source = docs.select("doc_id", node_of("text").alias("node"), text_or_empty("text").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(source.select("text")))
    keys = tables.save(source.select("doc_id", "node"), "nodes")
    # of a text that makes up much of the corpus, copies are dropped where they are read
    heavy = keys.join(F.broadcast(heavy_values(keys, "node", HEAVY_SHARE)), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    heavy = tables.save(heavy.filter("n > 1").select(F.col("node").alias("hot"), "first"), "hot-texts")
    once = source.join(F.broadcast(heavy), F.col("node") == F.col("hot"), "left").filter("hot IS NULL OR doc_id <=> first").select("doc_id", "node", "text")

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = once.mapInArrow(_sign(frequent), f"doc_id {kind}, node binary, bands array<long>, weight double")
    nodes = tables.save(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("weight").alias("weight")), "signed")
    members = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = tables.save(members.join(sizes, "bucket"), "shared-buckets")

    # what is compared in full, read once: texts that share a bucket with another
    wanted = tables.save(members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("first")), "node"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = once.withColumnRenamed("node", "own").join(few, (F.col("own") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")
    features = tables.save(texts.mapInArrow(_describe(frequent), "node binary, hashes array<long>, weights array<float>").dropDuplicates(["node"]), "features")

    reps = tables.save(_most_popular(members), "most-popular")
    pairs = tables.save(_with_most_popular(members, reps, similarity), "pairs")
    links = tables.save(_links(pairs, features, similarity), "links")
    labels = components(links)
    open_ = tables.save(_open_members(members, reps, labels), "open")
    pairs = tables.save(_by_prefixes(open_, features, similarity), "more-pairs")
    links = tables.save(_links(pairs, features, similarity), "more-links")
    labels = tables.save(merged_labels(labels, links), "all-labels")
    tables.drop_but(keys, labels, heavy)
    return _classes(keys, labels, heavy)


def _most_popular(members: DataFrame) -> DataFrame:
    """(bucket, rep, rep_weight): of each bucket the member whose buckets hold the most texts."""
    popular = members.groupBy("node").agg(F.sum("n").alias("met"))
    best = F.max(F.struct("met", "node", "weight")).alias("best")
    return members.join(popular, "node").groupBy("bucket").agg(best).select("bucket", F.col("best.node").alias("rep"), F.col("best.weight").alias("rep_weight"))


def _with_most_popular(members: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of every bucket's members with its most popular one."""
    near = F.least("weight", "rep_weight") >= F.lit(similarity * 0.999) * F.greatest("weight", "rep_weight")
    pairs = members.join(reps, "bucket").filter((F.col("node") != F.col("rep")) & near)
    return pairs.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()


def _links(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    of = lambda name: features.select(F.col("node").alias(name), F.col("hashes").alias(f"h{name}"), F.col("weights").alias(f"w{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ha", "wa", "hb", "wb")
    return both.mapInArrow(_verify(similarity), "a binary, b binary, similarity double")


def _open_members(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, weight, rest) of texts in buckets that hold several labels, not counting the
    most popular text, which all have been compared with. A pair of different labels has one text
    that isn't of its bucket's most frequent label: rest."""
    others = members.join(reps.select("bucket", F.col("rep").alias("node")), ["bucket", "node"], "left_anti")
    own = others.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    common = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    common = common.agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("bucket", F.col("top.label").alias("most"))
    open_ = own.join(common, "bucket")
    return open_.groupBy("node").agg(F.first("label").alias("label"), F.first("weight").alias("weight"), F.max(F.col("label") != F.col("most")).alias("rest"))


def _by_prefixes(open_: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different labels, one of them rest, that may reach the similarity.

    A text's shingles stand in order of their number of texts, rarest first; left is a
    shingle's weight and that of those behind it which are shared at all. Two texts of weights
    s <= t overlap by `need` = similarity / (1 + similarity) (s + t) or fall short, so the
    first shingle that both have has at least that left in either. The smaller text is met at
    shingles with twice its own share left, by slice of weight; the larger looks in the slices
    from similarity times its weight up to its own, at shingles that reach the slice's need.
    """
    share = similarity * 0.999 / (1 + similarity * 0.999)
    tokens = features.join(open_.select("node"), "node").select("node", F.explode(F.arrays_zip("hashes", "weights")).alias("t"))
    tokens = tokens.select("node", F.col("t.hashes").alias("shingle"), F.col("t.weights").cast("double").alias("w"))
    common = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    behind = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tokens.join(common, "shingle").withColumn("left", F.sum("w").over(behind)).join(open_, "node")
    placed = placed.filter(F.col("left") >= similarity * 0.999 * F.col("weight"))
    slice_of = lambda w: F.floor(F.log(w) / math.log(SLICE)).cast("int")
    small = placed.filter(F.col("left") >= 2 * share * F.col("weight"))
    small = small.select("shingle", slice_of(F.col("weight")).alias("slice"), F.col("node").alias("s"), F.col("weight").alias("s_weight"), F.col("left").alias("s_left"), F.col("label").alias("s_label"), F.col("rest").alias("s_rest"))
    # the slice's least weight plus its own, times share, is at most what is left
    top = F.least(slice_of(F.col("weight")), slice_of(F.col("left") / share - F.col("weight")))
    slices = F.sequence(slice_of(similarity * 0.999 * F.col("weight")), top)
    large = placed.withColumn("top", top).filter(F.col("top") >= slice_of(similarity * 0.999 * F.col("weight")))
    large = large.select("shingle", F.explode(slices).alias("slice"), F.col("node").alias("t"), F.col("weight").alias("t_weight"), F.col("left").alias("t_left"), F.col("label").alias("t_label"), F.col("rest").alias("t_rest"))
    need = share * (F.col("s_weight") + F.col("t_weight"))
    ordered = F.struct("s_weight", "s") < F.struct("t_weight", "t")
    may = ordered & (F.col("s_label") != F.col("t_label")) & (F.col("s_left") >= need) & (F.col("t_left") >= need)
    found = None
    for few, many in ((small.filter("s_rest"), large), (small.filter("NOT s_rest"), large.filter("t_rest"))):
        part = few.alias("x").join(many.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.slice") == F.col("y.slice")) & may).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _classes(keys: DataFrame, labels: DataFrame, heavy: DataFrame) -> DataFrame:
    """The class of every row. heavy: texts of many rows (at most 1 / HEAVY_SHARE), whose classes
    are broadcast."""
    copies = keys.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    labelled = copies.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialize(labelled, "labelled")
    classes = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    table = labelled.join(classes, "label").select("node", "label", "class_id", "class_size")
    table = materialize(table, "classes")
    hot = F.broadcast(heavy.select(F.col("hot").alias("node")))
    out = keys.join(F.broadcast(table.join(hot, "node", "left_semi")), "node")
    out = out.unionByName(keys.join(hot, "node", "left_anti").join(table, "node"))
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "node", "label")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay, one of each class, with all their columns: that with the smallest
    doc_id (none: last), then the smallest node. Of rows that repeat both, one stays.

    Rows are told apart by their id; only those whose id repeats meet their texts again.
    """
    found = materialize(_labelled(docs, similarity).select("doc_id", "node", "label", "kept"), "near")
    repeated = repeated_ids(found)
    if repeated is None:
        return without_ids(docs, found.filter("NOT kept").select("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node")))
    keep = found.groupBy("label").agg(first.alias("first")).select(F.col("first.id").alias("doc_id"), F.col("first.node").alias("node"))
    keep = with_ids(keep, repeated)
    return without_ids(docs, found.filter("NOT kept").select("doc_id").unionByName(repeated)).unionByName(_with_repeated_ids(with_ids(docs, repeated), keep))


def _with_repeated_ids(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """An id doesn't tell rows apart, an id and a text do. Copies of a row go first, where
    they are read, so that no id and text fills a task."""
    node, key, key_node = unused(docs, "node", "key", "key_node")
    once = docs.withColumn(node, node_of("text")).dropDuplicates(["doc_id", node])
    keep = keep.toDF(key, key_node)
    return once.join(keep, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(node) == F.col(key_node)), "left_semi").select(*docs.columns)
