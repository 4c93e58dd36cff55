"""Harmonic packing of token sequences.

A piece of length n belongs to the class of the largest k with n <= capacity / k; a bin of
class k takes exactly k pieces. So a bin is full by counting: every task fills its own bins,
keeps at most k - 1 open pieces per class, and no rows are shuffled.

Documents are cut so that classes fit: whole sequences first, then pieces of half, a quarter,
... down to SMALLEST tokens (classes of 1/2, 1/4, ... that fill a bin without a gap); a rest
below SMALLEST is one piece in its reciprocal class. Bins of a task that stay open at its end
are taken apart: small rests are cut to powers of two, and equal powers are joined to
sequences whose length is a power of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import bytes_hashes, chunks, differing, text_buffer

CAPACITY = 1024
SMALLEST = 64
END_ID = 0
#: Bytes of text encoded at once.
WORK_BYTES = 1 << 20
#: Bound of the per-worker cache of word ids.
CACHE_WORDS = 250_000

PIECE_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OWN = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class WordIds:
    """Token ids of words, found for many words at once.

    A text is parted at single spaces and line ends, each space going with the word behind it.
    A byte-level pattern takes at most one space before a run of letters, digits or signs, and
    no match goes on over a space behind such a run, so the words' ids, joined, are the text's.
    A text with other white space, or two such characters together, goes to the tokenizer whole.

    Words are found by a 64-bit hash; each distinct word is encoded once and kept, with its bytes, in
    sorted arrays of at most CACHE_WORDS words. Every word is compared with the bytes kept for its
    hash: a text with a word that has another's hash goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        back = {c: b for b, c in _byte_alphabet().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token) if all(c in back for c in token) else len(token.encode())
        self.fast = _rank_encoder(json.loads(self.tokenizer.to_str()), back)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.bytes, self.begin, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    hashes = staticmethod(bytes_hashes)

    def _tokens(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts without special tokens' strings."""
        if self.fast is not None:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in some order, where each word's begin, and how many it has.

        Words with a space before go to the encoder joined by the thousand; the bytes that a
        token stands for tell to which word it belongs. Other words are encoded alone.
        """
        size = np.array([len(w) for w in words], np.int64)
        glued = np.array([w[:1] == b" " for w in words], bool)
        order = np.concatenate([np.flatnonzero(glued), np.flatnonzero(~glued)])
        together = order[: int(glued.sum())]
        texts = [b"".join(words[i] for i in together[k : k + 2000]).decode() for k in range(0, len(together), 2000)]
        texts += [words[i].decode() for i in order[len(together) :]]
        ids = np.array([i for own in self._tokens(texts) for i in own], np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[order]), side="left") + 1
        begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], count[order] = np.append(0, ends[:-1]), np.diff(ends, prepend=0)
        return ids, begin, count

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, at, n = self._encode(words)
        all_keys = np.concatenate([self.keys, keys])
        all_ids = np.concatenate([self.ids, ids])
        begin = np.concatenate([self.at[:-1], at + len(self.ids)])
        count = np.concatenate([np.diff(self.at), n])
        order = np.argsort(all_keys)
        size = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([self.begin, len(self.bytes) + np.cumsum(size) - size])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.keys, self.ids = all_keys[order], _gather(all_ids, begin[order], count[order])
        self.at = np.concatenate([[0], np.cumsum(count[order])])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin."""
        n = len(offsets) - 1
        kind = _SPACE_KIND[data]
        blank = kind == 1
        odd = kind >= 2
        odd[1:] |= blank[1:] & blank[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        odd[edges] |= blank[edges]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        odd[last] |= blank[last]
        odd[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)  # "<|" begins special tokens
        whole = np.zeros(n, bool)
        whole[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        begins = blank.copy()
        begins[1:] |= data[:-1] == 10
        begins[edges] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        plain = ~whole[text_of]
        starts, ends, text_of = starts[plain], ends[plain], text_of[plain]
        hashes = self.hashes(data, starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            raw = data.tobytes()
            if len(self.keys) + int(new.sum()) > CACHE_WORDS:
                self._clear()
                new = np.ones(len(keys), bool)
            self._learn(keys[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        place = np.searchsorted(self.keys, keys)[inverse]
        other = self.size[place] != ends - starts
        same = np.flatnonzero(~other)
        other[same] = differing(data, starts[same], self.bytes, self.begin[place[same]], self.size[place[same]])
        if other.any():
            whole[text_of[other]] = True
            plain = ~whole[text_of]
            place, text_of = place[plain], text_of[plain]
        begin, count = self.at[place], self.at[place + 1] - self.at[place]
        ids = _gather(self.ids, begin, count)
        per_text = np.bincount(text_of, weights=count, minlength=n).astype(np.int64)
        if not whole.any():
            return ids, np.concatenate([[0], np.cumsum(per_text)])
        at = np.concatenate([[0], np.cumsum(per_text)])
        parts = [ids[at[i] : at[i + 1]] for i in range(n)]
        for i in np.flatnonzero(whole):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
            parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _rank_encoder(model: dict, back: dict[str, int]):
    """The same byte-level BPE in a library that is faster on single words, or None.

    It merges by the rank of the result; that equals merging by the order of the merges where
    every merge makes the next id, and where the text is parted by the same pattern.
    """
    import tiktoken

    bpe, parts = model["model"], model.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in bpe.get("merges", [])]
    vocabulary = bpe.get("vocab", {})
    special = {t["content"] for t in model.get("added_tokens", [])}
    first = len(back)
    alike = (
        bpe.get("type") == "BPE" and parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
        and model.get("normalizer") is None and not bpe.get("dropout") and not bpe.get("ignore_merges")
        and all(vocabulary.get(c, first) < first for c in back) and all(vocabulary.get(a + b) == first + k for k, (a, b) in enumerate(merges))
    )
    if not alike:
        return None
    ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("same", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[begin : begin + count] of all spans, joined."""
    total = int(count.sum())
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if total else np.zeros(0, np.int64)
    return values[shift + np.arange(total)]


def _byte_alphabet() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself where it is
    printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


def _space_kinds() -> np.ndarray:
    """1: space and line end; 2: other white space, bytes that may begin it, and '<|'."""
    kind = np.zeros(256, np.uint8)
    kind[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = 2
    kind[[32, 10]] = 1
    return kind


_SPACE_KIND = _space_kinds()


#: The byte-level pattern of public BPE vocabularies (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def word_ids(path: str | Callable[[], str]) -> WordIds:
    return WordIds(path() if callable(path) else path)


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of a document's pieces: whole sequences, powers of two, and one small rest."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """The open bins of one task; add() and close() yield (sequence, pieces)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, length: int) -> list[tuple] | None:
        k = self.capacity // length
        bin_ = self.open.setdefault(k, [])
        bin_.append((piece, length))
        return self.open.pop(k) if len(bin_) == k else None

    def close(self, split) -> Iterator[list[tuple]]:
        """Sequences without padding from what is left; split(piece, at) cuts a piece in two."""
        left = [x for k in sorted(self.open) for x in self.open.pop(k)]
        powers: dict[int, list[tuple]] = {}
        for piece, length in left:
            while length:
                size = 1 << (length.bit_length() - 1)
                head, piece = split(piece, size) if size < length else (piece, None)
                powers.setdefault(size, []).append(head)
                length -= size
        for size, pieces in sorted(powers.items(), reverse=True):
            at = 0
            while at < len(pieces):
                n = min(1 << ((len(pieces) - at).bit_length() - 1), self.capacity // size)
                yield [(p, size) for p in pieces[at : at + n]]
                at += n


def pack_partition(tokenizer_path: str | Callable[[], str], capacity: int = CAPACITY, smallest: int = SMALLEST):
    """A function from batches (*key, text) to batches (*key, *PIECE_FIELDS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bins = word_ids(tokenizer_path), Bins(capacity)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        names = types = None

        def rows_of(sequence: int, pieces: list[tuple]) -> list[tuple]:
            out, offset = [], 0
            for (key, start, ids, total), length in pieces:
                out.append((key, start, length, zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += length
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            key_columns = [pa.array([k[i] for k in columns[0]], t) for i, t in enumerate(types)]
            own = [pa.array(c, t) for c, (_, t) in zip(columns[1:], _OWN, strict=True)]
            return pa.RecordBatch.from_arrays([*key_columns, *own], [*names, *(n for n, _ in _OWN)])

        for batch in batches:
            names, types = batch.schema.names[:-1], [batch.schema.types[i] for i in range(batch.num_columns - 1)]
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            for first, last in chunks(offsets, WORK_BYTES):
                part = batch.slice(first, last - first)
                keys = list(zip(*[c.to_pylist() for c in part.columns[:-1]], strict=True))
                ids, at = encoder.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                rows: list[tuple] = []
                for i, key in enumerate(keys):
                    own = np.append(ids[at[i] : at[i + 1]], END_ID).astype("<u4")
                    start = 0
                    for length in cut(len(own), capacity, smallest):
                        piece = (key, start, own[start : start + length], len(own))
                        start += length
                        if length == capacity:
                            full = [(piece, length)]
                        else:
                            piece = (key, piece[1], piece[2].copy(), piece[3])
                            full = bins.add(piece, length)
                        if full:
                            rows += rows_of(sequence, full)
                            sequence += 1
                yield batch_of(rows)

        def split(piece: tuple, at: int) -> tuple[tuple, tuple]:
            key, start, ids, total = piece
            return (key, start, ids[:at], total), (key, start + at, ids[at:], total)

        if names is not None:
            rows = []
            for pieces in bins.close(split):
                rows += rows_of(sequence, pieces)
                sequence += 1
            yield batch_of(rows)

    return run


def pack(docs: DataFrame, tokenizer_path: str | Callable[[], str], capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """A row per piece: doc_id and PIECE_FIELDS. tokenizer_path is the same on every executor, or
    a function that gives an executor its path.

    Null text counts as empty and still has the end id. Rows that repeat a doc_id are packed
    each for itself. sequence_id holds the task's number and a count within it. Only doc_id
    and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pack_partition(tokenizer_path, capacity, smallest), f"doc_id {kind}, {PIECE_FIELDS}")


def unpack(pieces: DataFrame) -> DataFrame:
    """doc_id, doc_tokens, pieces and covered tokens per packed document, to check a packing."""
    from pyspark.sql import functions as F

    return pieces.groupBy("doc_id", "doc_tokens").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("tokens"))
