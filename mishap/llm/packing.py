"""Packing of tokenized documents into sequences of bounded length: large items matched, small ones best-fit.

A sequence's content depends on lengths only, so the packing is made for the histogram of lengths,
which has at most as many rows as a sequence has tokens, however many documents there are:

* a piece as long as a sequence fills one;
* pieces above a third of a sequence are large: at most two share one, and greedy matching gives
  each, from the longest on, the longest partner that fits;
* the others go, from the longest on, into the fullest sequence that still takes them.

Equal sequences are a run of consecutive numbers, which is split when only a part of it gets
another piece, so that plan and time are bounded as well. The plan tells which sequences and
offsets the pieces of a length get by their rank. Ranks come from running numbers that tasks give
while they tokenize, and sums of the counts of the tasks before.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishap.llm.quality import pieces
from mishap.llm.shared import Tables, prepare, table, text_bytes
from mishap.llm.tokens import _byte_of

VOCABULARY = "word_bpe_49k.json"
LENGTH, END = 2048, 0
#: Words that a task keeps with their ids, and bytes of them; bytes of a slice of a long text.
WORDS, WORD_BYTES, SLICE = 400_000, 1 << 24, 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Words of up to so many bytes and of these characters only, without what may start a special token, are merged here, others by the library.
LONG = 64
_OTHER = re.compile("[^\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]|<\\|")
#: How the tokenizer cuts such words, in lower case.
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+|\n")
#: Ids of single bytes, with and without the word's end, have at most so many bits.
BYTES, _NONE = 9, 1 << 30


class Merges:
    """Byte-pair merges of many words at once: in each turn every word merges its first pair of lowest rank."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.first, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for char, byte in _byte_of().items():
            self.first[byte], self.last[byte] = vocab[char], vocab[char + model["end_of_word_suffix"]]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order, np.array([vocab[a + b] for a, b in pairs], np.int64)

        # pairs of single bytes are looked up in a table, the others searched for
        self.single = np.full((1 << BYTES, 1 << BYTES), _NONE, np.int64)
        low = (self.keys >> 32 < 1 << BYTES) & (self.keys & 0xFFFFFFFF < 1 << BYTES)
        self.single[self.keys[low] >> 32, self.keys[low] & 0xFFFFFFFF] = self.ranks[low]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each)."""
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        text = np.frombuffer(b"".join(words), np.uint8)
        ids = self.first[text]
        ids[ends - 1] = self.last[text[ends - 1]]
        # symbols of all words, the word of each, the rank of each with the next of its word; words that are done are taken out
        word, rank = np.repeat(np.arange(len(words)), size), np.full(len(ids), _NONE)
        at = np.flatnonzero(word[1:] == word[:-1])
        low = ids[at] | ids[at + 1] < 1 << BYTES
        rank[at[low]] = self.single[ids[at[low]], ids[at[low] + 1]]
        rank[at[~low]] = self._rank(ids[at[~low]], ids[at[~low] + 1])
        out, owner = [], []
        while len(ids):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), start)
            going = best < _NONE << 32
            gone = np.repeat(~going, np.diff(np.append(start, len(ids))))
            out.append(ids[gone])
            owner.append(word[gone])
            at = best[going] & 0xFFFFFFFF
            ids[at] = self.merged[rank[at]]
            gone[at + 1] = True
            rank[at] = rank[at + 1]
            at = np.cumsum(~gone)[at] - 1
            ids, word, rank = ids[~gone], word[~gone], rank[~gone]
            # only the pairs on both sides of a merged one are new
            left = at[at > 0] - 1
            at = np.append(left[word[left] == word[left + 1]], at[(at + 1 < len(ids)) & (word[np.minimum(at + 1, len(ids) - 1)] == word[at])])
            rank[at] = self._rank(ids[at], ids[at + 1])
        owner = np.concatenate([*owner, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([*out, np.zeros(0, np.int64)])[order], np.bincount(owner, minlength=len(words))


class Words:
    """Ids of texts by a tokenizer whose pieces end at white space: each distinct word is tokenized once and kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # ids of word k: ids[ends[k]:ends[k + 1]]

    def _learn(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        end = int(self.ends[n])
        ends = end + np.cumsum(counts)
        if ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), int(ends[-1])), np.uint32))
        if n + len(words) >= len(self.ends):
            self.ends = np.append(self.ends, np.zeros(max(len(self.ends), len(words)), np.int64))
        self.ids[end : ends[-1]] = ids
        self.ends[n + 1 : n + 1 + len(words)] = ends
        self.known.update(zip(words, range(n, n + len(words))))
        self.size += sum(map(len, words))

    def _learn_all(self, new: set[bytes]) -> None:
        plain = [w for w in new if w.isalpha() and len(w) <= LONG or len(w) <= LONG and not _OTHER.search(w.decode())]
        if plain:
            units = _UNIT.findall(b"\n".join(plain).decode().lower())
            cut = np.flatnonzero(np.fromiter(map("\n".__eq__, units), bool, len(units)))
            ids, counts = self.merges.encode([u.encode() for u in units if u != "\n"])
            self._learn(plain, ids, np.add.reduceat(counts, np.append(0, cut - np.arange(len(cut)))))
        rest = list(new.difference(plain))
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False)]
            self._learn(rest, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > WORDS or self.size > WORD_BYTES:
            self._clear()
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self._learn_all(set(new))
            at[missing] = [self.known[w] for w in new]
        first = self.ends[at]
        n = self.ends[at + 1] - first
        upto = np.append(0, np.cumsum(n))
        ids = self.ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        return np.split(ids, upto[np.cumsum([len(w) for w in split])[:-1]])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text. Long texts go slice by slice, which end at ASCII white space, short ones together."""
        for rows in pieces(texts, SLICE):
            if len(rows) > 1 or len(texts[rows[0]]) <= SLICE:
                yield from self._encode([texts[i] for i in rows])
                continue
            text, out, start = texts[rows[0]], [], 0
            while len(text) - start > SLICE and (m := _WHITE.search(text, start + SLICE)):
                out += self._encode([text[start : m.start()]])
                start = m.start()
            yield np.concatenate([*out, *self._encode([text[start:]])])


_KEPT: dict[str, Words] = {}


def _tokenize(vocabulary: str, length: int, end: int):
    """Pieces of texts, each with its task and its running number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _KEPT.get(vocabulary) or _KEPT.setdefault(vocabulary, Words(vocabulary))
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            found: list[tuple] = []
            for i, ids in enumerate(words.encode([t or b"" for t in texts])):
                ids = np.append(ids, end).astype("<u4")
                for k, start in enumerate(range(0, len(ids), length)):
                    own = ids[start : start + length]
                    found.append((i, k, start, len(own), zlib.crc32(own.tobytes()), seen[len(own)]))
                    seen[len(own)] += 1
            if found:
                columns = [np.array(c, np.int64) for c in zip(*found)]
                arrays = [batch.column("doc_id").take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *map(pa.array, columns[2:]), pa.array(np.full(len(found), part, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return run


def plan(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple], int]:
    """(rows (length, from_rank, to_rank, sequence, each, offset), sequences used) for counts of pieces by length.

    Pieces of ranks from_rank to to_rank - 1 fill consecutive sequences from `sequence` on, `each`
    of them in one, from `offset` on. Both are bounded by the number of lengths."""
    rows: list[tuple] = []
    used, placed = 0, dict.fromkeys(counts, 0)
    runs: dict[int, list[tuple[int, int]]] = {}  # gap left to runs of sequences (first, number) with that gap

    def place(size: int, first: int, sequences: int, each: int, offset: int) -> None:
        rows.append((size, placed[size], placed[size] + sequences * each, first, each, offset))
        placed[size] += sequences * each

    def leave(gap: int, first: int, sequences: int) -> None:
        if gap and sequences:
            runs.setdefault(gap, []).append((first, sequences))

    left = {size: n for size, n in counts.items() if n > 0}
    large = sorted((s for s in left if 3 * s > length), reverse=True)
    for size in large:
        for other in (s for s in large if s <= min(size, length - size)):
            n = left[size] // 2 if other == size else min(left[size], left[other])
            if n:
                place(size, used, n, 1, 0)
                place(other, used, n, 1, size)
                leave(length - size - other, used, n)
                used += n
                left[size] -= n
                left[other] -= n
            if not left[size]:
                break
        if left[size]:
            place(size, used, left[size], 1, 0)
            leave(length - size, used, left[size])
            used += left[size]
            left[size] = 0
    for size in sorted((s for s in left if 3 * s <= length), reverse=True):
        n, gaps = left[size], sorted(runs)
        for gap in gaps[bisect_left(gaps, size) :]:
            each = gap // size
            for first, sequences in runs.pop(gap) if n else ():
                full = min(sequences, n // each)
                if full:
                    place(size, first, full, each, length - gap)
                    leave(gap - each * size, first, full)
                rest = min(n - full * each, each - 1) if full < sequences else 0
                if rest:
                    place(size, first + full, 1, rest, length - gap)
                    leave(gap - rest * size, first + full, 1)
                n -= full * each + rest
                leave(gap, first + full + bool(rest), sequences - full - bool(rest))
            if not n:
                break
        each = length // size
        full, rest = divmod(n, each)
        if full:
            place(size, used, full, each, 0)
            leave(length - each * size, used, full)
        if rest:
            place(size, used + full, 1, rest, 0)
            leave(length - rest * size, used + full, 1)
        used += full + bool(rest)
    return rows, used


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row a piece of a row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and `end`; only those longer than `length` are cut. A null or empty text
    is `end` alone. Rows are packed one by one, those with null or repeated doc_ids, too. Sequences are
    numbered from 0 without gaps. `vocabulary` is a tokenizer file (default: that of the public
    tokenizers' package) whose pieces end at white space. No rows give no rows."""
    spark = prepare(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path(VOCABULARY))
    tables = Tables(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part long"
    cut = tables.keep(docs.select("doc_id", "text").mapInArrow(_tokenize(vocabulary, length, end), schema), "pieces")
    counts = tables.keep(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    by = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    # one row a length, at most `length` of them
    rows, _ = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)
    made = spark.createDataFrame(rows, "length long, from_rank long, to_rank long, sequence long, each long, offset long")
    ranked = cut.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).join(F.broadcast(made), "length")
    ranked = ranked.where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("sequence + (rank - from_rank) div each").alias("sequence_id"), F.expr("offset + (rank - from_rank) % each * length").alias("offset"))


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def brute_plan(lengths: list[int], length: int = LENGTH) -> list[int]:
    """How full each sequence gets when pieces are placed one by one by the same rules; for tests."""
    large = sorted((x for x in lengths if 3 * x > length), reverse=True)
    bins = []
    while large:
        a = large.pop(0)
        mate = next((i for i, b in enumerate(large) if a + b <= length), None)
        bins.append(a if mate is None else a + large.pop(mate))
    for x in sorted((x for x in lengths if 3 * x <= length), reverse=True):
        fits = [i for i, b in enumerate(bins) if b + x <= length]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += x
        else:
            bins.append(x)
    return sorted(bins)
