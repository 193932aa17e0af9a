"""Toxicity: undo obfuscation by a noisy-channel decoder, then score the restored words.

Tokens with look-alike digits or symbols, tokens that repeat a letter three times, and runs of
single characters with separators between them are lattices: each character may stand for itself,
for letters it looks like, or (repeats) for nothing, and a separator for the edge of a word or for
nothing, at a cost. A run is decoded whole. Viterbi decoding under a character trigram model of all
documents picks the likeliest text. Plain tokens have one path and stay, and so do numbers. Words of
the restored text, and their beginnings, that speak for label 1 in a bounded sample of labelled rows
have a weight of evidence: the log of how much likelier they are in toxic rows. A text's log-odds
are those of the sample plus each word's weight, the largest of the word and its beginnings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm.quality import pieces
from mishap.llm.shared import held_out, prepare, table, text_bytes

#: What a character may stand for besides itself.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
_LEET = "".join(LOOKS_LIKE).encode()
_LETTERS = bytes(c for c in range(256) if 0x61 <= c <= 0x7A or c >= 0x80)
_WORD = bytes(c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else 0x20 for c in range(256))
_TOKEN = bytes(c if c in _LETTERS or c in _LEET else 0x20 for c in range(256))
_TAIL = re.compile(rb"!+$|([$@|+])\1\1+$")
_THRICE = re.compile(rb"([a-z])\1\1")
_REPEATS = re.compile(rb"[a-z\x80-\xff]*([a-z])\1\1[a-z\x80-\xff]*")
#: Single characters with one to three separators between them.
_SEPARATORS = b" \t\n\r.-_*"
_SPELLED = re.compile(rb"(?<![a-z0-9@$\x80-\xff])(?:[a-z0-9@$!|][ \t\n\r.\-_*]{1,3}){2,}[a-z0-9@$!|](?![a-z0-9@$\x80-\xff])")
#: Symbols of the model: 0 an edge, 1-26 a-z, 27 any other byte of a letter.
_SYMBOL = np.array([c - 0x60 if 0x61 <= c <= 0x7A else c - 0x40 if 0x41 <= c <= 0x5A else 27 if c >= 0x80 else 0 for c in range(256)])
N = 28
SWAP, DROP_REPEAT, DROP_OTHER, DROP_GAP = 1.5, 0.7, 9.0, 0.5  # costs in the channel, in nats


@dataclass(frozen=True)
class Settings:
    sample: int = 8000  # labelled rows learned from, at most: those with the smallest hashes of doc_id
    text_bytes: int = 1 << 15  # longer texts are scored, but not learned from, so that the sample is of bounded size
    features: int = 1500
    seen: int = 4  # toxic rows of the sample that a feature needs, and
    share: float = 0.01  # the share of them
    evidence: float = 4.5  # least weight of a feature, in nats, or
    attained: float = 0.6  # this share of the most that any can have, if that is less: small samples learn, too


def trigrams(texts: Iterable[bytes]) -> np.ndarray:
    """Counts of three neighbouring symbols, words only."""
    out = np.zeros(N**3, np.int64)
    for t in texts:
        s = _SYMBOL[np.frombuffer(b"  " + t + b" ", np.uint8)]
        a, b, c = s[:-2], s[1:-1], s[2:]
        ok = (b > 0) | (c > 0)  # an edge before the word's first letter is two edges
        a = np.where(b > 0, a, 0)
        out += np.bincount((a * N * N + b * N + c)[ok], minlength=N**3)
    return out


class Decoder:
    """Viterbi decoding under counts of symbol trigrams."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(N, N, N) + 0.1
        self.cost = (-np.log(c / c.sum(2, keepdims=True))).tolist()
        self.known: dict[bytes, bytes] = {}

    def decode(self, token: bytes) -> bytes:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[token] = self._best(token)
        return got

    def _best(self, token: bytes) -> bytes:
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = -1
        for x in token:
            letter = 0x61 <= x <= 0x7A or x >= 0x80
            choices = [(x, 0.0)] if letter else []
            choices += [(ord(y), SWAP) for y in LOOKS_LIKE.get(chr(x), "")]
            drop = DROP_REPEAT if x == before else math.inf if letter else DROP_OTHER if choices else 0.0
            gap = x in _SEPARATORS
            if gap:
                drop = DROP_GAP if before not in _SEPARATORS else 0.0
            before = x if not gap else 0x20
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (p, q), (cost, path) in states.items():
                row = self.cost[p][q]
                if gap and q:  # the word ends here
                    total = cost + row[0]
                    if total < new.get((0, 0), (math.inf,))[0]:
                        new[0, 0] = (total, (path, 0x20))
                for y, more in choices:
                    s = int(_SYMBOL[y])
                    total = cost + more + row[s]
                    if total < new.get((q, s), (math.inf,))[0]:
                        new[q, s] = (total, (path, y))
                if cost + drop < new.get((p, q), (math.inf,))[0]:
                    new[p, q] = (cost + drop, path)
            states = new
        cost, path = min(((c + (self.cost[p][q][0] if q else 0.0), w) for (p, q), (c, w) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, y = path
            out.append(y)
        return bytes(out[::-1])


def restored_words(text: bytes, decoder: Decoder) -> set[bytes]:
    """The words of the text as it stands and as restored."""
    low = text.decode("utf-8", "replace").lower().encode()
    words = set(low.translate(_WORD).split())
    for token in set(low.translate(_TOKEN).split()):
        if token.translate(None, _LETTERS) and not token.isdigit():
            token = _TAIL.sub(b"", token)
            if token.translate(None, _LETTERS) and not token.isdigit():
                words.add(decoder.decode(token))
    if _THRICE.search(low):
        words.update(decoder.decode(m[0]) for m in _REPEATS.finditer(low))
    for m in _SPELLED.finditer(low):
        words.update(decoder.decode(m[0]).split())
    return words - {b""}


def _features(words: set[bytes]) -> set[bytes]:
    """Words, and their first 3 to 6 bytes marked with a star."""
    out = set(words)
    for w in words:
        for n in (3, 4, 5, 6):
            if len(w) > n:
                out.add(w[:n] + b"*")
    return out


@dataclass
class Model:
    weight: dict[bytes, float]
    constant: float

    def __post_init__(self):
        self.heads = {f[:3] for f in self.weight}

    def logit(self, words: set[bytes]) -> float:
        heads, weight = self.heads, self.weight
        near = [w for w in words if w[:3] in heads]
        return self.constant + sum(max((weight.get(f, 0.0) for f in _features({w})), default=0.0) for w in near)


def fit(rows: Iterable[tuple[set[bytes], int]], s: Settings) -> Model:
    """A model from (words, label) rows; rows of equal words count once, so that copies don't weigh.

    Words are kept joined, as sets of them would fill the driver."""
    kept = list({(b" ".join(sorted(w)), y) for w, y in rows})
    features = lambda joined: _features(set(joined.split()))
    toxic = sum(y for _, y in kept)
    clean = len(kept) - toxic
    yes: Counter = Counter()
    for w, y in kept:
        if y:
            yes.update(features(w))
    yes = Counter({f: k for f, k in yes.items() if k >= max(s.seen, s.share * toxic)})
    no: Counter = Counter()
    for w, y in kept:
        if not y:
            no.update(f for f in features(w) if f in yes)
    evidence = {f: math.log((a + 0.5) / (toxic + 1)) - math.log((no[f] + 0.5) / (clean + 1)) for f, a in yes.items()}
    least = min(s.evidence, s.attained * math.log(2 * (clean + 1)))
    best = sorted((f for f, e in evidence.items() if e > least), key=lambda f: (-yes[f] * evidence[f], f))[: s.features]
    return Model({f: evidence[f] for f in best}, math.log((toxic + 0.5) / (clean + 0.5)))


def character_counts(docs: DataFrame) -> np.ndarray:
    """Symbol trigrams of all texts: each task counts its own, 28^3 sums are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            texts = [t or b"" for t in text_bytes(batch.column(0))]
            total += trigrams(b" ".join(texts[i] for i in part) for part in pieces(texts))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    found = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N**3, np.int64)
    for r in found:
        out[r.at] = r.n
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> Iterator[tuple[bytes, int]]:
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.select("doc_id", F.col("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(s.sample)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= s.text_bytes).join(F.broadcast(ids), "doc_id")
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(s.sample).select("text", "y").toLocalIterator():
        yield r[0].encode(), 1 if r[1] else 0


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), at: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """One row a row of docs: `keep` (doc_id by default), held_out, score, predicted (1 if score >= at).

    Whole texts are scored, null as empty; a text without known features gets the score of the
    constant. Without toxic labels nothing is known and scores are near 0. Labels, lang, source and
    doc_id don't enter a score. A doc_id that repeats is scored row by row."""
    spark = prepare(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    counts = character_counts(docs)
    decoder = Decoder(counts)
    model = fit(((restored_words(t, decoder), y) for t, y in sample_rows(docs, labels, settings)), settings)
    sent = spark.sparkContext.broadcast((counts, model.weight, model.constant))  # at most settings.features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weight, constant = sent.value
        decoder, model = Decoder(counts), Model(weight, constant)
        for batch in batches:
            out = [model.logit(restored_words(t or b"", decoder)) for t in text_bytes(batch.column(len(keep) + 1))]
            scores = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(scores), pa.array((scores >= at).astype(np.int32))], names=[*keep, "held_out", "score", "predicted"])

    rows = docs.select(*keep, held_out(F.col("doc_id")).alias("__held"), F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{fields}, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
