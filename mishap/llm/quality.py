"""Quality classifier: supervised subword embeddings.

Each white-space word gives a hashed feature, and so do the byte n-grams of the word with its
edges marked, and each two neighbouring words. Pairs are hashed without their order, by what their
words' hashes differ in, so that all pairs of a word and itself share a bucket, which is learned
like any other. A document is the mean of its features' vectors; a softmax layer on the mean gives
the classes. Vectors and layer are learned by stochastic gradient descent in numpy from a bounded
sample of labelled rows. As layer and mean are linear, scoring needs one number a bucket (its
vector's push towards label 1), looked up and averaged over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm.shared import held_out, prepare, table, text_bytes

#: White space (0x20, 0x09-0x0D) becomes the edge mark.
_EDGE = bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c for c in range(256))
_U = np.uint64
_PAIR = _U(0x5851F42D4C957F2D)  # apart from words and n-grams


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17  # a power of two
    grams: tuple[int, ...] = (3, 4, 5)
    dim: int = 12
    epochs: int = 4  # at least, and
    steps: int = 12_000  # so many steps at least
    rate: float = 2.0
    seed: int = 7
    sample: int = 4000  # labelled rows learned from, at most: those with the smallest hashes of doc_id
    text_bytes: int = 1 << 16  # longer texts are scored, but not learned from, so that the sample is of bounded size


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(29))


def features(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, number of features of each text), the features in the order of the texts."""
    text = np.frombuffer(b" " + b" ".join(t.translate(_EDGE) for t in texts) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    owner_end = np.cumsum(lengths) + 1  # a text's features start before this place
    edge = text == 0x20
    where, what = [], []
    code = text.astype(np.uint64)
    for n in s.grams:
        if len(text) >= n:
            size = len(text) - n + 1
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = h * _U(0x100000001B3) + code[k : k + size]
            inside = np.append(0, np.cumsum(edge))
            # no edge but at the ends, and some byte of a word
            ok = (inside[n - 1 : n - 1 + size] - inside[1 : 1 + size]) == 0
            at = np.flatnonzero(ok)
            where.append(at)
            what.append(_mix(h[at]))
    start = np.flatnonzero(~edge[1:] & edge[:-1]) + 1
    if len(start):
        # a word's hash: a sum of its bytes' codes, each turned by its place in the word
        begin = np.zeros(len(text), np.int64)
        begin[start] = start
        place = np.arange(len(text)) - np.maximum.accumulate(begin)
        turned = _mix(code + _U(257) * (place.astype(np.uint64) + _U(1)))
        turned[edge] = 0
        words = _mix(np.add.reduceat(turned, start))
        where.append(start)
        what.append(words)
        whose = np.searchsorted(owner_end - 1, start, "right")
        pair = whose[1:] == whose[:-1]
        where.append(start[1:][pair])
        what.append(_mix(words[1:] ^ words[:-1] ^ _PAIR)[pair])
    at, hashes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, what))
    owner = np.searchsorted(owner_end - 1, at, "right")  # the gap after a text is its last edge
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(texts))[: len(texts)] if len(at) else np.zeros(len(texts), np.int64)
    return (hashes[order].astype(np.uint64) & _U(s.buckets - 1)).astype(np.int64), counts


def learn(texts: list[bytes], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """(push of each bucket, constant): the score of a text is the logistic of constant + mean push."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1, 1, (s.buckets, s.dim)).astype(np.float32) / s.dim
    layer, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    docs = []
    for t in texts:
        f, _ = features([t], s)
        u, c = np.unique(f, return_counts=True)
        docs.append((u, (c / max(1, c.sum())).astype(np.float32)))
    epochs = max(s.epochs, -(-s.steps // max(1, len(docs))))
    steps, total = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = s.rate * (1 - steps / total)
            steps += 1
            u, w = docs[i]
            mean = w @ vectors[u]
            out = layer @ mean + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ layer
            layer -= rate * 0.1 * np.outer(p, mean)
            bias -= rate * 0.01 * p
            vectors[u] -= rate * w[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0])


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, text_bytes: int) -> list[tuple[bytes, int]]:
    """At most `sample` texts of at most `text_bytes` bytes with a label, none held out: those with the smallest hashes of doc_id.

    Rows without label, text or doc_id teach nothing; a doc_id that repeats counts each time."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= text_bytes).join(F.broadcast(ids), "doc_id")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).select("text", "y").toLocalIterator()
    return [(r[0].encode(), 1 if r[1] else 0) for r in found]


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), at: float = 0.3) -> DataFrame:
    """One row a row of docs: doc_id, held_out, score, predicted (1 if score >= at).

    Every whole text is scored, null as empty; texts without features get the score of the constant.
    Without labelled rows every score is 0.5. Columns other than doc_id and text aren't read."""
    spark = prepare(docs.sparkSession)
    rows = labelled(docs, labels, "quality", settings.sample, settings.text_bytes)
    push, constant = learn([t for t, _ in rows], np.array([y for _, y in rows]), settings)
    model = spark.sparkContext.broadcast((push, constant))  # a number a bucket: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        push, constant = model.value
        for batch in batches:
            texts = [t or b"" for t in text_bytes(batch.column(2))]
            out = np.full(len(texts), constant)
            for part in pieces(texts):
                f, counts = features([texts[i] for i in part], settings)
                if len(f):
                    some = np.flatnonzero(counts)
                    first = np.append(0, np.cumsum(counts[some])[:-1])
                    out[np.array(part)[some]] += np.add.reduceat(push[f], first) / counts[some]
            scores = 1 / (1 + np.exp(-out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores), pa.array((scores >= at).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def pieces(texts: list[bytes], most: int = 1 << 18) -> Iterator[list[int]]:
    """Rows whose texts have about `most` bytes together."""
    rows, size = [], 0
    for i, t in enumerate(texts):
        if rows and size + len(t) > most:
            yield rows
            rows, size = [], 0
        rows.append(i)
        size += len(t)
    if rows:
        yield rows


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
