"""LM scoring: stupid-backoff scores from n-gram count tables.

S(w | v) is c(v w) / c(v) if the pair stands at least twice in the corpus, else 0.4 * c(w) / N; a
first word's is c(w) / N. With order 3, words after two others begin with the triple. A document's score is the sum of ln S over its words. Counts are of all
documents. The work is relational: word counts and pair counts by hash partition, then every pair
of every document joined to the pairs' values and summed per document.

What a word costs by itself (its backed-off score) is summed first, so that only pairs in the table
change it: value(v w) = ln c(v w) - ln c(v) - ln(0.4 c(w) / N). Exploded pairs and their count table
share one exchange, by hash of the pair: a partition counts its pairs, looks their values up and
sums them by document. The commonest words (a bounded number) go out by broadcast, as small numbers
that keep exchanged rows short. So do the counts of commonest pairs, which a sample picks and a
pass over all documents counts: no pair with many rows is left for the exchange, and the sample
decides on nothing but the way. Pairs with other words keep 64-bit hashes and join the word counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm.quality import pieces
from mishap.llm.shared import Tables, prepare, table, text_bytes

BACKOFF, LEAST, ORDER = 0.4, 2, 2
#: At most so many words and pairs are broadcast.
WORDS, PAIRS, SAMPLE = 400_000, 100_000, 0.02
#: Exploded pairs in a partition, and bytes of text hashed together.
ROWS, PIECE = 1_500_000, 1 << 17
_U = np.uint64
_BYTES = bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(negative 64-bit hash of each word, number of words of each text)."""
    text = np.frombuffer(b" " + b" ".join(t.translate(_BYTES) for t in texts) + b" ", np.uint8)
    edge = text == 0x20
    start = np.flatnonzero(~edge[1:] & edge[:-1]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.append(0, np.searchsorted(start, ends, "right")))
    if not len(start):
        return np.zeros(0, np.int64), counts
    begin = np.zeros(len(text), np.int64)
    begin[start] = start
    place = (np.arange(len(text)) - np.maximum.accumulate(begin)).astype(np.uint64)
    codes = _mix(text.astype(np.uint64) + _U(257) * (place + _U(1)))
    codes[edge] = 0
    return (_mix(np.add.reduceat(codes, start)) | _U(1 << 63)).view(np.int64), counts


class Common:
    """The commonest words: hash to number, and each number's count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by = np.lexsort((hashes, -counts))
        self.counts = counts[by]
        order = np.argsort(hashes[by])
        self.hashes, self.numbers = hashes[by][order], order

    def number(self, h: np.ndarray) -> np.ndarray:
        """Numbers of common words; other hashes as they are (negative)."""
        if not len(self.hashes):
            return h
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, self.numbers[i], h)


def _hashed(texts: list[bytes | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, word hashes, words of each row) of pieces of the texts."""
    whole = [t or b"" for t in texts]
    for part in pieces(whole, PIECE):
        yield part, *word_hashes([whole[i] for i in part])


def _pairs_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs' second words, and each word's text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.flatnonzero(np.append(False, owner[1:] == owner[:-1])) if len(words) else np.zeros(0, np.int64), owner


def _pair_hashes(h: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes (not negative) of pairs of neighbours, given by the place of the second."""
    v, w = h[second - 1].view(np.uint64), h[second].view(np.uint64)
    return (_mix(v * _U(0x9E3779B97F4A7C15) + w) >> _U(1)).view(np.int64)


def _places(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in sorted keys, -1 where they aren't."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def _threshold(counts: DataFrame, most: int, least: int) -> int:
    """The smallest count, from `least` on, that at most `most` rows reach."""
    total, at = 0, None
    sizes = counts.where(F.col("c") >= least).groupBy("c").agg(F.count("*").alias("n"))
    for r in sorted(sizes.toLocalIterator(), key=lambda r: -r.c):  # different counts are few: their sum is the corpus
        total += r.n
        if total > most:
            break
        at = r.c
    return at or 1 << 62


def _triples(spark: SparkSession, tables: Tables, keyed: DataFrame, words: DataFrame, backoff: float, least: int) -> DataFrame:
    """(key, third): what triples change of the score that pairs give.

    A word after two others has S3 = c(u v w) / c(u v) if the triple stands at least `least` times, else
    0.4 S2. With such a triple its pairs stand as often, so S2 is c(v w) / c(v), and the change is
    ln c(u v w) - ln c(u v) - ln c(v w) + ln c(v); otherwise it is ln 0.4. Triples, pairs and words
    have count tables by hash, each joined to the n-grams that need it."""

    def explode(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for part, h, counts in _hashed(text_bytes(batch.column(1))):
                    second, owner = _pairs_of(h, counts)
                    pair = np.zeros(len(h), np.int64)
                    pair[second] = _pair_hashes(h, second)
                    if n == 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(pair[second], return_counts=True)], names=["h", "c"])
                        continue
                    third = second[np.append(False, second[1:] == second[:-1] + 1)] if len(second) else second
                    third = third[owner[third - 2] == owner[third]]
                    triple = (_mix(pair[third - 1].view(np.uint64) * _U(0x9E3779B97F4A7C15) + h[third].view(np.uint64)) >> _U(1)).view(np.int64)
                    columns = (ids[np.array(part)][owner[third]], triple, pair[third - 1], pair[third], h[third - 1])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "t", "uv", "vw", "v"])

        return run

    rows = tables.keep(keyed.select("key", "text").mapInArrow(explode(3), "key long, t long, uv long, vw long, v long"), "triples")
    often = tables.keep(rows.groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") >= least), "often")
    found = tables.keep(rows.join(often, "t"), "triples_found")
    pairs = keyed.select("key", "text").mapInArrow(explode(2), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    pairs = tables.keep(pairs.where(F.col("c") >= least), "pair_counts")
    terms = found.select("key", F.col("uv").alias("h")).union(found.select("key", "vw")).join(pairs, "h").select("key", (-F.log("c")).alias("x"))
    terms = terms.union(found.select("key", F.col("v").alias("w")).join(words, "w").select("key", F.log("c")))
    terms = terms.union(found.select("key", F.log("c") - math.log(backoff)))
    terms = terms.union(rows.groupBy("key").agg(F.count("*").alias("n")).select("key", F.col("n") * math.log(backoff)))
    return tables.keep(terms.groupBy("key").agg(F.sum("x").alias("third")), "third")


def stupid_backoff(docs: DataFrame, backoff: float = BACKOFF, least: int = LEAST, most_words: int = WORDS, most_pairs: int = PAIRS, sample: float = SAMPLE, order: int = ORDER) -> DataFrame:
    """One row a row of docs: doc_id, n_words, log_score (sum of ln S), mean_log_score.

    `order` is 2 (pairs) or 3 (triples). `least` is 2: an n-gram that stands once stands in the scored
    text alone, and would make every text sure of itself.

    Words are runs without ASCII white space of whole texts. Null and wordless texts have n_words
    0, log_score 0 and a null mean. Rows that repeat an id and text count in the corpus each and
    get one score. Hashes are of 64 bits: words that share one would share counts."""
    spark = prepare(docs.sparkSession)
    tables = Tables(spark, "lm")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("text")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, n in _hashed(text_bytes(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(_pair_hashes(h, _pairs_of(h, n)[0]))], names=["pair"])

    picked = tables.keep(texts.sample(sample, seed=1).mapInArrow(sampled, "pair long").groupBy("pair").agg(F.count("*").alias("c")), "picked")
    keys = np.sort(picked.where(F.col("c") >= _threshold(picked, most_pairs, least)).select("pair").toPandas()["pair"].to_numpy(np.int64))
    sent_keys = spark.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words by hash (negative), picked pairs by place."""
        keys = sent_keys.value
        sums = np.zeros(len(keys), np.int64)
        for batch in batches:
            found = []
            for _, h, n in _hashed(text_bytes(batch.column(0))):
                found.append(h)
                at = _places(keys, _pair_hashes(h, _pairs_of(h, n)[0]))
                sums += np.bincount(at[at >= 0], minlength=len(keys))
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["w", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], names=["w", "c"])

    counted = tables.keep(texts.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "counted")
    words = counted.where("w < 0")
    total = words.agg(F.sum("c")).first()[0] or 0
    top = words.where(F.col("c") >= _threshold(words, most_words, 1)).toPandas()
    common = Common(top["w"].to_numpy(np.int64), top["c"].to_numpy(np.int64))
    sent = spark.sparkContext.broadcast(common)
    del top, common
    heavy = np.zeros(len(keys), np.int64)
    exact = counted.where("w >= 0").toPandas()  # at most most_pairs
    heavy[exact["w"].to_numpy(np.int64)] = exact["c"].to_numpy(np.int64)
    sent_counts = spark.sparkContext.broadcast(heavy)

    def alone(c):
        return np.log(backoff * c / total)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.number(batch.column(0).to_numpy())), batch.column(1)], names=["w", "c"])

    def value(pair: np.ndarray, c: np.ndarray) -> np.ndarray:
        counts = sent.value.counts
        return np.where(c >= least, np.log(np.maximum(c, 1)) - np.log(counts[pair >> 32]) - alone(counts[pair & 0xFFFFFFFF]), 0.0)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of common words that aren't broadcast, and per text two rows of a negative pair: an even
        one with what is known of the score, an odd one with the number of words."""
        keys, counts = sent_keys.value, sent.value.counts
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part, h, n in _hashed(text_bytes(batch.column(1))):
                w, own = sent.value.number(h), ids[np.array(part)]
                second, owner = _pairs_of(h, n)
                x = alone(counts[np.maximum(w, 0)]) if len(counts) else np.zeros(len(w))
                x = np.where(w >= 0, x, math.log(backoff / total) if total else 0.0)  # ln c of other words comes by join
                first = np.ones(len(w), bool)
                first[second] = False
                x[first] -= math.log(backoff)
                both = second[(w[second - 1] >= 0) & (w[second] >= 0)]
                pair = w[both - 1] << 32 | w[both]
                at = _places(keys, _pair_hashes(h, both))
                if len(keys):
                    x[both] += np.where(at >= 0, value(pair, sent_counts.value[at]), 0.0)
                left = np.flatnonzero(at < 0)
                known = (own & ~np.int64(1)) | np.int64(-1 << 63)
                columns = (np.concatenate([own[owner[both[left]]], own, own]), np.concatenate([pair[left], known, known | np.int64(1)]), np.concatenate([np.zeros(len(left)), np.bincount(owner, x, len(part)), n]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "pair", "x"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy() for c in range(3)) for b in batches]
        if held:
            ids, pair, x = (np.concatenate(c) for c in zip(*held))
            open_, size = pair >= 0, (pair < 0) & (pair & 1 == 1)
            _, at, c = np.unique(pair[open_], return_inverse=True, return_counts=True)
            x = x.copy()
            x[open_] = value(pair[open_], c[at])
            some = np.flatnonzero(~open_ | (x != 0))
            for i in range(0, len(some), 100_000):
                part = some[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(np.where(size[part], 0.0, x[part])), pa.array(np.where(size[part], x[part], 0.0).astype(np.int64))], names=["key", "x", "n"])

    parts = max(spark.sparkContext.defaultParallelism, -(-total // ROWS))
    sums = keyed.select("key", "text").mapInArrow(explode, "key long, pair long, x double").repartition(parts, "pair")
    sums = tables.keep(sums.mapInArrow(solve, "key long, x double, n long").groupBy("key").agg(F.sum("x").alias("x"), F.sum("n").alias("n")), "sums")

    def explode_other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Other words, each with a null before it, and pairs with another word in them."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part, h, n in _hashed(text_bytes(batch.column(1))):
                w, own = sent.value.number(h), ids[np.array(part)]
                second, owner = _pairs_of(h, n)
                rare, pairs = np.flatnonzero(w < 0), second[(w[second - 1] < 0) | (w[second] < 0)]
                v = pa.array(np.append(np.zeros(len(rare), np.int64), w[pairs - 1]), mask=np.append(np.ones(len(rare), bool), np.zeros(len(pairs), bool)))
                at = np.append(rare, pairs)
                yield pa.RecordBatch.from_arrays([pa.array(own[owner[at]]), v, pa.array(w[at])], names=["key", "v", "w"])

    other = tables.keep(keyed.select("key", "text").mapInArrow(explode_other, "key long, v long, w long"), "other")
    pairs = other.where("v is not null")
    twice = tables.keep(pairs.groupBy("v", "w").agg(F.count("*").alias("c")).where(F.col("c") >= least), "twice")
    found = tables.keep(pairs.join(twice, ["v", "w"]), "found")
    # coef times ln c(word), and what is known of the pair
    terms = other.where("v is null").select("key", "w", F.lit(1.0).alias("coef"))
    terms = terms.union(found.select("key", "v", F.lit(-1.0))).union(found.select("key", "w", F.lit(-1.0)))
    counts = tables.keep(words.mapInArrow(numbered, "w long, c long"), "counts")
    terms = terms.join(counts, "w").select("key", (F.col("coef") * F.log("c")).alias("x"))
    known = found.select("key", (F.log("c") - math.log(backoff / total if total else 1.0)).alias("x"))
    rest = tables.keep(terms.union(known).groupBy("key").agg(F.sum("x").alias("rest")), "rest")

    base = tables.keep(keyed.select("doc_id", "key"), "base")
    copies = base.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    out = base.join(sums, "key", "left").join(rest, "key", "left").join(copies, "key", "left")
    third = F.lit(0.0)
    if order == 3:
        out, third = out.join(_triples(spark, tables, keyed, words, backoff, least), "key", "left"), F.coalesce("third", F.lit(0.0))
    tables.only("base", "sums", "rest", "third")
    times = F.coalesce("copies", F.lit(1))
    score, n = (F.coalesce("x", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0)) + third) / times, (F.coalesce("n", F.lit(0)) / times).cast("long")
    return out.select("doc_id", n.alias("n_words"), score.alias("log_score"), F.when(n > 0, score / n).alias("mean_log_score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stupid_backoff(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
c1 AS (SELECT w, count(*) AS c FROM p GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
s AS (SELECT p.doc_id, CASE WHEN p.v IS NULL THEN ln(a.c / (SELECT count(*) FROM p)) WHEN c2.c IS NOT NULL THEN ln(c2.c / b.c) ELSE ln(0.4 * a.c / (SELECT count(*) FROM p)) END AS x
      FROM p JOIN c1 a ON a.w = p.w LEFT JOIN c1 b ON b.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / len(ws), 6) AS mean_log_score
FROM t LEFT JOIN (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id) USING (doc_id)
"""
