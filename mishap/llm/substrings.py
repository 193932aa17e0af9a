"""Suffix-array dedup: remove every byte covered by a string of `least` bytes that also starts elsewhere.

Strings of `least` bytes are dealt out by their minimizer, the least of the hashes of their 32-byte
substrings: neighbouring strings mostly share it, and equal strings always do. A run of neighbours
with one minimizer is a stretch. Stretches whose minimizer stands at one place only hold no repeat. Equal
stretches are merged with their number; those of a minimizer meet in one Burrows-Wheeler transform
(mishap.llm.bwt), whose bounded prefix values show which of their strings repeat, and each
occurrence of a stretch gets its answer back by join. A minimizer with more than HOT different
stretches is not gathered: these are texts of a next round that deals their strings out by longer
substrings, so that strings apart in some byte part; in the last round a minimizer is a whole string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm.bwt import repeated
from mishap.llm.shared import Tables, prepare, table, text_bytes

LEAST = 200
#: Length of the substrings that are hashed for minimizers, as a share of LEAST, round by round.
SEEDS = (0.16, 0.56, 0.8, 1.0)
#: Bytes of stretches in one transform (more only if one minimizer's stretches have more), and the most stretches of a minimizer there.
CHUNK_BYTES, HOT = 1 << 20, 1000
#: Texts are hashed together up to so many bytes.
TEXT_BYTES = 1 << 19
END = 0xFF  # no byte of UTF-8
_U = np.uint64
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def _codes(seed: int) -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93 + 2 * seed)
    for by in (29, 32):
        x = (x ^ (x >> _U(by))) * _U(0xBF58476D1CE4E5B9)
    return x


class Rolling:
    """Hashes of substrings of a byte array: of all of one length, or of given ranges."""

    def __init__(self, text: np.ndarray, seed: int = 0):
        n = len(text)
        self.sums = np.zeros(n + 1, np.uint64)
        self.back = np.full(n + 1, pow(_BASE[seed], -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        power = np.full(n, _BASE[seed], np.uint64)
        power[:1] = 1
        np.cumprod(power, out=power)
        np.cumsum(_codes(seed)[text] * power, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mix((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        return self._mix((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = np.append(x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def stretches(text: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """(start, length, minimizer, content hash, again) of the stretches of texts joined with END.

    again: the minimizer stands at several places of these texts, maybe in one stretch."""
    if len(text) < least:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
    hashes, width = Rolling(text), least - seed + 1
    every = hashes.all(seed)
    low = sliding_least(every, width)
    most = np.iinfo(np.uint64).max
    around = np.full(width - 1, most, np.uint64)  # a place is a minimizer if it is no more than the largest of its windows' least
    places = every[every == most - sliding_least(np.concatenate([around, most - low, around]), width)]
    values, counts = np.unique(places, return_counts=True)
    ends = np.append(0, np.cumsum(text == END))
    whole = ends[least:] == ends[:-least]
    edge = np.ones(len(low), bool)
    edge[1:] = (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], len(low))[whole[start]] + least - 1
    start = start[whole[start]]
    return start, stop - start, low[start].view(np.int64), hashes.of(start, stop).view(np.int64), np.isin(low[start], values[counts > 1])


def _joined(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, their first bytes, their texts joined with END), in pieces of about TEXT_BYTES."""
    rows, size = [], 0
    for i, t in enumerate([*texts, None]):
        if rows and (t is None or size + len(t) > TEXT_BYTES):
            lengths = np.array([len(texts[k]) + 1 for k in rows])
            yield rows, np.append(0, np.cumsum(lengths)[:-1]), np.frombuffer(bytes([END]).join([*(texts[k] for k in rows), b""]), np.uint8)
            rows, size = [], 0
        if t is not None:
            rows.append(i)
            size += len(t)


def _find(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, first, text in _joined([t or b"" for t in text_bytes(batch.column(2))]):
                start, length, low, content, again = stretches(text, least, seed)
                doc = np.searchsorted(first, start, "right") - 1
                take = pa.array(np.array(rows)[doc])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((start - first[doc]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(low), pa.array(content), pa.array(again)], names=["key", "n", "start", "len", "m", "ch", "again"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the chosen stretches."""
    for batch in batches:
        chosen, texts = batch.column(1), text_bytes(batch.column(0))
        counts = np.diff(chosen.offsets.to_numpy())
        flat = chosen.flatten()
        start, length = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "len"))
        whose = np.repeat(np.arange(len(counts)), counts)
        for at in range(0, len(start), 20_000):
            part = slice(at, at + 20_000)
            pieces = [texts[d][s : s + n] for d, s, n in zip(whose[part].tolist(), start[part].tolist(), length[part].tolist())]
            yield pa.RecordBatch.from_arrays([*(flat.field(c)[part] for c in ("m", "ch", "len", "n", "hot")), pa.array(pieces, pa.binary())], names=["m", "ch", "len", "n", "hot", "piece"])


def _runs(offsets: np.ndarray, least: int) -> list[dict]:
    """Byte runs covered by the strings that start at sorted offsets."""
    if not len(offsets):
        return []
    gap = np.flatnonzero(np.diff(offsets) > least)
    a, b = np.append(offsets[:1], offsets[gap + 1]), np.append(offsets[gap], offsets[-1]) + least
    return [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _transform(least: int, chunk_bytes: int):
    """Which strings repeat, of stretches sorted by minimizer: one transform for each chunk of whole minimizers."""

    def solve(m: list, ch: list, n: list, pieces: list) -> pa.RecordBatch:
        text = np.frombuffer(bytes([END]).join([*pieces, b""]), np.uint8)
        length = np.array([len(p) for p in pieces])
        first = np.append(0, np.cumsum(length + 1)[:-1])
        ends = np.append(0, np.cumsum(text == END))
        sure = np.zeros(len(text), bool)
        sure[: len(text) - least + 1] = ends[least:] == ends[:-least]
        found = repeated(text, least, np.repeat(np.array(n), length + 1), sure)
        at = np.flatnonzero(found)
        cuts = np.searchsorted(at, first)
        out = [_runs(at[a:b] - f, least) for a, b, f in zip(cuts, np.append(cuts[1:], len(at)), first)]
        some = [i for i, x in enumerate(out) if x]
        return pa.RecordBatch.from_arrays([pa.array([m[i] for i in some], pa.int64()), pa.array([ch[i] for i in some], pa.int64()), pa.array([len(pieces[i]) for i in some], pa.int32()), pa.array([out[i] for i in some], _RUNS)], names=["m", "ch", "len", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "ch", "n", "piece"))):
                if size >= chunk_bytes and row[0] != held[0][-1]:
                    yield solve(*held)
                    held, size = ([], [], [], []), 0
                for column, x in zip(held, row):
                    column.append(x)
                size += len(row[3]) + 1
        if size:
            yield solve(*held)

    return run


def _apply(names: list[str], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, runs in zip(text_bytes(batch.column("__text")), batch.column("__runs").to_pylist()):
                text = text or b""
                spans: list[dict] = []
                for r in sorted(runs or (), key=lambda r: r["a"]):
                    if spans and r["a"] <= spans[-1]["b"]:
                        spans[-1]["b"] = max(spans[-1]["b"], r["b"])
                    else:
                        spans.append(dict(r))
                at, kept = 0, []
                for s in spans:
                    kept.append(text[at : s["a"]])
                    at = s["b"]
                kept.append(text[at:])
                size = sum(map(len, kept))
                whole = "".join(k.decode("utf-8", "ignore") for k in kept) if as_text else b"".join(kept)
                for column, x in zip(out, (len(text), len(text) - size, len(spans), spans, whole)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), _RUNS, pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, type=k) for x, k in zip(out, kinds))], names=[*names, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def _spans(tables: Tables, source: DataFrame, least: int, hot: int, chunk_bytes: int, level: int = 0) -> DataFrame:
    """(key, runs) of the rows of source (key, n, text: a text that stands n times) with repeated strings."""
    last, one, seed = level + 1 == len(SEEDS), ["m", "ch", "len"], max(1, round(SEEDS[level] * least))
    name = lambda x: f"{x}{level}"
    every = tables.keep(source.mapInArrow(_find(least, seed), "key binary, n long, start int, len int, m long, ch long, again boolean"), name("every"))
    again = tables.keep(every.groupBy("m").agg(F.sum("n").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("m"), name("again"))
    places = tables.keep(every.drop("again").join(again, "m"), name("places"))
    tables.drop(name("every"))
    distinct = tables.keep(places.groupBy(*one).agg(F.min(F.struct("key", "start")).alias("at"), F.sum("n").alias("n")), name("distinct"))
    many = tables.keep(distinct.groupBy("m").count().where(F.col("count") > hot).where(F.lit(not last)).select("m", F.lit(True).alias("hot")), name("many"))
    chosen = distinct.join(many, "m", "left").select(F.col("at.key").alias("key"), F.struct(*one, F.col("at.start").alias("start"), F.least("n", F.lit(2)).cast("long").alias("n"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
    chosen = tables.keep(chosen.groupBy("key").agg(F.collect_list("s").alias("chosen")), name("chosen"))
    # rows with one key have one text: a stretch that comes twice here has n = 2 anyway
    pieces = source.select("key", "text").join(chosen, "key").select("text", "chosen")
    pieces = tables.keep(pieces.mapInArrow(_cut, "m long, ch long, len int, n long, hot boolean, piece binary"), name("pieces"))
    size = pieces.agg(F.sum("len")).first()[0] or 0
    parts = max(1, -(-size // (8 * chunk_bytes)), tables.spark.sparkContext.defaultParallelism)
    cold = pieces.where("not hot").repartition(parts, "m").sortWithinPartitions(*one)
    found = tables.keep(cold.mapInArrow(_transform(least, chunk_bytes), "m long, ch long, len int, runs array<struct<a:int,b:int>>"), name("found"))
    if not many.isEmpty():
        deeper = pieces.where("hot").select(F.encode(F.concat_ws(",", *one), "UTF-8").alias("key"), "n", F.col("piece").alias("text"))
        parent = F.split(F.decode("key", "UTF-8"), ",")
        deeper = _spans(tables, deeper, least, hot, chunk_bytes, level + 1)
        found = found.unionByName(deeper.select(*(parent[i].cast(found.schema[c].dataType).alias(c) for i, c in enumerate(one)), "runs"))
    found = tables.keep(found.dropDuplicates(one), name("answers"))
    tables.drop(name("pieces"))
    runs = places.join(found, one).select("key", "start", F.explode("runs").alias("r"))
    run = F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"))
    out = tables.keep(runs.groupBy("key").agg(F.collect_set(run).alias("runs")), name("spans"))
    tables.drop(*map(name, ("places", "distinct", "chosen", "found", "answers")))
    return out


def dedup_substrings(docs: DataFrame, least: int = LEAST, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row a row of docs: `keep` (doc_id by default), n_bytes, n_removed, n_spans, spans, kept (binary).

    spans are the maximal removed runs [a, b); kept is what remains, which may split a character
    (as_text: kept is a string, without what is left of split characters).
    A null text counts as empty; texts under `least` bytes keep all; rows that repeat a doc_id and
    text are copies like any other. Texts are UTF-8, so that byte 0xFF is free as a separator."""
    spark = prepare(docs.sparkSession)
    tables = Tables(spark, "substrings")
    keep = ["doc_id"] if keep is None else keep
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    texts = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"), key.alias("__key"))
    source = texts.where(F.octet_length("__text") >= least).select(F.col("__key").alias("key"), F.lit(1).cast("long").alias("n"), F.col("__text").alias("text"))
    spans = _spans(tables, source, least, hot, chunk_bytes).select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
    whole = texts.join(spans, "__key", "left").select(*keep, "__text", "__runs")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keep).schema)
    return whole.mapInArrow(_apply(keep, as_text), f"{fields}, n_bytes long, n_removed long, n_spans long, spans array<struct<a:int,b:int>>, kept {'string' if as_text else 'binary'}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of 200 bytes of all documents, as hexadecimal digits (cut from pieces of 512 starts, as DuckDB counts characters from the front).
OP4_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
y AS (SELECT doc_id, c, substr(x, 1024 * c + 1, 1422) AS y FROM (SELECT doc_id, x, unnest(range(0, (n - 200) // 512 + 1)) AS c FROM h WHERE n >= 200)),
g AS (SELECT doc_id, 512 * c + j AS i, md5(substr(y, 2 * j + 1, 400)) AS k FROM (SELECT *, unnest(range(0, least(512, strlen(y) // 2 - 199))) AS j FROM y)),
s AS (SELECT doc_id, i FROM g JOIN (SELECT k FROM g GROUP BY k HAVING count(*) > 1) USING (k)),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
p AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM o),
v AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM p GROUP BY doc_id, island),
z AS (SELECT v.doc_id, a, b, x, coalesce(lead(a) OVER (PARTITION BY v.doc_id ORDER BY a), n) AS nxt, row_number() OVER (PARTITION BY v.doc_id ORDER BY a) AS r FROM v JOIN h USING (doc_id)),
k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(CASE WHEN r = 1 THEN substr(x, 1, 2 * a) ELSE '' END || substr(x, 2 * b + 1, 2 * (nxt - b)), '' ORDER BY a) AS kept FROM z GROUP BY doc_id)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""


def brute_force(texts: list[str | None], least: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, string by string; for tests."""
    raw = [(t or "").encode() for t in texts]
    times: dict[bytes, int] = {}
    for t in raw:
        for i in range(len(t) - least + 1):
            times[t[i : i + least]] = times.get(t[i : i + least], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if times[t[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((len(t), len(t) - len(kept), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
