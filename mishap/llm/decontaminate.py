"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Test strings are windows of `n` consecutive words of benchmark items. For each length m of test
strings (n, and the shorter lengths of items with fewer than n words) there is a block of tables:
`shift` maps a block of two words to how far the search may move on when a text's window ends in
it (blocks of no test string move it by m - 1), `bucket` maps the last block of a test string,
and under it its first word, to the test strings to compare with the text word by word.

The test strings are a table in the shared folder, dealt out by hash into parts of bounded size. A
task searches its documents for one part, whose tables a worker builds once; with several parts each
document is searched by a task a part, and what they found is merged by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mishap.llm.shared import Tables, local_root, parts_of, prepare, table, text_bytes

#: Lower-cases A-Z and turns all that is no word byte into spaces; bytes over 0x7F belong to words.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: A part of the test strings has about so many.
BLOCK_WINDOWS = 200_000
_HITS = "items array<string>, hits array<struct<start:long,end:long>>"
_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null has none."""
    return (text or b"").translate(_BYTES).split()


class WuManber:
    """Tables for test strings of words; each stands for the item ids it comes from."""

    def __init__(self, windows: dict[tuple[bytes, ...], set]):
        self.by_length: dict[int, tuple[int, dict, dict]] = {}
        for length in sorted({len(w) for w in windows}):
            size = min(2, length)  # words a block
            shift: dict[tuple, int] = {}
            bucket: dict[tuple, dict[bytes, list]] = {}
            for window, items in windows.items():
                if len(window) == length:
                    for end in range(size, length + 1):
                        block = window[end - size : end]
                        shift[block] = min(shift.get(block, length), length - end)
                    bucket.setdefault(window[-size:], {}).setdefault(window[0], []).append((window, frozenset(items)))
            self.by_length[length] = (size, shift, bucket)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset]]:
        """(start, end, items) of every occurrence of a test string, overlaps too."""
        for length, (size, shift, bucket) in self.by_length.items():
            far, end, n = length - size + 1, length, len(words)
            while end <= n:
                block = tuple(words[end - size : end])
                skip = shift.get(block, far)
                if skip:
                    end += skip
                    continue
                for window, items in bucket[block].get(words[end - length], ()):
                    if tuple(words[end - length : end]) == window:
                        yield end - length, end, items
                end += 1


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(window, item_id as text), distinct: windows of n words joined by spaces; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(text)
                found = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1) if words else 0)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "window binary, item string").distinct()


#: The tables of the part that this worker built last, by the part's folder.
_BUILT: dict[str, WuManber] = {}


def built(at: str) -> WuManber:
    """The tables of the test strings in a folder."""
    if at not in _BUILT:
        _BUILT.clear()
        files, _ = local_root(at)
        found: dict[tuple[bytes, ...], set] = {}
        for name in parts_of(at):
            t = pq.read_table(name, filesystem=files, columns=["window", "item"])
            for window, item in zip(t["window"].to_pylist(), t["item"].to_pylist()):
                found.setdefault(tuple(window.split(b" ")), set()).update(() if item is None else (item,))
        _BUILT[at] = WuManber(found)
    return _BUILT[at]


def _merged(hits: list[tuple[int, int]]) -> list[list[int]]:
    spans: list[list[int]] = []
    for start, end in sorted(hits):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _finished(batch: pa.RecordBatch, kept: int, sizes: list[int], items: list, hits: list) -> pa.RecordBatch:
    """Rows with what was found: items and (start, end) hits of each text, in any order and with repeats."""
    spans = [_merged(h) for h in hits]
    ids = [sorted(set(x)) for x in items]
    n_hit = [sum(e - s for s, e in x) for x in spans]
    columns = [
        (sizes, pa.int64()),
        (n_hit, pa.int64()),
        ([len(x) for x in ids], pa.int64()),
        ([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()),
        ([h > 0 and 20 * h >= n for h, n in zip(n_hit, sizes)], pa.bool_()),
        (ids, pa.list_(pa.string())),
        ([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
    ]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
    return pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(c, type=t) for c, t in columns)], names=[*batch.schema.names[:kept], *names])


def _search(at: str, texts: list) -> tuple[list[int], list[set], list[list[tuple[int, int]]]]:
    """(words, items and hits) of each text."""
    tables, sizes, items, hits = built(at), [], [], []
    for text in texts:
        words, found, places = words_of(text), set(), []
        for start, end, ids in tables.search(words):
            places.append((start, end))
            found |= ids
        sizes.append(len(words))
        items.append(found)
        hits.append(places)
    return sizes, items, hits


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, keep: list[str] | None = None) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and
    `items` (ids sorted as strings) and `spans` (merged runs of hit words, as [start, end)).

    A word inside any occurrence of a test string is hit; contaminated is n_hit > 0 and
    20 * n_hit >= n_words. Null or wordless texts have no words and aren't contaminated; wordless
    items match nothing; items that repeat a text each count, rows that repeat an id count once.
    `keep` names columns of docs to hand on before these."""
    spark = prepare(docs.sparkSession)
    tables = Tables(spark, "decontaminate")
    keep = ["doc_id"] if keep is None else keep
    texts = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = StructType([*texts.drop("__text").schema, *StructType.fromDDL(_FOUND)])
    tests = tables.keep(windows(benchmark, n), "windows")
    parts = max(1, -(-tests.count() // BLOCK_WINDOWS))
    if parts == 1:
        at = tables.path("windows")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _finished(batch, len(keep), *_search(at, text_bytes(batch.column(len(keep)))))

        return texts.mapInArrow(whole, schema)

    # rows with one text share what is found in it
    part = F.pmod(F.xxhash64("window"), parts)
    tests.select("window", "item", part.alias("part")).repartition(parts, "part").write.partitionBy("part").parquet(tables.path("parts"))
    texts = texts.withColumn("__key", F.unhex(F.sha2(F.coalesce("__text", F.lit("")), 256)))
    found = None
    for p in range(parts):
        at = f"{tables.path('parts')}/part={p}"

        def one(batches: Iterator[pa.RecordBatch], at: str = at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, items, hits = _search(at, text_bytes(batch.column(1)))
                some = [i for i, h in enumerate(hits) if h]
                spans = [[{"start": s, "end": e} for s, e in _merged(hits[i])] for i in some]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array([list(items[i]) for i in some], pa.list_(pa.string())), pa.array(spans, _SPANS)], names=["__key", "items", "hits"])

        hit = texts.select("__key", "__text").mapInArrow(one, f"__key binary, {_HITS}")
        found = hit if found is None else found.union(hit)
    # a text's finds are as many as its words at most, and the same for each of its copies
    found = found.groupBy("__key").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"), F.array_distinct(F.flatten(F.collect_set("hits"))).alias("__hits"))
    found = tables.keep(found, "found")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [len(words_of(t)) for t in text_bytes(batch.column(len(keep)))]
            items, hits = (batch.column(len(keep) + i).to_pylist() for i in (1, 2))
            yield _finished(batch, len(keep), words, [x or () for x in items], [[(h["start"], h["end"]) for h in x or ()] for x in hits])

    return texts.join(found, "__key", "left").select(*keep, "__text", "__items", "__hits").mapInArrow(finish, schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + 12], ' ') AS s FROM starts),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM words CROSS JOIN lengths),
grams AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM places),
hits AS (SELECT DISTINCT g.doc_id, g.m, g.i, item_id FROM grams g JOIN windows v ON g.m = v.m AND g.s = v.s),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hits) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words h ON h.doc_id = words.doc_id LEFT JOIN ids ON ids.doc_id = words.doc_id
"""
