"""Source divergence audit: how far the sources of a language are apart, and by which terms.

Tasks count terms by (language, source) before anything is shuffled; a term's counts then meet in
one row, its postings. A source gives each kept term of its language a share p in whole numbers,
and (p, q) a divergence f = floor((p - q)^2 / q). Pairs of sources sum f over all kept terms, in two
parts that are added exactly:

* heavy terms, which many of the sources have, are tiles of a dense table of shares (terms by
  sources), compared column by column;
* light terms are first taken as absent from all sources, where f is one number a pair of sources.
  What a source with the term changes towards all sources without it depends on its count only: one
  correction a distinct (source, count), times its terms. Pairs of sources that both have the term
  are corrected from the term's postings.

Each task sends one partial sum a pair of sources of a language, and the 200 first terms a source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishap.llm.shared import Tables, local_root, parts_of, prepare, table, text_bytes

#: A-Z to lower case, other ASCII but letters to spaces.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Terms that a task counts before it hands them on; bytes of a slice of a long text.
ENTRIES, SLICE = 300_000, 1 << 20
#: Postings compared at a time, and numbers in an array of shares or sums.
POSTINGS, NUMBERS = 1 << 20, 1 << 21
#: A term is heavy if at least one in so many sources of its language has it.
HEAVY = 4


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of a task's documents, and a row with a null term for each group."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in groups.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())],
                names=["lang", "source", "term", "n", "df"],
            )
        groups.clear()

    for batch in batches:
        for text, lang, source in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            n, df = groups.setdefault((lang, source), (Counter(), Counter()))
            text, start, own = text.translate(_BYTES), 0, set()
            while start < len(text):
                end = text.find(b" ", start + SLICE) if len(text) - start > SLICE else -1
                words = text[start : end if end >= 0 else len(text)].split()
                n.update(words)
                own.update(words)
                start = end if end >= 0 else len(text)
            df.update(own)
        if sum(len(n) for n, _ in groups.values()) > ENTRIES:
            yield from hand_on()
    yield from hand_on()


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total) in 64 bits, digit by digit of base 1000; total is below 9 * 10^15."""
    rest, out = np.asarray(count, np.int64) + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pair_sums(first: int, last: int, sizes: np.ndarray, at: np.ndarray, p: np.ndarray, absent: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of f(source, other) over terms for sources first to last - 1 and all others.

    sizes: postings of each term; at, p, count: source, share and count of each posting, term by term;
    absent: the share that each source gives a term it doesn't have."""
    n = len(absent)
    out = np.zeros((last - first, n), np.int64)
    ends = np.cumsum(sizes)
    heavy = sizes * HEAVY >= n
    # dense tiles of heavy terms
    rows = np.repeat(heavy, sizes)
    term = np.repeat(np.cumsum(heavy) - 1, sizes)[rows]
    step = max(1, NUMBERS // n)
    for start in range(0, int(heavy.sum()), step):
        own = (term >= start) & (term < start + step)
        tile = np.tile(absent, (min(step, int(heavy.sum()) - start), 1))
        tile[term[own] - start, at[rows][own]] = p[rows][own]
        for g in range(first, last):
            out[g - first] += divergence(tile[:, g, None], tile).sum(0)
    # light terms: absent everywhere,
    none = divergence(absent[first:last, None], absent[None, :])
    out += int((~heavy).sum()) * none
    # but for one source,
    light = ~rows
    if light.any():
        one, times = np.unique(np.stack([at[light], count[light], p[light]]), axis=1, return_counts=True)
        for start in range(0, one.shape[1], step):
            g, share_of, m = one[0, start : start + step], one[2, start : start + step], times[start : start + step, None]
            inside = (g >= first) & (g < last)
            here = g[inside] - first
            np.add.at(out, here, m[inside] * (divergence(share_of[inside, None], absent[None, :]) - none[here]))
            np.add.at(out.T, g, m * (divergence(absent[None, first:last], share_of[:, None]) - none[:, g].T))
        # or for two of its own postings
        for k in np.unique(sizes[~heavy & (sizes > 1)]).tolist():
            terms = np.flatnonzero(~heavy & (sizes == k))
            own = (ends[terms] - k)[:, None] + np.arange(k)
            for d in range(1, k):
                a, b = own.ravel(), np.roll(own, d, axis=1).ravel()
                some = (at[a] >= first) & (at[a] < last)
                a, b = a[some], b[some]
                g, h = at[a], at[b]
                change = divergence(p[a], p[b]) - divergence(p[a], absent[h]) - divergence(absent[g], p[b]) + divergence(absent[g], absent[h])
                np.add.at(out, (g - first, h), change)
    return out


def _compare(groups: str, most: int):
    """Partial sums (lang, source, 'pair', other source, sum) and the `most` first terms (lang, source, 'term', term, f) of a source.

    Rows are (lang, term, postings); those with a null term only bring the pairs of a language."""

    def score(lang: str, terms: pa.Array, sizes: np.ndarray, sources: pa.Array, n: np.ndarray, known: tuple) -> Iterator[pa.RecordBatch]:
        names, totals, kept = known
        if not len(names):
            return
        at = pc.index_in(sources, names).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = np.maximum(totals + kept, 1)
        p, absent = share(n, whole[at]), share(np.zeros(len(names), np.int64), whole)
        step = max(1, NUMBERS // len(names))
        for first in range(0, len(names), step):
            last = min(len(names), first + step)
            sums = _pair_sums(first, last, sizes, at, p, absent, n)
            g, h = (x.ravel() for x in np.indices(sums.shape))
            other = g + first != h
            yield batch_of(lang, names.take(pa.array((g + first)[other])), "pair", names.take(pa.array(h[other])), sums.ravel()[other])
        if not len(at):
            return
        term = np.repeat(np.arange(len(sizes)), sizes)
        in_lang = np.zeros(len(sizes), np.int64)
        np.add.at(in_lang, term, n)
        q = share(in_lang, max(1, int(totals.sum()) + kept))[term]
        up = np.flatnonzero(p > q)
        value = divergence(p[up], q[up])
        place = np.empty(len(terms), np.int64)
        place[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        order = np.lexsort((place[term[up]], -value, at[up]))
        source = at[up][order]
        start = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, np.int64)
        rank = np.arange(len(source)) - np.repeat(start, np.diff(np.append(start, len(source))))
        order = order[rank < most]
        yield batch_of(lang, names.take(pa.array(at[up][order])), "term", terms.take(pa.array(term[up][order])), value[order])

    def batch_of(lang, source, part, item, value) -> pa.RecordBatch:
        n = len(item)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def groups_of(lang: str) -> tuple:
        files = local_root(groups)[0]
        found = pa.concat_tables([pq.read_table(f, filesystem=files, filters=[("lang", "=", lang)]) for f in parts_of(groups)])
        found = found.sort_by("source")
        kept = found.column("kept").to_pylist()
        return found.column("source").combine_chunks().cast(pa.string()), found.column("total").to_numpy().astype(np.int64), kept[0] if kept else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        lang, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if lang not in known:
                known.clear()  # rows come sorted by language
                known[lang] = groups_of(lang)
            terms, sizes, sources, n = (pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*held))
            yield from score(lang, terms, sizes, sources, n, known[lang])

        for batch in batches:
            langs = pa.array(batch.column("lang")).dictionary_encode()
            codes = langs.indices.to_numpy()
            for a, b in zip(*(lambda cut: (np.append(0, cut), np.append(cut, len(codes))))(np.flatnonzero(codes[1:] != codes[:-1]) + 1)):
                if b == a:
                    continue
                own = batch.slice(a, b - a)
                name = own.column("lang")[0].as_py()
                if held and (name != lang or sum(len(x[3]) for x in held) > POSTINGS):
                    yield from done()
                    held = []
                lang = name
                has = own.column("term").is_valid()
                lists = own.column("postings").filter(has)
                flat = lists.flatten()
                held.append((own.column("term").filter(has).cast(pa.string()), np.diff(lists.offsets.to_numpy()).astype(np.int64), flat.field("source").cast(pa.string()), flat.field("n").to_numpy().astype(np.int64)))
        if held:
            yield from done()

    return run


def divergences(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources ('pair') and the terms ('term') of each source.

    Null texts, langs and sources are ''. A language keeps the terms in at least `least` of its rows
    (repeated rows count each). Pairs are there for every two sources of a language, with value 0 if it
    keeps no term; terms have rank `most` at most. Ranks go by value, then by the item's UTF-8. No rows
    give no rows. Exact while a language has under 9 * 10^15 words and 2 * 10^9 kept terms."""
    spark = prepare(docs.sparkSession)
    tables = Tables(spark, "audit")
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = texts.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    counts = tables.keep(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("postings"))
    postings = tables.keep(terms.where(F.col("df") >= least).select("lang", "term", "postings").sortWithinPartitions("lang"), "postings")
    totals = postings.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(postings.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    # one row a source of a language, which tasks read for the languages they meet
    groups = tables.keep(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept"))).repartition("lang").sortWithinPartitions("lang"), "groups")
    tables.drop("counts")
    every = groups.select("lang").distinct().select("lang", F.lit(None).cast("string").alias("term"), F.array().cast(postings.schema["postings"].dataType).alias("postings"))
    scores = postings.unionByName(every).mapInArrow(_compare(tables.path("groups"), most), "lang string, source string, part string, item string, value long")
    scores = tables.keep(scores, "scores")
    tables.only("scores")
    columns = ["lang", "source", "part", "item", "value"]
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.col("value").desc(), "item"))
    pairs = scores.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select(*columns, first("lang", "source").alias("rank"))
    # of a source's first terms by task, those of each salt, then those of all
    salted = scores.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(16)))
    salted = salted.withColumn("rank", first("lang", "source", "salt")).where(F.col("rank") <= most)
    return pairs.union(salted.select(*columns).withColumn("rank", first("lang", "source")).where(F.col("rank") <= most))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
s AS (SELECT lang, source, sum(c) AS total FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.c, (1 + (1000000000::HUGEINT * (x.c + 1)) // (s.total + v.v))::BIGINT AS p FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
l AS (SELECT x.lang, x.term, (1 + (1000000000::HUGEINT * (sum(x.c) + 1)) // (any_value(a.total) + any_value(v.v)))::BIGINT AS q
      FROM x JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY lang) a USING (lang) JOIN v USING (lang) GROUP BY x.lang, x.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q)) // l.q FROM p JOIN l USING (lang, term) WHERE p.c > 0 AND p.p > l.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
