"""MinHash near-dedup with sequential Bayesian verification.

Texts are sets of word shingles; texts with one set form a class. Of a class's signature of 256
minima the first 128 are banded by fours, and a band's bucket proposes candidates. A pair's
signatures are compared in batches: after each, a pair whose posterior chance of reaching the
similarity is under the miss probability is dropped. Survivors are verified on their full sets.

Large buckets are not expanded into pairs. Each takes as centre the class whose buckets are
largest, which near copies of one text mostly agree with; the buckets of one centre are a family,
which proposes centre-member pairs. Confirmed links give labels; a family of one label is done. In
others, the classes outside of the commonest label are compared with all classes of other labels,
block by block: a class is written once to a block's files in the shared folder (twice if it is
outside), and tasks read the blocks to compare one after the other, first signatures, then full
sets where any pass. Only links become rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mishap.llm.quality import pieces
from mishap.llm.shared import Tables, local_root, prepare, table, text_bytes

_U = np.uint64
#: A-Z to lower case, white space (0x20, 0x09-0x0D) to spaces.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 0x09 <= c <= 0x0D else c for c in range(256))


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.75  # links have 100 * intersection >= 75 * union
    bands: int = 32
    rows: int = 4  # a pair at the similarity shares no band with a chance of 5e-6
    places: int = 256  # minima of a signature
    batch: int = 64  # places compared at a time
    miss: float = 1e-4  # a pair is dropped when its chance to be a link is less than an equal part of this for each batch
    small: int = 8  # buckets of at most so many classes propose all their pairs
    block: int = 256  # classes in a block of a family,
    block_shingles: int = 1 << 20  # and about the most shingles of theirs
    range: int = 16  # blocks that a task compares with one, at least


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    text = np.frombuffer(b" " + b" ".join(t.translate(_BYTES) for t in texts) + b" ", np.uint8)
    edge = text == 0x20
    start = np.flatnonzero(~edge[1:] & edge[:-1]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not len(start):
        return out
    begin = np.zeros(len(text), np.int64)
    begin[start] = start
    place = (np.arange(len(text)) - np.maximum.accumulate(begin)).astype(np.uint64)
    codes = _mix(text.astype(np.uint64) + _U(257) * (place + _U(1)))
    codes[edge] = 0
    word = _mix(np.add.reduceat(codes, start))
    cuts = np.append(0, np.searchsorted(start, ends, "right"))
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b > a:
            n = min(words, b - a)
            h = np.full(b - a - n + 1, n, np.uint64)
            for k in range(n):
                h = h * _U(0x9E3779B97F4A7C15) + word[a + k : b - n + 1 + k]
            out[i] = np.unique(_mix(h))
    return out


def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    return (x[:n] >> _U(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> _U(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima (32 bits) of each nonempty set; rows of empty sets are 0."""
    out = np.zeros((len(sets), n), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        every = np.concatenate([sets[i] for i in some])
        x, y = (every >> _U(32)).astype(np.uint32), every.astype(np.uint32)
        first = np.append(0, np.cumsum([len(sets[i]) for i in some])[:-1])
        for k, (a, b) in enumerate(zip(*_hashers(n))):
            v = (x ^ b) * a
            v ^= v >> np.uint32(15)
            v += y
            v *= a
            out[some, k] = np.minimum.reduceat(v ^ (v >> np.uint32(16)), first)
    return out


def _sign(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in text_bytes(batch.column(1))]
            for part in pieces(texts):
                sets = shingles([texts[i] for i in part], s.words)
                sig = signatures(sets, s.places)
                wide = sig[:, : s.bands * s.rows].astype(np.uint64).reshape(len(part), s.bands, s.rows)
                band = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), wide.shape[:2]).copy()
                for k in range(s.rows):
                    band = _mix(band * _U(0x9E3779B97F4A7C15) + wide[:, :, k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part)),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([int(np.add.reduce(_mix(x)).view(np.int64)) for x in sets], pa.int64()),
                        pa.array([int(np.bitwise_xor.reduce(x, initial=0).view(np.int64)) for x in sets], pa.int64()),
                        pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in sig.astype(np.uint16)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
                )

    return run


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(places compared, matches needed to go on), batch by batch.

    Under a uniform prior, m matches of n leave the similarity a Beta(m + 1, n - m + 1) posterior;
    its chance of at least t is the chance that n + 1 throws of a coin t show m or fewer heads.
    The batches share the miss probability, as each may drop a pair."""
    out, t, looks = [], s.similarity, range(s.batch, s.places + 1, s.batch)
    for n in looks:
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= s.miss / len(looks):
                break
            m += 1
        out.append((n, m))
    return out


def _survivors(s: Settings):
    """Pairs that no batch of signature places rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = least_matches(s)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            left, done, hits = np.arange(batch.num_rows), 0, np.zeros(batch.num_rows, np.int64)
            for n, need in steps:
                hits[left] += (a[left, done:n] == b[left, done:n]).sum(1)
                left, done = left[hits[left] >= need], n
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], names=["a", "b"])

    return run


def _verify(s: Settings):
    """Links among (hub's text, texts of its partners)."""
    percent = round(100 * s.similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            a, b = text_bytes(batch.column("ta")), text_bytes(batch.column("tb"))
            good = []
            for i, hub in enumerate(ids[0]):
                if last[0] != hub:
                    last = (hub, shingles([a[i]], s.words)[0])
                other = shingles([b[i]], s.words)[0]
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                if both and 100 * both >= percent * (len(last[1]) + len(other) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def _shared(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets of a with sets of b, from products of 0-1 matrices of `width` columns."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    places = [[np.searchsorted(both, np.intersect1d(x, both, assume_unique=True)) for x in side] for side in (a, b)]
    for start in range(0, len(both), width):
        tables = []
        for side in places:
            t = np.zeros((len(side), width), np.float32)
            for i, x in enumerate(side):
                t[i, x[np.searchsorted(x, start) : np.searchsorted(x, start + width)] - start] = 1
            tables.append(t)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def _passing(a: tuple, b: tuple, s: Settings) -> list[np.ndarray]:
    """For each class of block a (ids, labels, signatures), places in b of those of other labels that pass the Bayesian test."""
    steps = least_matches(s)
    codes = {x: i for i, x in enumerate({*a[1], *b[1]})}
    la, lb = (np.array([codes[x] for x in labels]) for labels in (a[1], b[1]))
    out = []
    for i in range(len(la)):
        left = np.flatnonzero(lb != la[i])
        done, hits = 0, np.zeros(len(lb), np.int64)
        for n, need in steps:
            hits[left] += (b[2][left, done:n] == a[2][i, done:n]).sum(1)
            left, done = left[hits[left] >= need], n
        out.append(left)
    return out


#: Columns that name a block: its family, side (0: outside of the commonest label, 1: all) and number.
_PLACE = ["family", "side", "block"]


def _path(base: str, family: int, side: int, block: int, what: str) -> str:
    return f"{base}/{family}/{side}-{block}.{what}"


def _spool(folder: str, s: Settings):
    """Writes each block as two files, (id, label, sig) and the shingles of each class; (family, side, block, n). Rows come sorted by block."""

    def write(files, at: str, table: pa.Table) -> None:
        files.create_dir(at.rpartition("/")[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex}"  # a second attempt of the task writes the same
        with files.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema) as w:
            w.write_table(table)
        files.move(part, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_root(folder)

        def done(place: tuple, parts: list[pa.RecordBatch], sets: list[np.ndarray]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            write(files, _path(base, *place, "sig"), rows)
            write(files, _path(base, *place, "sets"), pa.table({"set": pa.array(sets, pa.large_list(pa.uint64()))}))
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in place), pa.array([rows.num_rows], pa.int64())], names=[*_PLACE, "n"])

        at, parts, sets = None, [], []
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in _PLACE)))
            start = 0
            while start < len(places):
                end = next((i for i in range(start, len(places)) if places[i] != places[start]), len(places))
                if at is not None and at != places[start]:
                    yield done(at, parts, sets)
                    parts, sets = [], []
                at, own = places[start], batch.slice(start, end - start)
                parts.append(own.select(["id", "label", "sig"]))
                texts = [t or b"" for t in text_bytes(own.column("text"))]
                sets += chain.from_iterable(shingles([texts[i] for i in rows], s.words) for rows in pieces(texts))
                start = end
        if at is not None:
            yield done(at, parts, sets)

    return run


def _block_links(folder: str, s: Settings, kind: pa.DataType):
    """Links between blocks: pairs of different labels that pass the Bayesian test and the full sets.

    A row (family, ob, first, last) is a block outside of the commonest label and a range of the
    family's blocks, which are read one after the other. Of a class's links to one label the first
    will do, as the label's classes are linked."""
    percent = round(100 * s.similarity)

    def read(files, at: str) -> pa.Table | None:
        if files.get_file_info(at).type == fs.FileType.NotFound:  # no class has this block's number
            return None
        with files.open_input_file(at) as f:
            return pa.ipc.open_file(f).read_all()

    def block(files, at: str) -> tuple | None:
        t = read(files, at)
        return t and (t.column("id").to_pylist(), t.column("label").to_pylist(), np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, -1))

    def sets_of(files, at: str) -> list[np.ndarray]:
        column = read(files, at).column("set").combine_chunks()
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy()
        return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]

    def links(files, base: str, family: int, ob: int, first: int, last: int) -> Iterator[tuple]:
        a, own = block(files, _path(base, family, 0, ob, "sig")), None
        if a is None:
            return
        linked: list[set] = [set() for _ in a[0]]
        for mb in range(first, last):
            b = block(files, _path(base, family, 1, mb, "sig"))
            passed = _passing(a, b, s) if b else []
            passed = [np.array([j for j in x.tolist() if b[1][j] not in linked[i]], np.int64) if linked[i] else x for i, x in enumerate(passed)]
            rows_a = np.array([i for i, x in enumerate(passed) if len(x)], np.int64)
            if not len(rows_a):
                continue
            rows_b = np.unique(np.concatenate(passed))
            own = own or sets_of(files, _path(base, family, 0, ob, "sets"))
            other = sets_of(files, _path(base, family, 1, mb, "sets"))
            sets = [own[i] for i in rows_a], [other[j] for j in rows_b]
            both = _shared(*sets)
            union = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[1]]) - both
            good = (both > 0) & (100 * both >= percent * union)
            for k, i in enumerate(rows_a.tolist()):
                for j in passed[i][good[k, np.searchsorted(rows_b, passed[i])]].tolist():
                    if b[1][j] not in linked[i]:
                        linked[i].add(b[1][j])
                        yield a[0][i], b[0][j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_root(folder)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("family", "ob", "first", "last"))):
                found = list(links(files, base, *row))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=kind) for i in (0, 1)], names=["a", "b"])

    return run


def components(tables: Tables, links: DataFrame, name: str) -> DataFrame:
    """(id, label) of the ids in links (a, b): label is the smallest id reachable.

    Large stars and small stars in turn: each sends a node's neighbours to the smallest around it,
    so that rows stay as many as links, until every link goes to the smallest id of its component:
    no id is both an end and a start, and none starts two links."""
    edges = tables.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}_edges")
    step = 0
    while True:
        # large star: the larger neighbours of a node go to the smallest of its neighbours and itself
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tables.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_low{step}")
        large = tables.keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}_large{step}")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = tables.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_least{step}")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = tables.keep(small.distinct(), f"{name}_star{step}")
        forked = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if forked.isEmpty() and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        step += 1
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("id"), "label").distinct())


def _confirm(tables: Tables, docs: DataFrame, pairs: DataFrame, s: Settings, name: str) -> DataFrame:
    """The pairs (a, b) whose texts' full sets are as similar as links need be."""
    kind = pairs.schema["a"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return tables.keep(both.mapInArrow(_verify(s), f"a {kind}, b {kind}"), name)


def _links(tables: Tables, docs: DataFrame, heads: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links between classes (id, n_shingles, bands, sig) that join whatever links join.

    What goes by id is one row a class: its buckets travel as an array and are exploded where
    they are summed or joined by key."""
    kind = heads.schema["id"].dataType.simpleString()
    rows = heads.select("id", F.explode("bands").alias("key"))
    counts = tables.keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    rows = tables.keep(rows.join(counts, "key"), "buckets")
    few = rows.where(F.col("n") <= s.small).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    few = few.select("ids", F.posexplode("ids").alias("at", "a")).select("a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b"))
    # a class has at most as many keys as bands
    large = rows.groupBy("id").agg(F.sum("n").alias("degree"), F.collect_list(F.when(F.col("n") > s.small, F.col("key"))).alias("keys"))
    large = tables.keep(large.where(F.size("keys") > 0), "large").select("id", "degree", F.explode("keys").alias("key"))
    centre = tables.keep(large.groupBy("key").agg(F.max(F.struct("degree", "id")).alias("c")).select("key", F.col("c.id").alias("centre")), "centre")
    # buckets of one centre are one family, so that a pair meets once and not once in every bucket
    family = tables.keep(large.join(centre, "key").select("centre", "id").distinct(), "family")
    stars = family.where("id != centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    pairs = tables.keep(few.union(stars).distinct(), "pairs")
    sig = heads.select("id", "sig")
    signed = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    passed = tables.keep(signed.mapInArrow(_survivors(s), f"a {kind}, b {kind}").distinct(), "passed")
    links = _confirm(tables, docs, passed, s, "links")
    if family.isEmpty():
        return links
    own = heads.join(components(tables, links, "early"), "id", "left").select("id", F.col("n_shingles").alias("size"), "sig", F.coalesce("label", "id").alias("label"))
    labelled = tables.keep(family.join(own, "id"), "labelled")
    each = labelled.groupBy("centre", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    undone = each.groupBy("centre").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most")).where("labels > 1")
    part = lambda n, size: F.ceil(F.greatest(n / s.block, size / s.block_shingles)).cast("int")
    outside = part(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"))
    undone = tables.keep(undone.select("centre", F.monotonically_increasing_id().alias("family"), F.col("most.label").alias("giant"), outside.alias("obs"), part(F.col("n"), F.col("size")).alias("mbs")), "undone")
    if undone.isEmpty():
        return links
    # a class is written once or twice, to files that tasks read one after the other: no row is repeated for a partner block
    rest = labelled.join(undone, "centre").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("long")
    side = lambda k, n: F.struct(F.lit(k).cast("long").alias("side"), block(F.col(n)).alias("block"))
    places = F.when(F.col("label") != F.col("giant"), F.array(side(0, "obs"), side(1, "mbs"))).otherwise(F.array(side(1, "mbs")))
    rest = rest.select("family", "id", "label", "sig", "text", F.inline(places)).repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    folder = tables.path("block_files")
    tables.keep(rest.select(*_PLACE, "id", "label", "sig", "text").mapInArrow(_spool(folder, s), "family long, side long, block long, n long"), "blocks")
    # a task's range of blocks grows with their number, so that there are no more ranges than classes
    step = F.greatest(F.lit(s.range), F.ceil(F.col("mbs") / s.block)).cast("int")
    ranges = undone.select("family", F.explode(F.sequence(F.lit(0), F.col("obs") - 1)).alias("ob"), "mbs", step.alias("step"))
    ranges = ranges.select("family", "ob", "mbs", "step", F.explode(F.sequence(F.lit(0), F.col("mbs") - 1, F.col("step"))).alias("first"))
    ranges = tables.keep(ranges.select("family", "ob", "first", F.least(F.col("first") + F.col("step"), "mbs").alias("last")).repartition("family", "ob", "first"), "ranges")
    found = ranges.mapInArrow(_block_links(folder, s, to_arrow_type(heads.schema["id"].dataType)), f"a {kind}, b {kind}")
    found = tables.keep(found.distinct(), "links_blocks")
    tables.drop("block_files")
    return links.union(found)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept.

    Null and wordless texts have no shingles, are linked with nothing and are components of their
    own. A text of fewer words than a shingle is one shingle. component_id is the smallest doc_id
    reachable and kept marks rows with that id. Rows with shingles that repeat a doc_id are one node
    of the graph, linked by any of their texts. A null doc_id takes no part: null component, kept.

    The graph is one of classes, of which each is its smallest doc_id; copies get their class's label."""
    spark, s = prepare(docs.sparkSession), settings
    tables = Tables(spark, "minhash")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(_sign(s), f"doc_id {kind}, n_shingles long, h1 long, h2 long, bands array<long>, sig binary")
    signed = tables.keep(signed, "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    one = ["h1", "h2", "n_shingles"]
    heads = tables.keep(some.groupBy(*one).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "heads")
    links = _links(tables, docs.where("doc_id is not null"), heads, s)
    # an id with several sets links their classes
    several = some.groupBy("doc_id").agg(F.min(F.struct(*one)).alias("low"), F.max(F.struct(*one)).alias("high")).where("low != high")
    several = tables.keep(several.select("doc_id"), "several")
    if not several.isEmpty():
        classes = some.join(several, "doc_id").join(heads.select("id", *one), one).select("doc_id", "id").distinct()
        links = links.union(classes.join(classes.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b"))
    labels = components(tables, links, "final")
    labels = tables.keep(heads.select("id", *one).join(labels, "id", "left").select(*one, F.coalesce("label", "id").alias("label")), "labels")
    tables.only("signed", "labels")
    out = signed.select("doc_id", *one).join(labels, one, "left")
    label = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("label")), "doc_id")
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(label == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The pairs of all documents that share a shingle, and what is reached from each.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(1, len(l) - 4) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(m) AS label FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(label, w.doc_id) AS component_id, coalesce(label, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id
"""


def brute_force(texts: dict[object, str | None], words: int = 5) -> dict[object, tuple[int, object, bool]]:
    """doc_id to (n_shingles, component_id, kept), from the links of all pairs; for tests."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(_BYTES).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    where: dict[tuple, list] = {}
    for i in ids:
        shared: dict[object, int] = {}
        for x in sets[i]:
            for j in where.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            where[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
