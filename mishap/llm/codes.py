"""Vector codes: product quantization with codebooks from Lloyd rounds in Elkan's manner.

Vectors are cut into parts; each part position has a codebook. A round assigns every part to its
nearest entry and moves the entries to the means of their parts. Between rounds each vector's row
keeps, for every part, an upper bound of the distance to its entry and one lower bound of the
distance to each entry. Moved entries shift the bounds by their movement; an entry whose lower
bound, or whose half distance from the assigned entry, is strictly above the upper bound can be
neither nearer nor a tie and is skipped. For the others distances are computed in whole numbers, and ties go
to the lower entry.

Rows live in a table of the shared folder, which the next round reads: the only things that pass
the driver are codebooks, whose size doesn't depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm.shared import Tables, prepare, table
from mishap.llm.topk import MOST, _matrix

#: Components beyond this size count as this.
SATURATE = 1 << 60
#: Bounds come from rounded square roots; an entry is skipped only where they are apart by more than this part of themselves.
SLACK = 1e-9
#: Labels with at least this part of all rows are joined by broadcast: there are at most 1 / HOT of them.
HOT = 1 / 1000


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64  # at most 256, as a code has two hex digits
    rounds: int = 2
    scale: int = 256


def finite(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    inf = F.lit(float("inf"))
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < inf), F.lit(False))))


def _whole(column, width: int, s: Settings) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros; as int64 where squared distances fit, else as Python's whole numbers."""
    q = _matrix(column, width * s.parts, s.scale)
    most = int(np.abs(q).max(initial=0)) if q.size else 0
    if 4 * most * most * max(1, width) < 1 << 62:
        return q.astype(np.int64)
    return np.clip(q.astype(object), -SATURATE, SATURATE)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all entries."""
    out = np.zeros((len(x), len(entries)), object if object in (x.dtype, entries.dtype) else np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Codebooks:
    """The entries of each part position, and what rounds derive from them."""

    entries: list[np.ndarray]

    def __post_init__(self) -> None:
        if any(int(np.abs(e).max(initial=0)) >= 1 << 28 for e in self.entries if e.size):
            self.entries = [e.astype(object) for e in self.entries]
        self.between = [_root(_distances(e, e)) for e in self.entries]
        # lower bounds are kept in units of which 255 span twice the codebook
        self.units = [max(b.max(initial=0.0) * 2 / 255, 1.0 / 255) for b in self.between]

    def moved(self, before: Codebooks) -> list[np.ndarray]:
        return [_root(((a - b).astype(object) ** 2).sum(1)) if a.size else np.zeros(len(a)) for a, b in zip(self.entries, before.entries)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def nearest(x: np.ndarray, p: int, books: Codebooks, kept: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, upper bounds, lower bounds, distances computed) of the parts x at position p.

    kept: (entries, upper bounds, lower bounds) of the round before, shifted by movement."""
    entries, n = books.entries[p], np.arange(len(x))
    if kept is None:
        d = _distances(x, entries)
        at = d.argmin(1) if len(x) else np.zeros(0, np.int64)
        low = _root(d)
        return at, low[n, at], low, np.full(len(x), len(entries), np.int64)
    at, up, low = kept
    at, up, low, cost = at.copy(), up.copy(), low.copy(), np.zeros(len(x), np.int64)

    def open_pairs(rows: np.ndarray) -> np.ndarray:
        bound = np.maximum(low[rows], books.between[p][at[rows]] / 2)
        maybe = bound * (1 - SLACK) <= (up[rows] * (1 + SLACK))[:, None]
        maybe[np.arange(len(rows)), at[rows]] = False
        return maybe

    rows = np.flatnonzero(open_pairs(n).any(1))
    if not len(rows):
        return at, up, low, cost
    # the distance to the assigned entry makes the upper bound exact, which closes more pairs
    own = ((x[rows] - entries[at[rows]]) ** 2).sum(1)
    up[rows] = low[rows, at[rows]] = _root(own)
    cost[rows] += 1
    maybe = open_pairs(rows)
    i, j = np.nonzero(maybe)
    d = np.full(maybe.shape, (1 << 62) if own.dtype != object else (1 << 200), own.dtype)
    d[np.arange(len(rows)), at[rows]] = own
    d[i, j] = found = ((x[rows[i]] - entries[j]) ** 2).sum(1)
    low[rows[i], j] = _root(found)
    cost[rows] += maybe.sum(1)
    at[rows] = d.argmin(1)
    up[rows] = _root(d[np.arange(len(rows)), at[rows]])
    return at, up, low, cost


def _assign(width: int, s: Settings, books: Codebooks, moved: list[np.ndarray] | None, units: list[float] | None, last: bool):
    """One round over rows (vec_id, label, embedding, and from the second round on code, upper, lower, cost)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books.entries[0])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = _whole(batch.column("embedding"), width, s)
            code, upper, lower = np.zeros((n, s.parts), np.uint8), np.zeros((n, s.parts), np.float32), np.zeros((n, s.parts, k), np.uint8)
            cost, error = np.zeros(n, np.int64), np.zeros(n, object)
            if moved is not None:
                old, up, low = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(shape) for c, t, shape in (("code", np.uint8, (n, -1)), ("upper", np.float32, (n, -1)), ("lower", np.uint8, (n, s.parts, k))))
                cost += batch.column("cost").to_numpy()
            for p in range(s.parts):
                x, kept = q[:, p * width : (p + 1) * width], None
                if moved is not None:
                    at = old[:, p].astype(np.int64)
                    kept = (at, up[:, p].astype(np.float64) + moved[p][at], np.maximum(low[:, p] * units[p] - moved[p], 0))
                at, u, l, c = nearest(x, p, books, kept)
                code[:, p], cost = at, cost + c
                if last:
                    error += ((x - books.entries[p][at]) ** 2).sum(1)
                else:
                    upper[:, p] = np.nextafter(u.astype(np.float32), np.float32(np.inf))
                    lower[:, p] = np.minimum(l * (1 - SLACK) / books.units[p], 255)
            columns = [batch.column("vec_id"), batch.column("label")]
            if last:
                columns += [pa.array([x.tobytes().hex() for x in code]), pa.array([min(int(e), MOST) for e in error.tolist()], pa.int64()), pa.array(cost)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "cost"])
            else:
                columns += [batch.column("embedding"), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (code, upper, lower)), pa.array(cost)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "embedding", "code", "upper", "lower", "cost"])

    return run


def _sums(width: int, s: Settings, entries: int):
    """A task's sums of parts by (part, entry, position), with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s.parts, entries, width), object)
        count = np.zeros((s.parts, entries), np.int64)
        for batch in batches:
            q = _whole(batch.column("embedding"), width, s)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for p in range(s.parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                own = np.zeros((entries, width), q.dtype)
                np.add.at(own, code[:, p], q[:, p * width : (p + 1) * width])
                total[p] += own
        at = np.argwhere(count > 0).repeat(width, axis=0)
        place = np.tile(np.arange(width), len(at) // width)
        sums = total[at[:, 0], at[:, 1], place].tolist() if len(at) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(place, pa.int32()), pa.array([int(x) for x in sums], pa.decimal128(38, 0)), pa.array(count[at[:, 0], at[:, 1]], pa.int64())],
            names=["part", "entry", "place", "total", "n"],
        )

    return run


def _moved_to_means(rows: DataFrame, width: int, s: Settings, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floored means of their parts; entries without parts stay."""
    out = [e.astype(object) for e in books.entries]
    sums = rows.select("embedding", "code").mapInArrow(_sums(width, s, len(out[0])), "part int, entry int, place int, total decimal(38,0), n long")
    # one row a component of a codebook
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part][r.entry, r.place] = int(r.total) // r.n
    return Codebooks([e if any(abs(x) >= 1 << 28 for x in e.ravel()) else e.astype(np.int64) for e in out])


def compress(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a kept row of vectors: vec_id, code, error, label_error, codebooks_sha256, and cost (distances computed).

    Rows whose vector is null or holds null, infinite or undefined components are dropped. Codebooks
    start as the parts of the rows with the smallest vec_ids (null last; repeated ids by vector), of
    as many as there are. Vectors of fewer components than the longest, or than a multiple of the
    parts, are filled up with zeros (empty ones to a zero a part); components beyond 2^60 count as that. Repeated rows count each.
    error and label_error stop at 2^63 - 1. Rows with a null label share one sum. No rows give no rows."""
    spark, s = prepare(vectors.sparkSession), settings
    tables = Tables(spark, "codes")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    embedding = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = finite(vectors.select("vec_id", "label", embedding.alias("embedding")))
    width = -(-(rows.agg(F.max(F.size("embedding"))).first()[0] or 1) // s.parts)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(s.entries).select("embedding").toArrow().column(0).combine_chunks()
    q = _whole(start, width, s)
    books = Codebooks([q[:, p * width : (p + 1) * width] for p in range(s.parts)])
    same = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    between = f"{same}, embedding {rows.schema['embedding'].dataType.simpleString()}, code binary, upper binary, lower binary, cost long"
    moved = units = None
    for r in range(s.rounds):
        rows = tables.keep(rows.mapInArrow(_assign(width, s, books, moved, units, False), between), f"round{r}")
        tables.only(f"round{r}")
        after = _moved_to_means(rows, width, s, books)
        moved, units, books = after.moved(books), books.units, after
    key = F.coalesce(F.concat(F.lit("s"), F.col("label").cast("string")), F.lit("n"))
    rows = tables.keep(rows.mapInArrow(_assign(width, s, books, moved, units, True), f"{same}, code string, error long, cost long").withColumn("key", key), "assigned")
    each = rows.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    each = tables.keep(each.select("key", F.least("total", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"), "n"), "labels")
    tables.only("assigned", "labels")
    # a label may hold a third of all rows: such labels don't go through a shuffle by label
    hot = each.where(F.col("n") >= HOT * rows.count()).select("key", "label_error")
    out = rows.join(F.broadcast(hot), "key").unionByName(rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(each.select("key", "label_error"), "key"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "cost")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("cost")


def brute_force(rows: list[tuple], s: Settings = Settings()) -> list[tuple]:
    """(vec_id, code, error, label_error, codebooks_sha256) of rows (vec_id, vector, label), entry by entry; for tests."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // s.parts) or 1
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(s.scale * float(x))) for x in r[1]] + [0] * (width * s.parts - len(r[1])) for r in rows]
    split = [[tuple(x[p * width : (p + 1) * width]) for p in range(s.parts)] for x in whole]
    books = [[x[p] for x in split[: s.entries]] for p in range(s.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, p: min(range(len(books[p])), key=lambda e: (far(part, books[p][e]), e))
    for _ in range(s.rounds):
        at = [[best(x[p], p) for p in range(s.parts)] for x in split]
        for p in range(s.parts):
            for e in range(len(books[p])):
                own = [x[p] for x, a in zip(split, at) if a[p] == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    at = [[best(x[p], p) for p in range(s.parts)] for x in split]
    errors = [sum(far(x[p], books[p][a[p]]) for p in range(s.parts)) for x, a in zip(split, at)]
    by_label: dict = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for e in a), min(err, MOST), min(by_label[r[2]], MOST), digest) for r, a, err in zip(rows, at, errors)]


_STEP = """
d{r} AS (SELECT v.rn, v.p, c.e, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (p, i) GROUP BY ALL),
a{r} AS (SELECT rn, p, min(d * 64 + e) % 64 AS e, min(d) AS d FROM d{r} GROUP BY ALL),"""
_MOVE = """
s{r} AS (SELECT a.p, a.e, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v USING (rn, p) GROUP BY ALL),
c{n} AS (SELECT c.p, c.e, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (p, e, i)),"""
OP11_SQL = (
    """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, embedding AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
w AS (SELECT greatest((max(len(x)) + 15) // 16, 1)::BIGINT AS w FROM k),
u AS (SELECT rn, unnest(x)::DOUBLE AS x, generate_subscripts(x, 1) - 1 AS pos FROM k),
z AS (SELECT rn, unnest(range(0, 16 * w)) AS pos FROM k, w),
v AS MATERIALIZED (SELECT rn, pos // w AS p, pos % w AS i, coalesce(floor(256 * u.x), 0)::BIGINT AS x FROM z LEFT JOIN u USING (rn, pos), w),
c0 AS (SELECT p, rn - 1 AS e, i, x FROM v WHERE rn <= 64),"""
    + _STEP.format(r=0)
    + _MOVE.format(r=0, n=1)
    + _STEP.format(r=1)
    + _MOVE.format(r=1, n=2)
    + _STEP.format(r=2)
    + """
o AS (SELECT rn, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM c2) AS codebooks_sha256
FROM k JOIN o USING (rn)
"""
)
