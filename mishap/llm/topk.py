"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Each task holds a block of vectors, with a list of its rows in order for every dimension. A query
walks the lists from the side that its component favours, all to the same depth, and scores the
rows it meets for the first time. What it has not met scores at most the sum of its components
times the values at that depth: when this bound is below the kth best score so far, the block is
done. Queries are a table of files of bounded size in the shared folder: a task reads one after the
other for each of its blocks. The best rows of each (query, block) are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishap.llm.shared import Tables, local_root, parts_of, prepare, table

#: Components of a block of vectors and rows of a file of queries, at most; first depth of the lists (doubled on the way).
BLOCK, QUERIES, DEPTH = 1 << 20, 2048, 16
MOST = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with components as doubles, of rows with an id and a vector of finite components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    inf = F.lit(float("inf"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < inf), F.lit(False)))
    return vectors.where(fine).select("vec_id", x.alias("x"))


def _matrix(column, dim: int, scale: int) -> np.ndarray:
    """Rows floor(scale * x) of a list column, as int64 or, where these don't fit, as Python's whole numbers; shorter vectors are filled up with zeros."""
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if np.abs(flat).max(initial=0) < (1 << 52) / scale:
        flat = np.floor(flat * scale).astype(np.int64)
    else:  # a double of 2^52 or more is a whole number
        flat = np.array([int(x) * scale if abs(x) >= 1 << 52 else int(np.floor(x * scale)) for x in flat.tolist()], object)
    if len(counts) and (counts == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(counts), dim), flat.dtype)
    first = np.append(0, np.cumsum(counts)[:-1])
    for i, (a, n) in enumerate(zip(first, counts)):
        out[i, :n] = flat[a : a + n]
    return out


def _saturated(score: int) -> int:
    return max(-MOST - 1, min(MOST, int(score)))


def threshold_top(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """(per query the k pairs (-score, id) that come first, rows scored in all). Scores and bounds saturate to 64 bits."""
    n, dim = x.shape
    order = np.argsort(x, axis=0, kind="stable")  # the list of dimension j: order[:, j], ascending
    ranked = np.take_along_axis(x, order, axis=0)
    most = dim * (int(np.abs(x).max(initial=0)) + 1) * (int(np.abs(queries).max(initial=0)) + 1)
    exact = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object  # sums of products stay whole numbers
    rows, best, scored = x.astype(exact), [], 0
    for i, q in enumerate(queries):
        seen = ids == query_ids[i]
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        weights = q.astype(exact)
        top: list[tuple[int, int]] = []
        at, depth = 0, DEPTH
        while at < n:
            to = min(n, depth)
            met = np.concatenate([order[n - to : n - at, up].ravel(), order[at:to, down].ravel()])
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            if to == n or not len(up) + len(down):
                new = np.flatnonzero(~seen)
                to = n
            seen[new] = True
            scored += len(new)
            scores = rows[new] @ weights
            if exact is object:
                scores = np.array([_saturated(s) for s in scores], object)
            if len(top) == k:
                good = scores >= -top[-1][0]
                new, scores = new[good], scores[good]
            if len(new) > k:  # all that could be among the k, ties too
                least = np.partition(scores, len(new) - k)[len(new) - k]
                new, scores = new[scores >= least], scores[scores >= least]
            top = sorted([*top, *((-int(s), r) for s, r in zip(scores.tolist(), ids[new].tolist()))])[:k]
            if to < n and len(top) == k:
                bound = (ranked[n - to, up].astype(exact) * weights[up]).sum() + (ranked[to - 1, down].astype(exact) * weights[down]).sum()
                if _saturated(bound) < -top[-1][0]:
                    break
            at, depth = to, 2 * depth
        best.append(top)
    return best, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries its k best rows of vectors.

    Both have (vec_id, embedding). Rows with the query's own id are no candidates, ties go to the
    smaller vec_id, rows that repeat an id count each; with fewer candidates all are returned. Rows
    with a null id, or a vector that is null or has null or non-finite components, take no part;
    shorter vectors count as filled up with zeros. Components are whole numbers of any size; a score
    beyond 64 bits is the largest or smallest long, and such scores tie."""
    spark = prepare(vectors.sparkSession)
    tables = Tables(spark, "topk")
    usable(queries).write.option("maxRecordsPerFile", QUERIES).parquet(tables.path("queries"))
    base, asked, at = tables.keep(usable(vectors), "base"), spark.read.parquet(tables.path("queries")), tables.path("queries")
    dim = max(base.agg(F.max(F.size("x"))).first()[0] or 0, asked.agg(F.max(F.size("x"))).first()[0] or 0)
    block = max(1, BLOCK // max(1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = local_root(at)
        held: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            x, who = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            for name in parts_of(at):
                t = pq.read_table(name, filesystem=files).combine_chunks()
                if t.num_rows:
                    query_ids = t["vec_id"].to_numpy()
                    best, _ = threshold_top(x, who, _matrix(t["x"].chunk(0), dim, scale), query_ids, k)
                    flat = [(int(q), r, -s) for q, top in zip(query_ids.tolist(), best) for s, r in top]
                    if flat:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], names=["query_id", "vec_id", "score"])
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                if held and sum(len(h[1]) for h in held) + part.num_rows > block:
                    yield from found()
                held.append((_matrix(pa.concat_arrays([part.column(1)]), dim, scale), part.column(0).to_numpy(zero_copy_only=False)))
        if held:
            yield from found()

    best = base.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
