"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every row gets a 56-bit hash. A source whose target is k whole copies and a remainder r takes
every document k times, and once more those whose hash is under a threshold. The threshold comes
from nested histograms: words by (source, leading byte of the hash); the bucket where the running
sum passes r is the boundary; only its rows are summed by the next byte, and so on. Nothing is
sorted but 256 buckets a source and the table of sources, one row each, whose targets are computed
in one task; each round reads about 1/256 of the rows of the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishap.llm.shared import SPACE_WORD, Tables, table

LEVELS = 7  # bytes of the hash


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Shares the sum of all sizes by weight, no source above `most` times its own size.

    sizes: (key, source, source_size), a row a source. Sources by code point (null last) take the
    weights in turn. The excess of capped sources goes to the others by weight until none is above:
    in order of cap / weight, all sources before the first that its share doesn't fill are capped.
    The order is of all sources: they meet in one task.
    Adds target double. No rows give no rows; when all sizes are 0 every target is 0."""
    every = Window.orderBy(F.col("source").asc_nulls_last(), "key")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("left", left).withColumn("rest", F.sum("w").over(after))
    free = F.col("cap").cast("double") * F.col("rest") >= F.col("w").cast("double") * F.col("left")
    # of all sources that aren't capped, the first sets the level
    level = level.withColumn("at", F.when(free, F.struct("left", "rest"))).withColumn("at", F.first("at", ignorenulls=True).over(whole)).withColumn("free", free)
    ever = F.max(F.when(F.col("free"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = (F.col("w") * F.col("at.left")).cast("double") / F.col("at.rest").cast("double")
    target = F.when(ever == 1, F.least(share, F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return level.select("key", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, keep: list[str] | None = None) -> DataFrame:
    """One row a row of docs: `keep` (doc_id by default), size, source_size, target, taken.

    taken is size times k or k + 1, at most `most`. A null text has size 0 and is never taken; null
    sources form one source; rows that repeat a doc_id share a hash and are taken alike. Reruns
    agree, as the hash is of doc_id alone. A source's taken words miss its target by at most half of
    the words of the one hash at the boundary. Other columns of docs are not read. `keep` names columns
    to hand on: they are read again at the end and joined with one row a source, not stored between."""
    spark = docs.sparkSession
    tables = Tables(spark, "mix")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2 * LEVELS), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    sized = tables.keep(docs.select("doc_id", "source", size.alias("size"), h.alias("h"), key.alias("key")), "sized")
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    full = tables.keep(targets(sources, weights, most), "targets")
    k = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    full = full.withColumn("k", k.cast("long")).withColumn("need", F.greatest(F.col("target") - F.col("k") * F.col("source_size"), F.lit(0.0)))

    # bound: of each source, the boundary bucket so far (its leading bytes) and the words under it
    bound = full.select("key", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    rows = sized.where("size > 0").select("key", "h", "size")
    by = Window.partitionBy("key").orderBy("bucket")
    for level in range(LEVELS):
        shift = 8 * (LEVELS - 1 - level)
        inside = rows.join(bound, "key").where(F.shiftright("h", shift + 8) == F.col("prefix"))
        if level:
            inside = tables.keep(inside.select(*rows.columns, "need", "prefix", "below"), f"rows{level}")
            rows = inside.select(*rows.columns)
            if level > 1:
                tables.drop(f"rows{level - 1}")
        found = inside.groupBy("key", "need", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.min("h").alias("first"), F.max("h").alias("last"))
        found = found.withColumn("upto", F.col("below") + F.sum("s").over(by)).where("upto > need")
        found = found.groupBy("key", "need").agg(F.min(F.struct("bucket", "upto", "s", "first", "last")).alias("b"))
        found = found.select("key", "need", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.s")).alias("below"), F.col("b.s").alias("s"), (F.col("b.first") < F.col("b.last")).alias("several"))
        bound = tables.keep(found, f"bound{level}")
        if bound.where("several").isEmpty():
            break
    # one hash is left in each boundary bucket: taken if that comes nearer to the need
    near = F.when(2 * (F.col("need") - F.col("below")) > F.col("s"), 1).otherwise(0)
    cut = bound.select("key", ((F.col("prefix") + near) * F.lit(1 << shift)).alias("cut"), F.col("prefix").alias("last"), near.alias("near"))
    # one row a source, written so that the planner knows how small it is
    each = tables.keep(full.select("key", "source_size", "target", "k").join(cut, "key", "left"), "sources")
    tables.only("sources", *(["sized"] if keep is None else []))
    rows = sized if keep is None else docs.select(*keep, size.alias("size"), h.alias("h"), key.alias("key"))
    out = rows.join(each, "key")
    once_more = F.coalesce(F.col("h") < F.col("cut"), F.lit(False)).cast("long")
    return out.select(*(keep or ["doc_id"]), "size", "source_size", "target", (F.col("size") * (F.col("k") + once_more)).alias("taken"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 14))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, row_number() OVER o AS rn,
        (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT lft, rest, rn FROM l WHERE cap::DOUBLE * rest >= w::DOUBLE * lft ORDER BY rn LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN l.rn >= f.rn THEN least((l.w * f.lft)::DOUBLE / f.rest::DOUBLE, l.cap::DOUBLE) ELSE l.cap::DOUBLE END AS target FROM l CROSS JOIN f),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS k FROM t),
g AS (SELECT source, h, sum(size) AS s FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT g.*, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
b AS (SELECT c.source, min(c.h) AS h FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source WHERE c.upto > greatest(k.target - k.k * k.source_size, 0) GROUP BY c.source),
x AS (SELECT c.source, c.h, CASE WHEN 2 * (greatest(k.target - k.k * k.source_size, 0) - (c.upto - c.s)) > c.s THEN 1 ELSE 0 END AS near
      FROM b JOIN c ON c.source IS NOT DISTINCT FROM b.source AND c.h = b.h JOIN k ON k.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, k.source_size, k.target, (d.size * (k.k + CASE WHEN d.h < x.h + x.near THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source
"""
