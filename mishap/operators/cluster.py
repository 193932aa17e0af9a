"""Families of records across projects, their samples and page slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishap.functions.rules import GUIDES, guides_for, is_generic
from mishap.functions.text import cluster_slug, json_strings
from mishap.schema import VERSION
from mishap.storage import scratch


def members(records: DataFrame) -> DataFrame:
    """A row for each family of a record: its code, else its class; and its tag. One scan for all kinds."""
    coded = F.coalesce(F.col("errorCode"), F.lit("")) != ""
    kinds = [
        F.when(coded, F.struct(F.lit("code").alias("kind"), F.col("errorCode").alias("value"))),
        F.when(~coded & (F.col("errorClass") != ""), F.struct(F.lit("class").alias("kind"), F.col("errorClass").alias("value"))),
        F.when(F.col("backgroundTag") != "", F.struct(F.lit("tag").alias("kind"), F.col("backgroundTag").alias("value"))),
    ]
    return records.withColumn("m", F.explode(F.array_compact(F.array(*kinds)))).select("*", "m.kind", "m.value").drop("m")


def clusters(records: DataFrame, min_errors: int = 5, min_repos: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """(key, kind, value, errorCount, repoCount) of families with enough records in enough projects.

    Distinct projects are counted from counts by (family, project), so that a hot family is
    summed before it moves."""
    rows = members(records.select("repo", "errorCode", "errorClass", "backgroundTag"))
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    each = rows.groupBy("kind", "value", "repo").agg(F.count("*").alias("n"))
    out = each.groupBy("kind", "value").agg(F.sum("n").alias("errorCount"), F.count("repo").alias("repoCount"))
    out = out.where((F.col("errorCount") >= min_errors) & (F.col("repoCount") >= min_repos))
    return out.select(F.concat_ws(":", "kind", "value").alias("key"), "kind", "value", "errorCount", "repoCount")


def new_clusters(records: DataFrame, pages: DataFrame, min_errors: int = 5, min_repos: int = 2, limit: int | None = None) -> DataFrame:
    """Families without a page (clusterKey) that aren't too general, the largest first."""
    found = clusters(records, min_errors, min_repos).join(pages.select(F.col("clusterKey").alias("key")), "key", "left_anti")
    found = found.where((F.col("kind") == "code") | ~is_generic(F.col("value"))).orderBy(F.desc("errorCount"), "key")
    return found.limit(limit) if limit else found


def samples(records: DataFrame, chosen: DataFrame, limit: int = 30) -> DataFrame:
    """The best documented records of each chosen family (key, kind, value), clipped for a prompt."""
    rows = members(records).join(chosen.select("key", "kind", "value"), ["kind", "value"])
    order = Window.partitionBy("key").orderBy(F.desc(F.length(F.coalesce("documentation", F.lit("")))), "id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    lists = {c: F.slice(F.col(c) if dict(rows.dtypes)[c].startswith("array") else json_strings(F.col(c)), 1, 5) for c in ("solutions", "preventionTips")}
    clip = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return rows.select("key", "rank", "id", "repo", clip("errorMessage", 300).alias("message"), clip("documentation", 1200).alias("documentation"), clip("triggerScenarios", 600).alias("triggerScenarios"), *(v.alias(k) for k, v in lists.items()))


def assign_slugs(chosen: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, slug) of the families of one run, as if the largest chose first: slug, else slug-kind, else none.

    Rounds until nothing changes: every family asks for its next choice, each slug goes to the
    largest that asks, the others move on to their next. A slug may still be lost to a larger family
    that comes to it later, but a family never returns to one, so the rounds end and give what
    choosing one after the other gives. A round is one sum by slug and a join."""
    spark = chosen.sparkSession
    base = cluster_slug(F.col("value"))
    choices = F.array_distinct(F.array(base, F.concat_ws("-", base, "kind")))
    rows = chosen.select("key", F.struct((-F.col("errorCount")).alias("n"), "key").alias("order"), choices.alias("choices"), F.lit(0).alias("at"))
    root, turn = scratch(spark, "slugs"), 0
    gone = taken.select("slug").distinct().withColumn("gone", F.lit(True))
    while True:
        asked = rows.withColumn("slug", F.get("choices", F.col("at")))
        first = asked.where("slug is not null").groupBy("slug").agg(F.min("order").alias("first")).join(gone, "slug", "left").where("gone is null").select("slug", "first")
        lost = F.col("slug").isNotNull() & (F.col("first").isNull() | (F.col("first") != F.col("order")))
        asked.join(first, "slug", "left").select("key", "order", "choices", (F.col("at") + lost.cast("int")).alias("at"), lost.alias("lost")).write.parquet(f"{root}/{turn}")
        done = spark.read.parquet(f"{root}/{turn}")
        rows, turn = done.drop("lost"), turn + 1
        if done.where("lost").isEmpty():
            return rows.select("key", F.get("choices", F.col("at")).alias("slug"))


def page_links(sampled: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, guideSlugs, errorIds): guides that any sample matches, sorted, and the samples' ids in order."""
    code = F.when(F.col("kind") == "code", F.col("value"))
    rows = sampled.join(chosen.select("key", "kind", "value"), "key")
    return rows.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(guides_for(code, F.col("message")))))).alias("guideSlugs"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("errorIds"),
    )


def known_guides(proposed: Column) -> Column:
    """Those of the proposed guides that there are."""
    return F.array_intersect(F.coalesce(proposed, F.array().cast("array<string>")), F.array(*(F.lit(g) for g, _, _ in GUIDES)))


def drafted_pages(chosen: DataFrame, sampled: DataFrame, drafts: DataFrame, at: str, most_ids: int = 50) -> DataFrame:
    """Info pages of families with a draft (key, slug, title, summary, background, commonCauses, fixes, guideSlugs).

    Guides are those that the draft names and that there are, and those that the samples match; ids
    are the samples' in order. What a draft lacks is empty."""
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    rows = chosen.join(drafts, "key").join(page_links(sampled, chosen).withColumnRenamed("guideSlugs", "__own"), "key", "left")
    causes = F.transform(F.coalesce("commonCauses", F.array().cast("array<struct<cause:string,detail:string>>")), lambda c: F.struct(*(F.coalesce(c[f], F.lit("")).alias(f) for f in ("cause", "detail"))))
    return rows.select(
        "slug", F.col("key").alias("clusterKey"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "summary", "background")), causes.alias("commonCauses"), empty("fixes", "array<string>"),
        F.array_sort(F.array_union(known_guides(F.col("guideSlugs")), F.coalesce("__own", F.array().cast("array<string>")))).alias("guideSlugs"),
        F.slice(F.coalesce("errorIds", F.array().cast("array<string>")), 1, most_ids).alias("errorIds"), F.col("errorCount").cast("int").alias("errorCount"), F.col("repoCount").cast("int").alias("repoCount"), F.lit(at).alias("generatedAt"), F.lit(VERSION).alias("schemaVersion"),
    )
