"""Reports and page contents: counts, quality, traffic, guides, related records, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishap.functions.rules import guides_for, is_record_path
from mishap.functions.text import json_strings, kebab, round_half_up


def dataset_counts(repos: DataFrame, records: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: repos, errors, infoPages and rejected, of validated tables."""
    total = lambda rows, name: rows.agg(F.count_if("valid").alias(name), F.count_if(~F.col("valid")).alias(f"__{name}"))
    one = total(repos, "repos").crossJoin(total(records, "errors")).crossJoin(total(pages, "infoPages"))  # single rows
    return one.select("repos", "errors", "infoPages", (F.col("__repos") + F.col("__errors") + F.col("__infoPages")).alias("rejected"))


def errors_by_repo(entries: DataFrame) -> DataFrame:
    return entries.groupBy("repo").agg(F.count("*").alias("errorCount"))


def change_marker(repos: DataFrame, pages: DataFrame) -> DataFrame:
    """One row that changes when something is to publish."""
    done = repos.where("status in ('analyzed', 'exported')").agg(F.max("analyzed_at").alias("analyzed_at"), F.count("*").alias("repos"))
    return done.crossJoin(pages.agg(F.max("created_at").alias("pages_at")))


def quality(records: DataFrame, label: str | Column = "label") -> DataFrame:
    """Metrics of records by run label. Lists may be arrays or JSON texts."""
    kinds = dict(records.dtypes)
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")) if kinds[c].startswith("array") else json_strings(F.col(c)))
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    share = lambda c: round_half_up(F.avg(c), 1)
    return records.groupBy(label).agg(
        F.count("*").alias("records"),
        filled("errorCode").alias("withCode"),
        round_half_up(F.avg(F.length("documentation"))).cast("long").alias("avgDocChars"),
        F.count_if(F.length("documentation") < 100).alias("shortDocs"),
        share(size("solutions")).alias("avgSolutions"),
        F.count_if(size("solutions") == 0).alias("noSolutions"),
        filled("exampleFix").alias("withExampleFix"),
        filled("sourceCode").alias("withSource"),
        filled("handlingStrategy").alias("withDefense"),
        share(size("preventionTips")).alias("avgPreventionTips"),
        share(size("tags")).alias("avgTags"),
    )


def compare_runs(metrics: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """One row a metric, a column a run; counts as percentages of the run's records."""
    of = ["withCode", "shortDocs", "noSolutions", "withExampleFix", "withSource", "withDefense"]
    names = [c for c in metrics.columns if c != label]
    percent = lambda c: F.when(F.col("records") > 0, F.concat(round_half_up(F.col(c) * 100 / F.col("records")).cast("string"), F.lit("%"))).otherwise("-")
    long = metrics.select(label, F.explode(F.create_map(*(x for c in names for x in (F.lit(c), percent(c) if c in of else F.col(c).cast("string"))))).alias("metric", "value"))
    return long.groupBy("metric").pivot(label, labels).agg(F.first("value"))


def top_pages(traffic: DataFrame, limit: int = 20) -> DataFrame:
    """(path, requests, top_agent) of record pages; requests are sums of sample weights, ties of agents go by name."""
    rows = traffic.where(is_record_path(F.col("path"))).groupBy("path", "agent").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    out = rows.groupBy("path").agg(F.sum("w").alias("requests"), F.min(F.struct((-F.col("n")).alias("n"), "agent"))["agent"].alias("top_agent"))
    return out.orderBy(F.desc("requests"), "path").limit(limit)


def guide_matches(entries: DataFrame) -> DataFrame:
    """(guide, idx, repo): each entry with each guide that it matches."""
    return entries.select("idx", "repo", F.explode(guides_for(F.col("code"), F.col("msg"))).alias("guide")).select("guide", "idx", "repo")


def guide_top_repos(matches: DataFrame, repos: int = 10, rows: int = 5) -> DataFrame:
    """(guide, repo_rank, repo, n, shown, more): the repos with most matches, and their first entries."""
    each = matches.groupBy("guide", "repo").agg(F.count("*").alias("n"))
    each = each.withColumn("repo_rank", F.row_number().over(Window.partitionBy("guide").orderBy(F.desc("n"), "repo"))).where(F.col("repo_rank") <= repos)
    first = matches.withColumn("r", F.row_number().over(Window.partitionBy("guide", "repo").orderBy("idx"))).where(F.col("r") <= rows)
    first = first.groupBy("guide", "repo").agg(F.sort_array(F.collect_list("idx")).alias("shown"))
    return each.join(first, ["guide", "repo"]).select("guide", "repo_rank", "repo", "n", "shown", F.greatest(F.col("n") - rows, F.lit(0)).alias("more"))


def guide_counts(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """(kind, slug, n) of guides and info pages, the largest first."""
    guides = matches.groupBy(F.col("guide").alias("slug")).agg(F.count("*").alias("n")).select(F.lit("guide").alias("kind"), "slug", "n")
    return guides.unionByName(pages.select(F.lit("info").alias("kind"), "slug", F.col("errorCount").cast("long").alias("n"))).orderBy(F.desc("n"), "kind", "slug")


def related(entries: DataFrame, cap: int = 5) -> DataFrame:
    """(id, rank, other, overlap): records of one repo that share tags, the most first; the other's repeats count. Ids are unique.

    Records with the same tags are of one kind, and kinds are paired instead of records: of a kind only
    its first cap + 1 records can be among anyone's best, and all records of a kind have the same
    best but for themselves. So a tag that all records have costs no more than its kinds do."""
    rows = entries.select("repo", "id", "idx", F.array_sort("tags").alias("kind")).where(F.size("kind") > 0)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("repo", "kind").orderBy("idx"))).where(F.col("n") <= cap + 1)
    kinds = first.groupBy("repo", "kind").agg(F.collect_list(F.struct("idx", "id")).alias("first"))
    mine = kinds.select("repo", "kind", F.explode(F.array_distinct("kind")).alias("tag"))
    theirs = kinds.select("repo", F.col("kind").alias("other_kind"), F.explode("kind").alias("tag")).groupBy("repo", "other_kind", "tag").agg(F.count("*").alias("n"))
    pairs = mine.join(theirs, ["repo", "tag"]).groupBy("repo", "kind", "other_kind").agg(F.sum("n").alias("overlap"))
    best = pairs.join(kinds.select("repo", F.col("kind").alias("other_kind"), "first"), ["repo", "other_kind"]).select("repo", "kind", "overlap", F.explode("first").alias("o"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("repo", "kind").orderBy(F.desc("overlap"), "o.idx"))).where(F.col("n") <= cap + 1)
    found = rows.join(best, ["repo", "kind"]).where(F.col("id") != F.col("o.id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overlap"), "o.idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cap).select("id", "rank", F.col("o.id").alias("other"), "overlap")


def background_article(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds article: the page of the record's tag, else of its code as kebab."""
    slugs = pages.select("slug").distinct()
    rows = records.withColumn("__code", F.when(F.col("errorCode") != "", kebab(F.col("errorCode"))))
    rows = rows.join(slugs.select(F.col("slug").alias("__a"), F.col("slug").alias("backgroundTag")), "backgroundTag", "left")
    rows = rows.join(slugs.select(F.col("slug").alias("__b"), F.col("slug").alias("__code")), "__code", "left")
    return rows.withColumn("article", F.coalesce("__a", "__b")).drop("__a", "__b", "__code").select(*records.columns, "article")


def page_entries(pages: DataFrame, entries: DataFrame, most: int = 20) -> DataFrame:
    """(slug, pos, id, ...): a page's first records in its order; unknown ids are left out."""
    rows = pages.select(F.col("slug").alias("page"), F.posexplode(F.slice("errorIds", 1, most)).alias("pos", "id"))
    return rows.join(entries, "id").orderBy("page", "pos")


def paged(repos: DataFrame, per_page: int = 25) -> DataFrame:
    """Repos by records and name with page, place, pages, prev and next links."""
    order = Window.orderBy(F.desc("errorCount"), "repo")  # one row a project: a table of pages, not of records
    rows = repos.withColumn("n", F.row_number().over(order)).withColumn("page", F.ceil(F.col("n") / per_page).cast("int"))
    total = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy()) / per_page)).cast("int")
    rows = rows.withColumn("pages", total)
    return rows.withColumn("prev", F.when(F.col("page") > 1, page_href(F.col("page") - 1))).withColumn("next", F.when(F.col("page") < F.col("pages"), page_href(F.col("page") + 1)))


def page_href(page: Column) -> Column:
    return F.when(page <= 1, F.lit("/")).otherwise(F.concat(F.lit("/repos/"), page.cast("string"), F.lit("/")))


def page_hrefs(repos: DataFrame, per_page: int = 25) -> DataFrame:
    total = repos.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_page)).alias("n"))
    return total.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("page")).select("page", page_href(F.col("page")).alias("href"))


def page_window(page: Column, pages: Column, around: int = 2) -> Column:
    """Page numbers to show: the first, the last and those around."""
    return F.filter(F.sequence(F.lit(1), pages), lambda p: (p == 1) | (p == pages) | (F.abs(p - page) <= around))


def posts_order() -> list[Column]:
    """The newest post first."""
    return [F.desc("date"), F.col("slug")]


def posts_by_date(posts: DataFrame) -> DataFrame:
    return posts.orderBy(*posts_order())
