"""Every operator applied to the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishap.functions import rules, text
from mishap.operators import assemble, cluster, extract, index, jobs, queue, regions, reports, rescan, search, verify
from mishap.plans import views
from mishap.sinks import feeds, state
from mishap.sources import payloads

NOW = 200_000_000  # the clock of queries on queues, in ms
MARKS = ["the ", "und ", "que ", "les ", "of ", "con ", "@", "http", "#", "!", "0", "7"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query
def entries_normalized(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.fuzzy_form(F.col("text")).alias("form"))


@query
def code_tokens(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.explode(text.code_tokens(F.col("text"))).alias("token"))


def _weighted(spark, d):
    e = views.entries(spark, d)
    tokens = index.postings(e)
    return e, tokens, index.weights(tokens, index.entry_count(e))


@query
def doc_frequency_idf(spark, d):
    return _weighted(spark, d)[2].select("token", "df", F.round("idf", 9).alias("idf"), "weight")


@query
def posting_lists(spark, d):
    e = views.entries(spark, d)
    return index.posting_lists(index.postings(e), index.entry_count(e)).select("shard", "token", "weight", _joined("entries"))


@query
def entry_norms(spark, d):
    _, tokens, w = _weighted(spark, d)
    return index.norms(tokens, w)


@query
def token_shards(spark, d):
    tokens = index.postings(views.entries(spark, d)).select("token").distinct()
    s = text.token_shard(F.col("token"))
    return tokens.select("token", s.alias("shard"), text.shard_name(s).alias("file"))


@query
def code_index(spark, d):
    return index.code_lists(views.entries(spark, d)).select("code", _joined("entries"))


@query
def id_shards(spark, d):
    return index.id_shards(views.entries(spark, d))


@query
def meta_chunks(spark, d):
    return index.meta_chunks(views.messages(spark, d)).groupBy("chunk").agg(F.count("*").alias("n"), F.min("msg").alias("first"))


@query
def search_cosine(spark, d):
    return search.ranked(views.queries(spark, d), views.messages(spark, d))


@query
def search_jaccard(spark, d):
    found = search.jaccard(views.queries(spark, d), views.messages(spark, d))
    return found.select("qid", "idx", text.round_half_up(F.col("score"), 3).alias("score"))


@query
def search_exact_code(spark, d):
    return search.exact_codes(views.queries(spark, d), views.messages(spark, d))


@query
def search_pattern(spark, d):
    return search.pattern_hits(views.queries(spark, d), views.messages(spark, d))


@query
def search_tiered(spark, d):
    return search.tiered(views.queries(spark, d), views.messages(spark, d)).select("qid", "rank", "idx", "repo", "score", "match")


@query
def message_patterns(spark, d):
    m = views.messages(spark, d)
    p = text.message_pattern(F.concat(F.col("msg"), F.lit(" at ${path} in {0}: %s")))
    return m.select("idx", p.alias("p")).select("idx", "p.*").withColumn("weight", text.literal_weight(F.col("pattern")))


def _clusters(spark, d, *kinds):
    return cluster.clusters(views.records(spark, d), kinds=list(kinds))


@query
def clusters_code(spark, d):
    return _clusters(spark, d, "code")


@query
def clusters_class(spark, d):
    return _clusters(spark, d, "class")


@query
def clusters_union(spark, d):
    return cluster.clusters(views.records(spark, d))


@query
def clusters_new(spark, d):
    pages = _clusters(spark, d, "tag").select(F.col("key").alias("clusterKey")).where("value != 'en'")
    return cluster.new_clusters(views.records(spark, d), pages)


@query
def cluster_sample(spark, d):
    chosen = _clusters(spark, d, "class")
    return cluster.samples(views.records(spark, d), chosen).select("key", "rank", "id", "repo", F.md5("message").alias("message"), F.length("documentation").alias("n"))


@query
def cluster_slugs(spark, d):
    return cluster.clusters(views.records(spark, d)).select("key", text.cluster_slug(F.col("value")).alias("slug"))


@query
def guide_matches(spark, d):
    return reports.guide_matches(_pages(spark, d))


def _pages(spark, d):
    p = views.table(spark, d, "pages")
    code = F.get(text.code_tokens(F.col("html")), F.lit(0))
    return p.select(F.col("page_id").alias("idx"), F.parse_url("url", F.lit("HOST")).alias("repo"), code.alias("code"), F.concat_ws(" ", "html", F.when(F.col("page_id") % 5 == 0, "connection reset").when(F.col("page_id") % 5 == 1, "request timed out")).alias("msg"))


@query
def guide_top_repos(spark, d):
    m = reports.guide_matches(_pages(spark, d)).withColumn("repo", F.regexp_replace("repo", r"^.*\.", ""))
    return reports.guide_top_repos(m).select("guide", "repo_rank", "repo", "n", _joined("shown"), "more")


@query
def related_by_tags(spark, d):
    """Tags are the marks that a whole text holds."""
    e = views.entries(spark, d)
    tags = F.filter(F.array(*map(F.lit, MARKS)), lambda m: F.contains(F.col("msg"), m))
    return reports.related(e.select("repo", F.col("doc_id").alias("id"), "idx", tags.alias("tags")))


@query
def latest_phase_run(spark, d):
    return jobs.latest_runs(views.jobs(spark, d), ["repo", "phase"]).select("repo", "phase", "id", "status")


@query
def recent_phases(spark, d):
    return jobs.recent_runs(views.jobs(spark, d)).select("repo", _joined("recent"))


@query
def phase_duration_sum(spark, d):
    return jobs.phase_time(views.jobs(spark, d))


@query
def failure_streaks(spark, d):
    return jobs.failure_streaks(views.jobs(spark, d), ["repo"], breaker=3).select("repo", "id", "streak", "tripped")


@query
def phase_batches(spark, d):
    return jobs.batches(views.jobs(spark, d), ["repo"], "id", 40).groupBy("repo", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query
def top_pages(spark, d):
    t = views.traffic(spark, d).withColumn("agent", rules.agent_class(F.col("ua")))
    return reports.top_pages(t)


@query
def traffic_points(spark, d):
    p = views.table(spark, d, "pages")
    point = rules.traffic_point(F.col("url"), F.lit("Mozilla/5.0 (compatible; GPTBot/1.1)"), F.lit(200), F.lit("miss"))
    return p.select("page_id", point.alias("p")).select("page_id", "p.*")


@query
def claim_order(spark, d):
    rows = queue.claim_order(views.queue(spark, d), views.repos(spark, d), prefer="rescan")
    return index.dense_index(rows, queue.order_of_claims("rescan")).select((F.col("idx") + 1).cast("int").alias("rank"), "repo", "priority", "updated_at")


@query
def seed_queue(spark, d):
    corpus = views.table(spark, d, "orders").select((F.col("o_custkey") * 2).cast("string").alias("repo"))
    return queue.seed(views.queue(spark, d), corpus, NOW)


@query
def settle_queue(spark, d):
    q = views.queue(spark, d)
    n = F.col("repo").cast("long")
    out = q.where("status = 'running'").select("repo", F.when(n % 2 == 0, "failed").otherwise("done").alias("outcome"), F.when(n % 4 == 0, "[spawn] unable to create thread").when(n % 2 == 0, "bad answer").alias("error"), F.col("solo").alias("ran_at"), (n % 3 == 0).alias("held_large"))
    return queue.settle(q, out, NOW)


@query
def rescan_decisions(spark, d):
    r = views.repos(spark, d)
    n = F.col("repo").cast("long")
    due = rules.rescan_due(F.col("analyzed_sha"), F.lit("analyzed"), n % 3, F.col("analyzed_at"), F.when(n % 2 == 0, F.col("analyzed_sha")), F.lit("1998-01-10").cast("timestamp"))
    return r.select("repo", due.alias("decision"))


@query
def rescan_plan(spark, d):
    plan = rescan.plan_rescan(views.lines(spark, d).distinct(), views.diffs(spark, d))
    return plan.select("filePath", "lineNumber", "disposition", "newLine")


@query
def lines_in_review(spark, d):
    sites = views.lines(spark, d).distinct().select("repo", F.col("filePath").alias("file"), (F.col("lineNumber") + 4).alias("line"))
    return rescan.in_review(sites, views.diffs(spark, d)).select("file", "line")


@query
def innermost_interval(spark, d):
    li = views.table(spark, d, "lineitem")
    symbols = li.select("l_orderkey", F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.col("l_quantity") % 5).cast("int").alias("last"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("name"))
    sites = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("line")).distinct()
    return regions.innermost(sites, symbols, ["l_orderkey"]).select("l_orderkey", "line", "first", "last", "name")


@query
def merged_regions(spark, d):
    li = views.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 4).alias("start"), (F.col("l_quantity") % 8 + 1).cast("int").alias("size"))
    return regions.merge_windows(li, ["l_orderkey"])


@query
def assembled_ids_slugs(spark, d):
    e = views.table(spark, d, "documents").select(F.col("lang").alias("repo"), F.col("doc_id").alias("ordinal"), "text", F.concat(F.lit("f"), (F.col("doc_id") % 10).cast("string")).alias("path"))
    e = e.withColumn("code", F.get(text.code_tokens(F.col("text")), F.lit(0)))
    e = e.withColumn("id", text.error_id(F.col("repo"), F.col("code"), F.col("text"), F.col("path"))).withColumn("slug", text.record_slug(F.col("code"), F.col("text")))
    return assemble.unique_slugs(assemble.first_of_each_id(e)).select("ordinal", "repo", "id", "slug")


def _assembled(spark, d):
    docs = views.table(spark, d, "documents")
    found = docs.select(F.concat_ws("/", "lang", "source").alias("repo"), F.sha1(F.col("source")).alias("sha"), F.col("doc_id").alias("ordinal"), F.col("text").alias("message"), F.element_at(F.array(F.lit("Panic"), F.lit("code"), F.lit("x")), (F.col("doc_id") % 3 + 1).cast("int")).alias("type"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), (F.col("doc_id") % 4).alias("line"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("errorClass"), (F.col("n_chars") % 700).cast("int").alias("httpStatus"))
    enriched = docs.where("doc_id % 2 = 0").select(F.concat_ws("/", "lang", "source").alias("repo"), F.col("doc_id").alias("ordinal"), F.lit("fatal").alias("severity"), F.array(F.lit("Net"), F.lit("bad tag")).alias("tags"))
    defence = docs.where("doc_id % 3 = 0").select(F.concat_ws("/", "lang", "source").alias("repo"), F.col("doc_id").alias("ordinal"), F.lit("retry").alias("handlingStrategy"), F.array(F.lit("check")).alias("preventionTips"))
    files = docs.select(F.concat_ws("/", "lang", "source").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return assemble.assemble(found, enriched, defence, files, "2024-01-02T03:04:05Z")


@query
def validation_rejects(spark, d):
    return _assembled(spark, d).where("not valid").select("id", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query
def assembled_records(spark, d):
    return _assembled(spark, d).select("id", "repo", "slug", "errorType", "severity", "lineNumber", "sourceCodeStart", "sourceCodeEnd", "githubUrl", F.md5("messagePattern").alias("pattern"), "valid")


@query
def verify_gaps(spark, d):
    g = verify.gaps(_assembled(spark, d))
    return g.select("id", "hasDoc", "hasSolutions", "hasSource", "hasDefense")


@query
def applied_patches(spark, d):
    r = views.records(spark, d).select("id", "documentation", F.lit("old").alias("exampleFix"))
    p = views.table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("d"), (F.col("doc_id") * 3 % 700).cast("string")).alias("id"), F.when(F.col("doc_id") % 4 == 0, "exampleFix").when(F.col("doc_id") % 4 == 1, "id").otherwise("documentation").alias("field"), F.col("source").alias("value"))
    return verify.apply_patches(r, p)[0].select("id", F.md5("documentation").alias("documentation"), "exampleFix")


@query
def quality_report(spark, d):
    docs = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id", "left")
    some = lambda c: F.when(c, F.lit("x"))
    r = docs.select(
        F.col("lang").alias("label"), F.get(text.code_tokens(F.col("text")), F.lit(0)).alias("errorCode"), F.col("text").alias("documentation"), F.split("source", "1").alias("solutions"), some(F.col("quality") == 1).alias("exampleFix"),
        some(F.col("toxic") == 0).alias("sourceCode"), some(F.col("toxic") == 1).alias("handlingStrategy"), F.split("source", "2").alias("preventionTips"), F.array().cast("array<string>").alias("tags"),
    )
    return reports.quality(r)


@query
def scope_tree_counts(spark, d):
    return extract.tree_counts(views.trees(spark, d), most_dirs=10_000, cap=50)


@query
def scope_tally(spark, d):
    return extract.scope_tally(views.trees(spark, d), F.array().cast("array<string>"), F.array(F.lit("thther.example.org/en"), F.lit("ththre.example.com")))


@query
def source_region(spark, d):
    r = views.table(spark, d, "documents").select("doc_id", assemble.source_region(F.col("text"), (F.col("doc_id") % 30 + 1).cast("int")).alias("r"))
    return r.select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.md5("r.sourceCode").alias("code"))


@query
def parsed_targets(spark, d):
    t = rules.review_target(F.concat("url", F.when(F.col("page_id") % 2 == 0, "/x").otherwise("")))
    return views.table(spark, d, "pages").select("page_id", t["repo"].alias("repo"), t["slug"].alias("slug"))


@query
def paged_repos(spark, d):
    counts = reports.errors_by_repo(views.entries(spark, d))
    return reports.paged(counts)


@query
def page_links(spark, d):
    return reports.page_hrefs(reports.errors_by_repo(views.entries(spark, d)))


@query
def background_articles(spark, d):
    pages = spark.createDataFrame([("en",), ("der",), ("fr",)], "slug string")
    return reports.background_article(views.records(spark, d).select("id", "backgroundTag", "errorCode"), pages).select("id", "article")


@query
def page_entries(spark, d):
    e = views.entries(spark, d).select(F.col("doc_id").cast("string").alias("id"), "repo", "idx")
    pages = views.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("slug"), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: (F.col("item_id") * 40 + i).cast("string")).alias("errorIds"))
    return reports.page_entries(pages, e).select("page", "pos", "id", "repo")


@query
def peak_hours(spark, d):
    ts = F.col("ts")
    return views.table(spark, d, "events").select("event_id", rules.is_peak(ts).alias("peak"), rules.ms_to_off_peak(ts).alias("ms"))


@query
def identity_reuse(spark, d):
    e = views.entries(spark, d).select("id", "doc_id")
    published = e.where("doc_id % 3 = 0").select("id")
    return rescan.split_by_identity(e, published).groupBy("reuse").agg(F.count("*").alias("n"))


@query
def upserted_repos(spark, d):
    base = views.repos(spark, d).select("repo", "analyzed_sha", "error_count")
    new = views.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("repo"), F.when(F.col("c_nationkey") > 10, F.col("c_nationkey").cast("long")).alias("error_count"))
    return state.upsert(base, new, ["repo"])


@query
def change_marker(spark, d):
    r = views.repos(spark, d).select(F.when(F.col("analyzed_sha").isNotNull(), "analyzed").otherwise("pending").alias("status"), "analyzed_at")
    pages = views.table(spark, d, "events").select(F.col("event_id").alias("created_at"))
    return reports.change_marker(r, pages)


@query
def pending_work(spark, d):
    return queue.pending_count(views.queue(spark, d))


@query
def extract_sites(spark, d):
    rows = extract.extract_sites(views.sources(spark, d))
    return rows.select("path", "line", "kind", "literal", "snippet", F.col("context.start").alias("start"), F.size("context.lines").alias("lines"), F.md5(F.array_join("context.lines", "\n").cast("binary")).alias("context"))


@query
def extract_json(spark, d):
    return payloads.extract_json(views.raw_answers(spark, d)).select("conv_id", "turn", F.get_json_object("json", "$.said").alias("said"), "error")


@query
def phases_done(spark, d):
    return jobs.is_done(views.jobs(spark, d).withColumn("analyzed_sha", F.lit("s")), "s")


@query
def guide_counts(spark, d):
    pages = views.table(spark, d, "benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("slug"), F.length("text").alias("errorCount"))
    return reports.guide_counts(reports.guide_matches(_pages(spark, d)), pages)


@query
def content_keys(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", text.content_key(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")), F.col("props")).alias("key"))


@query
def sitemap_lines(spark, d):
    r = views.entries(spark, d).select("doc_id", F.concat("repo", F.lit("&x")).alias("repo"), "slug", F.lit("2026-07-14T00:00:00Z").alias("analyzedAt"))
    return feeds.repo_sitemap(r, "https://example.org").groupBy("line").agg(F.count("*").alias("n"))


@query
def tree_lines(spark, d):
    counts = extract.tree_counts(views.trees(spark, d), most_dirs=10_000, cap=2)
    return extract.render_tree(counts, suspect=2)


@query
def host_faults(spark, d):
    said = F.element_at(F.array(*map(F.lit, ["EAGAIN again", "xEMFILE", "HTTP 429", "no space left on DEVICE", "rate-limit hit", "fine"])), (F.col("event_id") % 6 + 1).cast("int"))
    return views.table(spark, d, "events").select("event_id", rules.is_host_fault(said).alias("host"), rules.is_rate_limit(said).alias("patience"))


@query
def repo_metadata(spark, d):
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("description"), F.col("lang").alias("language"), F.col("n_chars").alias("stargazers_count")))
    m = payloads.repo_meta(F.when(F.col("doc_id") % 7 == 0, "[no").otherwise(body))
    return views.table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.*")


@query
def run_comparison(spark, d):
    return reports.compare_runs(quality_report(spark, d), ["de", "en"]).where("metric in ('records', 'withCode', 'shortDocs', 'withSource', 'withDefense')")


@query
def checkpointed_batches(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("repo"), F.when(F.col("event_id") % 4 == 0, "old").otherwise("new").alias("sha"), F.col("event_type").alias("phase"), F.col("event_id").cast("string").alias("batch_key"), F.lit("a").alias("result"), F.col("event_id").alias("updated_at"))
    fresh = e.where("sha = 'new' and updated_at % 3 = 0 and repo != '1'").withColumn("result", F.lit("b"))
    return state.put_batch(e, fresh, "new").groupBy("repo", "sha", "result").agg(F.count("*").alias("n"))


@query
def record_markdown(spark, d):
    r = _assembled(spark, d).withColumn("exampleFix", F.when(F.col("lineNumber") == 1, "fix()"))
    return r.select("id", F.md5(feeds.markdown()).alias("markdown"))


@query
def declared_names(spark, d):
    line = F.concat(F.when(F.col("doc_id") % 2 == 0, "export const "), F.col("source"), F.when(F.col("doc_id") % 3 == 0, " := x").otherwise(" == x"))
    rows = views.table(spark, d, "documents").select("doc_id", extract.declared_name(F.coalesce(line, F.concat("source", F.lit("Err = y")))).alias("n"))
    return rows.select("doc_id", F.col("n.name").alias("name"), F.col("n.exported").alias("exported"))
