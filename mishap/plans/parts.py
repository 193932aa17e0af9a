"""More operators applied to the driver's tables, each beside the same in DuckDB SQL; adds to QUERIES and SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mishap import oracle
from mishap.api import KnowledgeBase
from mishap.functions import rules, text
from mishap.operators import assemble, cluster, drain, extract, index, jobs, queue, regions, reports, rescan, verify
from mishap.plans import sql, views
from mishap.plans.queries import NOW, QUERIES, Query, _assembled, _clusters, _joined
from mishap.schema import INFO_PAGE, REPO, validate_info_pages, validate_repos
from mishap.sinks import feeds, publish, state
from mishap.sources import files, payloads, requests
from mishap.sources.shards import Shards
from mishap.sinks.commits import Keyed
from mishap.storage import scratch, write_text
from mishap.streaming.queue_stream import event_windows


def both(oracle: str):
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], sql.SQL[f.__name__] = f, oracle
        return f

    return add


# published data


@both(sql.SQL["search_cosine"])
def sharded_search(spark, d):
    """The index written as files and searched by its shards: what the search in memory finds."""
    root = scratch(spark, "index")
    publish.write_index(views.messages(spark, d), root)
    return Shards(spark, root).search(views.queries(spark, d)).select("qid", "rank", "idx", "score", "match")


@both(f"WITH {sql._MESSAGES} SELECT idx, id, repo, code, md5(msg) AS msg FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY idx) = 1")
def lookups_by_id(spark, d):
    entries, root = views.messages(spark, d), scratch(spark, "ids")
    entries = entries.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("idx"))).where("n = 1").drop("n")
    entries.write.parquet(f"{root}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{root}/entries")
    publish.write_index(entries, root)
    return Shards(spark, root).lookup(entries.select("id")).select("idx", "id", "repo", "code", F.md5("msg").alias("msg"))


def _published(spark, d):
    """A data set of assembled records, published in a scratch folder: (folder, manifest)."""
    records = _assembled(spark, d).drop("issues", "valid")
    sha, at = F.sha1(F.element_at(F.split("repo", "/"), 2)), F.lit("2024-01-02T03:04:05Z")
    repos = records.groupBy("repo").agg(F.count("*").cast("int").alias("errorCount"))
    # one repo has a bad count and one no analysis
    bad = F.when(F.col("repo") == "de/src1", -1).otherwise(F.col("errorCount"))
    repos = repos.select("repo", F.lit(None).cast("string").alias("description"), F.lit("x").alias("language"), F.lit(1).alias("stars"), F.lit(None).cast("int").alias("sourceFiles"), F.lit("main").alias("defaultBranch"), sha.alias("analyzedSha"), at.alias("analyzedAt"), bad.cast("int").alias("errorCount"))
    repos = repos.withColumn("status", F.when(F.col("repo") == "de/src2", "pending").otherwise("analyzed"))
    pages = views.table(spark, d, "benchmark").select(F.concat(F.lit("p-"), F.col("item_id").cast("string")).alias("slug"), F.lit("k").alias("clusterKey"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("b").alias("background"), F.array(F.struct(F.lit("c").alias("cause"), F.lit("d").alias("detail"))).alias("commonCauses"), F.array(F.lit("f")).alias("fixes"), F.array().cast("array<string>").alias("guideSlugs"), F.array().cast("array<string>").alias("errorIds"), F.length("text").cast("int").alias("errorCount"), F.lit(2).alias("repoCount"), at.alias("generatedAt"), F.lit(2).alias("schemaVersion"))
    root = scratch(spark, "published")
    return root, publish.publish(spark, repos, records, pages, root, "v1")


_VALID = f"""{sql._MADE}, s0 AS (SELECT *, {sql._slug("text")} AS base FROM checked), u AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY repo, base ORDER BY doc_id) > 1 THEN base || '-' || substr(id, 1, 6) ELSE base END AS slug FROM s0),
ok AS (SELECT *, NOT (bad OR bad_http OR empty_text OR bad_line OR bad_end) AS valid FROM u WHERE repo <> 'de/src2')"""


@both(f"WITH {_VALID}, p AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(id, 1, 15))::BIGINT) - 1 AS idx FROM ok WHERE valid AND repo <> 'de/src1') SELECT idx, id, repo, slug, md5(text) AS msg, CASE doc_id % 3 WHEN 0 THEN 'panic' WHEN 1 THEN 'error_code' ELSE 'exception' END AS type, 'error' AS sev FROM p")
def published_entries(spark, d):
    """Published and read back from the packed index, after its checksum held."""
    return publish.read_index(spark, _published(spark, d)[0]).select("idx", "id", "repo", "slug", F.md5("msg").alias("msg"), "type", "sev")


@both(f"""WITH {_VALID}, r AS (SELECT repo, count(*) AS n FROM made WHERE repo NOT IN ('de/src1', 'de/src2') GROUP BY repo), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT repo FROM made) WHERE repo = 'de/src1')
SELECT (SELECT count(*) FROM r)::BIGINT AS repos, (SELECT count(*) FROM ok WHERE valid AND repo <> 'de/src1')::BIGINT AS errors, (SELECT count(*) FROM benchmark WHERE item_id IS NOT NULL)::BIGINT AS "infoPages",
 ((SELECT count(*) FROM ok WHERE NOT valid AND repo <> 'de/src1') + (SELECT n FROM b))::BIGINT AS rejected""")
def published_counts(spark, d):
    m = _published(spark, d)[1]
    return spark.createDataFrame([(*(m["counts"][k] for k in ("repos", "errors", "infoPages")), m["rejected"])], "repos long, errors long, infoPages long, rejected long")


@both(f"WITH {_VALID} SELECT repo, count(*) AS n, min(id) AS first FROM ok WHERE valid AND repo <> 'de/src1' GROUP BY repo")
def published_repo_files(spark, d):
    """The files of the repos, read back as records."""
    from mishap.schema import ERROR

    root, _ = _published(spark, d)
    rows = spark.read.schema(ERROR).option("multiLine", "true").option("recursiveFileLookup", "true").json(f"{publish.home(spark, root)}/repos")
    return rows.groupBy("repo").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@both(f"WITH {sql._ENTRIES}, {sql._TOKENS}, {sql._WEIGHTS} SELECT token, idx // 2000 AS block, weight, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS entries FROM tokens JOIN weights USING (token) GROUP BY ALL")
def posting_blocks(spark, d):
    e = views.entries(spark, d)
    tokens = index.postings(e)
    w = index.weights(tokens, index.entry_count(e))
    return index.posting_blocks(tokens, w).select("token", "block", "weight", _joined("entries"))


_PAGES = "SELECT 'p-' || item_id AS slug, length(text)::INT AS n FROM benchmark WHERE item_id IS NOT NULL"


@both(f"WITH p AS ({_PAGES}) SELECT slug, n AS listed, n AS paged, CASE WHEN slug LIKE '%7' THEN n END AS one FROM p")
def published_pages(spark, d):
    """The list of pages and the pages of a published set, read back: all, and those of slugs on 7 once more."""
    root, _ = _published(spark, d)
    listed, paged = publish.read_hub(spark, root).select("slug", F.col("errorCount").alias("listed")), publish.read_pages(spark, root).select("slug", F.col("errorCount").alias("paged"))
    one = publish.read_named_pages(spark, root, listed.where(F.col("slug").endswith("7"))).select("slug", F.col("errorCount").alias("one"))
    return listed.join(paged, "slug", "full").join(one, "slug", "left")


@both(f"WITH {_VALID}, p AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(id, 1, 15))::BIGINT) - 1 AS idx FROM ok WHERE valid AND repo <> 'de/src1') SELECT idx, id, repo, md5(text) AS msg FROM p")
def synced_entries(spark, d):
    """The entries of a cache that was brought up to a published set, chunk by chunk, each verified."""
    root, _ = _published(spark, d)
    cache = scratch(spark, "cache")
    publish.sync(spark, root, cache)
    return publish.read_cache(spark, cache).select("idx", "id", "repo", F.md5("msg").alias("msg"))


@both(f"WITH {_VALID} SELECT id, repo, slug, md5(text) AS message FROM ok WHERE valid AND repo <> 'de/src1' AND ('0x' || substr(id, 1, 2))::INT % 2 = 0")
def records_of_ids(spark, d):
    """Full records through the methods of a published set: ids of an even first byte, and one that isn't there."""
    kb = KnowledgeBase(spark, _published(spark, d)[0])
    ids = kb.entries.select("id").where(F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 2 == 0)
    return kb.get_all(ids.union(spark.createDataFrame([("0" * 16,)], "id string"))).select("id", "repo", "slug", F.md5("errorMessage").alias("message"))


@both(f"WITH {_VALID} SELECT id, repo, slug, md5(text) AS message FROM ok WHERE valid AND repo <> 'de/src1' AND doc_id % 3 > 0")
def records_of_names(spark, d):
    """Full records by project and slug, through the methods of a published set."""
    kb = KnowledgeBase(spark, _published(spark, d)[0])
    named = _assembled(spark, d).where("cast(regexp_extract(filePath, '([0-9]+)', 1) as long) % 3 > 0").select("repo", "slug")
    return kb.get_named(named).select("id", "repo", "slug", F.md5("errorMessage").alias("message"))


_KNOWN = f"{_VALID}, known AS (SELECT * FROM ok WHERE valid AND repo <> 'de/src1')"


@both(f"""WITH {_KNOWN}, r AS (SELECT doc_id * 8 AS rid, id AS said FROM ok UNION ALL SELECT doc_id * 8 + 1, '0000000000000000' FROM documents)
SELECT rid, CASE WHEN k.id IS NULL THEN 404 ELSE 200 END::INT AS status, k.id AS id, md5(k.text) AS message, CASE WHEN k.id IS NULL THEN 'not found' END AS error, NULL::BIGINT AS n FROM r LEFT JOIN known k ON k.id = said
UNION ALL SELECT doc_id * 8 + i, [405, 400, 404, 204][i - 1]::INT, NULL, NULL, ['method not allowed', 'missing q parameter', 'unknown endpoint', NULL][i - 1], NULL FROM documents, range(2, 6) t(i)
UNION ALL SELECT doc_id * 8 + 6, 200, NULL, NULL, NULL, (SELECT count(DISTINCT repo) FROM made WHERE repo NOT IN ('de/src1', 'de/src2')) FROM documents WHERE doc_id % 50 = 0""")
def answered_requests(spark, d):
    """The HTTP interface over a published set, a table of requests at once: each record, missing ones, faults, the list of projects."""
    kb = KnowledgeBase(spark, _published(spark, d)[0])
    docs = views.table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 8).alias("base"))
    ids = _assembled(spark, d).where("repo <> 'de/src2'").select(F.regexp_extract("filePath", "([0-9]+)", 1).cast("long") * 8, F.lit("GET"), F.concat(F.lit("https://s.example/api/errors/"), "id", F.lit("/")))
    fixed = [(1, "GET", "/api/errors/" + "0" * 16), (2, "POST", "/api/repos"), (3, "GET", "/api/search?q="), (4, "GET", "/api/unknown"), (5, "OPTIONS", "/api/search")]
    asked = F.explode(F.array(*(F.struct((F.col("base") + i).alias("rid"), F.lit(m).alias("method"), F.lit(u).alias("url")) for i, m, u in fixed)))
    lists = docs.where("doc_id % 50 = 0").select(F.col("base") + 6, F.lit("GET"), F.lit("https://s.example/api/repos?x=1"))
    got = kb.respond(docs.select(asked.alias("r")).select("r.*").union(ids).union(lists))
    at = lambda p: F.get_json_object("body", p)
    return got.select("rid", "status", at("$.record.id").alias("id"), F.md5(at("$.record.errorMessage")).alias("message"), at("$.error").alias("error"), F.size(F.from_json(at("$.repos"), "array<string>")).cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@both(f"WITH f AS ({sql.SQL['search_cosine']}) SELECT qid, rank, score, match FROM f WHERE rank <= 3")
def answered_searches(spark, d):
    """Searches over the HTTP interface, three hits each."""
    root = scratch(spark, "served")
    publish.write_index(views.messages(spark, d), root)
    asked = views.queries(spark, d).select(F.col("qid").alias("rid"), F.lit("GET").alias("method"), F.concat(F.lit("/api/search?limit=3&q="), F.url_encode("text")).alias("url"))
    got = requests.searched(Shards(spark, root), requests.routed(asked), "v1")
    hits = F.posexplode(F.from_json(F.get_json_object("body", "$.matches"), "array<struct<score:double,matchType:string>>")).alias("at", "m")
    return got.select("rid", hits).select(F.col("rid").alias("qid"), (F.col("at") + 1).cast("int").alias("rank"), F.col("m.score").alias("score"), F.col("m.matchType").alias("match"))


@both("SELECT CAST(ts AS DATE) AS day, event_type AS page, count(*) AS n FROM events GROUP BY ALL")
def traffic_by_day(spark, d):
    """Data points written by day and read back."""
    root = scratch(spark, "traffic")
    points = views.table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("page"))
    assert state.append_traffic(points, root)
    return spark.read.parquet(f"{root}/traffic").groupBy("day", "page").agg(F.count("*").alias("n"))


@both("SELECT 'r' || (o_custkey % 50) AS repo, o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey % 50 >= 10 UNION ALL SELECT 'r' || (c_custkey % 10), 'c' || c_custkey FROM customer")
def replaced_records(spark, d):
    """Records by repo; those of ten repos are replaced by a second version."""
    root = scratch(spark, "records")
    old = views.table(spark, d, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("repo"), F.col("o_orderkey").cast("string").alias("id"))
    new = views.table(spark, d, "customer").select(F.concat(F.lit("r"), (F.col("c_custkey") % 10).cast("string")).alias("repo"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    state.replace_repo_records(spark, root, old)
    state.replace_repo_records(spark, root, new)
    return state.read_records(spark, root).select("repo", "id")


@both(f"WITH {sql._REPOS} SELECT r.repo, analyzed_sha, coalesce(CASE WHEN c.c_custkey % 2 = 0 THEN c.c_nationkey END, error_count)::BIGINT AS error_count FROM r LEFT JOIN customer c ON c.c_custkey = r.n")
def patched_repos(spark, d):
    base = views.repos(spark, d).select("repo", "analyzed_sha", "error_count")
    new = views.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("repo"), F.col("c_nationkey").cast("long").alias("error_count"))
    return state.patch(base, new, "repo")


# extraction, diffs and rescans

_LINES = """t(k, ext, pre, post, kind) AS (VALUES (0, 'py', '    raise ValueError("', '")', 'throw'), (1, 'ts', '  throw new Error("', '")', 'throw'), (2, 'go', '    return fmt.Errorf("', '", x)', 'error_new'), (3, 'rs', '    panic!("', '");', 'panic'),
  (4, 'java', '    throw new IllegalStateException("', '");', 'throw'), (5, 'cs', '    throw new ArgumentException("', '");', 'throw'), (6, 'rb', '  raise "', '"', 'throw'), (7, 'php', '    throw new \\Oops("', '");', 'throw'), (8, 'c', '    perror("', '");', 'error_print')),
f AS (SELECT doc_id, kind, pre, length(pre) + length(post) AS more, 'src/' || lang || '/f' || doc_id || '.' || ext AS path, list_transform(string_split(text, chr(10)), lambda x: pre || regexp_replace(x, '[^A-Za-z ]', '', 'g') || post) AS l FROM documents JOIN t ON doc_id % 9 = k WHERE text IS NOT NULL),
s AS (SELECT path, kind, pre, more, l, unnest(range(1, len(l) + 1)) AS i FROM f WHERE strlen(array_to_string(l, chr(10))) <= 400000),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS n FROM s WHERE length(l[i]) <= 500),
v AS (SELECT *, length(l[i]) - more AS own, length(l[i + 1]) - more AS after, greatest(1, i - 8) AS start, list_transform(l[greatest(1, i - 8):i + 8], lambda x: least(length(x), 200) + 1) AS sizes FROM k WHERE n <= 500),
w AS (SELECT *, greatest(1, len(list_filter(range(1, len(sizes) + 1), lambda k: list_sum(sizes[1:k]) <= 1200))) AS shown FROM v)"""
_FOUND = """SELECT path, i::INT AS line, kind, CASE WHEN own BETWEEN 4 AND 200 THEN substr(l[i], length(pre) + 1, own) WHEN after BETWEEN 4 AND 200 THEN substr(l[i + 1], length(pre) + 1, after) END AS literal, substr(trim(l[i]), 1, 300) AS snippet, start::INT AS start,
  shown::INT AS lines, md5(array_to_string(list_transform(l[start:start + shown - 1], lambda x: substr(x, 1, 200)), chr(10))) AS context FROM w"""
sql.SQL["extract_sites"] = f"WITH {_LINES} {_FOUND}"
sql.SQL["extract_json"] = "SELECT conv_id, turn, text AS said, NULL::VARCHAR AS error FROM conversations"


@both(f"WITH {_LINES}, x AS ({_FOUND}) SELECT path, line, literal FROM x JOIN f USING (path) WHERE doc_id % 3 = 0 OR doc_id % 3 = 1 AND line BETWEEN 2 AND 10")
def extract_sites_in_diff(spark, d):
    """Only what a diff adds or edits: every third file is new, every third modified at lines 5 to 7."""
    docs = views.table(spark, d, "documents").select("doc_id", views.source_path().alias("path"))
    hunk = F.struct(F.lit(1).cast("long").alias("oldStart"), F.lit(0).cast("long").alias("oldLen"), F.lit(5).cast("long").alias("newStart"), F.lit(3).cast("long").alias("newLen"))
    status = F.element_at(F.array(*map(F.lit, "AMD")), (F.col("doc_id") % 3 + 1).cast("int"))
    diff = docs.select("path", status.alias("status"), F.array(hunk).alias("hunks"))
    return extract.extract_sites(views.sources(spark, d), only=diff).select("path", "line", "literal")


@both("""WITH h AS (SELECT l_orderkey AS k, l_orderkey % 10 AS r, string_agg(l_linenumber || '-' || (l_quantity::INT % 4) || '-' || l_linenumber + 1 || '-' || CASE WHEN l_quantity::INT % 5 = 1 THEN 1 ELSE l_quantity::INT % 5 END, ',' ORDER BY l_linenumber, l_quantity, l_partkey) AS hunks FROM lineitem GROUP BY l_orderkey)
SELECT 'r' || r AS repo, 'src/' || k || '.py' AS path, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'D' ELSE 'M' END AS status, hunks FROM h""")
def parsed_diffs(spark, d):
    """Texts of diffs, several of a repo and several files in each, as files with their hunks."""
    q = F.col("l_quantity").cast("int")
    size = F.when(q % 5 == 1, "").otherwise(F.concat(F.lit(","), (q % 5).cast("string")))
    line = F.concat(F.lit("@@ -"), F.col("l_linenumber").cast("string"), F.lit(","), (q % 4).cast("string"), F.lit(" +"), (F.col("l_linenumber") + 1).cast("string"), size, F.lit(" @@ x"))
    hunks = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey", line.alias("line")))), lambda x: x["line"])
    rows = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(hunks.alias("hunks"))
    k, name = F.col("l_orderkey"), F.concat(F.lit("src/"), F.col("l_orderkey").cast("string"), F.lit(".py"))
    side = F.when(k % 3 == 0, F.concat(F.lit("--- /dev/null\n+++ b/"), name)).when(k % 3 == 1, F.concat(F.lit("--- a/"), name, F.lit("\n+++ /dev/null"))).otherwise(F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name))
    one = F.concat_ws("\n", F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name), side, F.array_join("hunks", "\n-x\n+y\n"))
    texts = rows.groupBy((k % 10).alias("r"), (F.floor(k / 100)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("text"))
    found = payloads.parse_diffs(texts.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("repo"), F.concat(F.lit("commit x\n"), "text").alias("text")))
    shown = F.transform("hunks", lambda h: F.concat_ws("-", h["oldStart"], h["oldLen"], h["newStart"], h["newLen"]))
    return found.select("repo", "path", "status", F.array_join(shown, ",").alias("hunks"))


@both(f"""WITH p AS ({sql.SQL["rescan_plan"]}) SELECT "filePath", "newLine"::INT AS "lineNumber", false AS fresh FROM p WHERE disposition <> 'dropped' UNION ALL SELECT 'new' || o_orderkey, 1, true FROM orders""")
def kept_and_fresh(spark, d):
    plan = rescan.plan_rescan(views.lines(spark, d).distinct(), views.diffs(spark, d)).withColumn("fresh", F.lit(False))
    fresh = views.table(spark, d, "orders").select(F.lit("r").alias("repo"), F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("filePath"), F.lit(1).alias("lineNumber"), F.lit(True).alias("fresh"))
    return rescan.kept_records(plan, fresh).select("filePath", "lineNumber", "fresh")


@both("""WITH y AS (SELECT l_orderkey AS k, l_linenumber AS first, (l_linenumber + l_quantity % 5)::INT AS last, 'f' || l_partkey AS name FROM lineitem), t AS (SELECT l_partkey AS v, l_orderkey AS k, l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS o FROM lineitem QUALIFY o <= 12),
i AS (SELECT v, o, name FROM t JOIN y ON y.k = t.k AND line BETWEEN first AND last QUALIFY row_number() OVER (PARTITION BY v, o ORDER BY last - first, first, last, name) = 1), n AS (SELECT v, name, min(o) AS o FROM i GROUP BY ALL)
SELECT v AS value, array_to_string((list(name ORDER BY o, name))[1:6], ',') AS names FROM n GROUP BY v""")
def reached_functions(spark, d):
    li = views.table(spark, d, "lineitem")
    symbols = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.col("l_quantity") % 5).cast("int").alias("last"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("name"))
    order = Window.partitionBy("l_partkey").orderBy(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    refs = li.select(F.col("l_partkey").alias("value"), F.row_number().over(order).alias("ordinal"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return regions.reached_by(refs, symbols).select("value", _joined("names"))


@both("""WITH l AS (SELECT l_orderkey AS k, l_linenumber * 4 AS s, (l_quantity % 8 + 1)::INT AS n FROM lineitem), m AS (SELECT *, max(s + n) OVER (PARTITION BY k ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, n ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT k, island, min(s) AS a, max(s + n) AS b FROM i GROUP BY ALL)
SELECT k AS file, a::INT AS start, array_to_string(list_transform(range(a, b), lambda x: 'l' || x), '|') AS lines FROM g""")
def merged_contexts(spark, d):
    """Windows of lines merged into regions; a line that several have comes once."""
    start, n = (F.col("l_linenumber") * 4).cast("int"), (F.col("l_quantity") % 8 + 1).cast("int")
    lines = F.transform(F.sequence(start, start + n - 1), lambda x: F.concat(F.lit("l"), x.cast("string")))
    sites = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.struct(start.alias("start"), lines.alias("lines")).alias("context"))
    return regions.merge_contexts(sites).select("file", "start", F.array_join("lines", "|").alias("lines"))


@both("SELECT l_orderkey AS file, l_linenumber AS line, min(l_partkey) AS ordinal FROM lineitem GROUP BY ALL")
def first_families(spark, d):
    li = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("ordinal"))
    return extract.first_family_wins(li)


@both(f"WITH {sql._FILES} SELECT count(*) AS n FROM t WHERE {sql._SEEN}")
def source_count(spark, d):
    return extract.count_sources(views.trees(spark, d))


@both("SELECT DISTINCT 'o/r' || o_custkey AS repo FROM orders")
def corpus_list(spark, d):
    """Names written as a list with comments and blanks, and read back."""
    root = scratch(spark, "corpus")
    o = views.table(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  # o/comment")).when(F.col("o_orderkey") % 3 == 1, F.lit(""))
    o.select(F.concat(F.lit(" o/r"), F.col("o_custkey").cast("string"), F.lit(" # seen")).alias("value")).union(o.where(line.isNotNull()).select(line)).write.text(root)
    return files.read_corpus(spark, root)


@both("SELECT 'src/' || lang || '/' || source || '.py' AS path, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS content FROM documents WHERE lang NOT IN ('fr', 'es') GROUP BY lang, source")
def tree_of_files(spark, d):
    """All texts as files of a tree whose root has an odd name, read as a tree: two languages are in folders that are skipped."""
    root = f"{scratch(spark, 'tree')}/build (1)+x/docs"
    folder = F.when(F.col("lang") == "fr", "node_modules").when(F.col("lang") == "es", "src/.hid").otherwise("src")
    path = F.concat(folder, F.lit("/"), "lang", F.lit("/"), "source", F.lit(".py"))
    pieces = publish._pieces(views.table(spark, d, "documents"), path, F.coalesce("text", F.lit("")), ["doc_id"], before="\n")
    publish.write_files(pieces.withColumn("open", F.lit("")).withColumn("close", F.lit("")), root)
    return files.read_tree(spark, root, max_bytes=1 << 30).select("path", F.md5("content").alias("content"))


@both("SELECT DISTINCT 'r' || c_custkey AS repo FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def candidates_found(spark, d):
    c = views.table(spark, d, "customer").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repo"), (F.col("c_nationkey") % 2 == 1).alias("fork"))
    known = views.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return files.new_candidates(c, known.select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo"))).select("repo")


# families and pages


@both(f"""WITH {sql._RECORDS}, {sql._MEMBERS}, b AS (SELECT key, kind, "errorCount", coalesce(nullif(regexp_replace(substr({sql._kebab("value")}, 1, 60), '-+$', ''), ''), 'cluster') AS base FROM clusters)
SELECT key, CASE WHEN base <> 'en' AND row_number() OVER (PARTITION BY base ORDER BY "errorCount" DESC, key) = 1 THEN base ELSE base || '-' || kind END AS slug FROM b""")
def assigned_slugs(spark, d):
    """Slugs of a run's pages, where one is taken."""
    taken = spark.createDataFrame([("en",)], "slug string")
    return cluster.assign_slugs(cluster.clusters(views.records(spark, d)), taken)


_SAMPLED = f"""{sql._RECORDS}, {sql._MEMBERS}, sm AS (SELECT c.key, c.kind, c.value, m.id, m.text, row_number() OVER (PARTITION BY c.key ORDER BY length(m.text) DESC, m.id) AS rank FROM members m JOIN clusters c ON m.kind = c.kind AND m.value = c.value WHERE c.kind = 'class' QUALIFY rank <= 30)"""


@both(f"""WITH {_SAMPLED}, g AS (SELECT key, unnest({sql._guide_list("NULL::VARCHAR", "substr(text, 1, 300) || CASE WHEN rank % 7 = 0 THEN ' handshake' ELSE '' END")}) AS guide FROM sm)
SELECT key, coalesce((SELECT string_agg(DISTINCT guide, ',' ORDER BY guide) FROM g WHERE g.key = sm.key), '') AS guides, string_agg(id, ',' ORDER BY rank) AS ids FROM sm GROUP BY key""")
def links_of_pages(spark, d):
    chosen = _clusters(spark, d, "class")
    sampled = cluster.samples(views.records(spark, d), chosen).withColumn("message", F.concat("message", F.when(F.col("rank") % 7 == 0, " handshake").otherwise("")))
    return cluster.page_links(sampled, chosen).select("key", F.array_join("guideSlugs", ",").alias("guides"), F.array_join("errorIds", ",").alias("ids"))


@both(f"""WITH e AS (SELECT lang AS repo, doc_id AS ordinal, text AS message, {sql._id("lang", f"coalesce({sql._code('text')}, text)", "'unknown'")} AS id FROM documents)
SELECT repo, ordinal, md5(message) AS message, 'duplicate discovery (id ' || id || ')' AS error FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) > 1""")
def rejected_duplicates(spark, d):
    e = views.table(spark, d, "documents").select(F.col("lang").alias("repo"), F.col("doc_id").alias("ordinal"), F.col("text").alias("message"), F.get(text.code_tokens(F.col("text")), F.lit(0)).alias("code"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    return assemble.duplicate_rejects(assemble.identified(e)).select("repo", "ordinal", F.md5("message").alias("message"), "error")


@both(f"""WITH t AS (SELECT doc_id, {sql._kebab("text")} AS tag FROM documents) SELECT doc_id, CASE WHEN regexp_full_match(tag, '[a-z][a-z0-9]*(-[a-z0-9]+)*') AND tag NOT IN ('error', 'errors', 'exception', 'exceptions', 'failure', 'failures', 'unknown') THEN md5(tag) END AS tag FROM t""")
def background_tags(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.md5(text.background_tag(F.col("text")).cast("binary")).alias("tag"))


@both("SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p)), lambda p: p <> ''), '|') AS paragraphs FROM (SELECT doc_id, replace(text, '. ', chr(10) || ' ' || chr(10)) AS text FROM documents)")
def text_paragraphs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.array_join(text.paragraphs(F.replace("text", F.lit(". "), F.lit("\n \n"))), "|").alias("paragraphs"))


@both("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ',' || source ELSE '' END AS items FROM documents")
def json_lists(spark, d):
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("lang", "source"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[no "), "lang"))
    return views.table(spark, d, "documents").select("doc_id", F.array_join(text.json_strings(body), ",").alias("items"))


@both("SELECT doc_id, lang || ':' || source AS found FROM documents WHERE doc_id % 4 > 0")
def errors_of_answers(spark, d):
    """Errors of discovery answers: those without a message are left out, other texts have none."""
    one = F.struct(F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("message"), F.col("source").alias("code"))
    rows = views.table(spark, d, "documents").select("doc_id", payloads.discovered_errors(F.to_json(F.struct(F.array(one).alias("errors")))).alias("e"))
    return rows.select("doc_id", F.explode("e").alias("e")).select("doc_id", F.concat_ws(":", "e.message", "e.code").alias("found"))


@both("SELECT 'info-' || item_id AS slug, length(text) AS n, row_number() OVER (ORDER BY length(text) DESC, 'info-' || item_id)::INT AS rank FROM benchmark")
def hub_pages(spark, d):
    b = views.table(spark, d, "benchmark").select(F.concat(F.lit("info-"), F.col("item_id").cast("string")).alias("slug"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.length("text").cast("long").alias("errorCount"), F.lit(1).alias("repoCount"), F.lit("g").alias("generatedAt"))
    order = Window.orderBy(F.desc("errorCount"), "slug")  # of the pages of a hub
    return publish.hub(b).select("slug", F.col("errorCount").alias("n"), F.row_number().over(order).alias("rank"))


@both("SELECT '  <sitemap><loc>https://s.example/sitemaps/' || replace(lang || '&' || source, '&', '&amp;') || '.xml</loc></sitemap>' AS line, count(*) AS n FROM documents GROUP BY 1")
def sitemap_of_repos(spark, d):
    r = views.table(spark, d, "documents").select(F.concat_ws("&", "lang", "source").alias("repo"))
    return feeds.sitemap_index(r, "https://s.example").groupBy("line").agg(F.count("*").alias("n"))


@both("""SELECT o_orderkey AS slug, '    <item>' || chr(10) || '      <title>' || o_orderpriority || ' &amp; x</title>' || chr(10) || '      <link>https://s.example/blog/' || o_orderkey || '/</link>' || chr(10) || '      <guid isPermaLink="true">https://s.example/blog/' || o_orderkey || '/</guid>' || chr(10)
 || '      <pubDate>' || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate>' || chr(10) || '      <description>d</description>' || chr(10) || '    </item>' AS item FROM orders""")
def feed_of_posts(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), F.concat("o_orderpriority", F.lit(" & x")).alias("title"), F.lit("d").alias("description"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return feeds.feed_items(o, "https://s.example").select("slug", "item")


@both("SELECT o_orderkey AS slug, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)::INT AS rank FROM orders")
def posts_in_order(spark, d):
    p = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderdate").alias("date"))
    return index.dense_index(p, reports.posts_order()).select("slug", (F.col("idx") + 1).cast("int").alias("rank"))


@both("SELECT l_orderkey, l_linenumber, array_to_string(list_filter(range(1, 10), lambda p: p = 1 OR p = 9 OR abs(p - l_linenumber) <= 2), ',') AS pages FROM lineitem")
def windows_of_pages(spark, d):
    shown = reports.page_window(F.col("l_linenumber").cast("int"), F.lit(9))
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(shown.cast("array<string>"), ",").alias("pages"))


_CHECKED = "SELECT c_custkey AS k, concat_ws('; ', CASE WHEN c_custkey % 5 = 0 THEN 'repo: must be owner/name' END, CASE WHEN c_nationkey < 3 THEN 'stars: must be at least 0' END, CASE WHEN c_custkey % 7 = 0 THEN 'defaultBranch: must be filled' END, CASE WHEN c_custkey % 11 = 0 THEN 'analyzedSha: must be 40 hex digits' END) AS issues FROM customer"


@both(_CHECKED)
def checked_repos(spark, d):
    k = F.col("c_custkey")
    rows = views.table(spark, d, "customer").select("c_custkey", F.when(k % 5 == 0, "no slash").otherwise("o/n").alias("repo"), F.lit(None).cast("string").alias("description"), F.lit("x").alias("language"), (F.col("c_nationkey") - 3).cast("int").alias("stars"), F.lit(1).alias("sourceFiles"), F.when(k % 7 == 0, "").otherwise("main").alias("defaultBranch"), F.when(k % 11 == 0, "abc").otherwise(F.sha1("c_name")).alias("analyzedSha"), F.lit("2024-01-02T03:04:05Z").alias("analyzedAt"), F.lit(0).alias("errorCount"))
    keyed = rows.withColumn("description", k.cast("string")).select(*REPO.fieldNames())
    return validate_repos(keyed).select(F.col("description").cast("long").alias("k"), F.array_join("issues", "; ").alias("issues"))


@both("SELECT item_id AS k, concat_ws('; ', CASE WHEN item_id % 4 = 0 THEN 'slug: must be kebab-case' END, CASE WHEN item_id % 3 = 0 THEN 'summary: must be filled' END, CASE WHEN item_id % 5 = 0 THEN 'fixes: has a bad item' END) AS issues FROM benchmark")
def checked_pages(spark, d):
    k = F.col("item_id")
    rows = views.table(spark, d, "benchmark").select(F.when(k % 4 == 0, "Bad Slug").otherwise("good-slug").alias("slug"), k.cast("string").alias("clusterKey"), F.lit("t").alias("title"), F.when(k % 3 == 0, "").otherwise("s").alias("summary"), F.lit("b").alias("background"), F.array(F.struct(F.lit("c").alias("cause"), F.lit("d").alias("detail"))).alias("commonCauses"), F.array(F.when(k % 5 == 0, "").otherwise("f")).alias("fixes"), F.array().cast("array<string>").alias("guideSlugs"), F.array().cast("array<string>").alias("errorIds"), F.lit(1).alias("errorCount"), F.lit(1).alias("repoCount"), F.lit("2024-01-02T03:04:05Z").alias("generatedAt"), F.lit(2).alias("schemaVersion"))
    return validate_info_pages(rows.select(*INFO_PAGE.fieldNames())).select(F.col("clusterKey").cast("long").alias("k"), F.array_join("issues", "; ").alias("issues"))


# queue and job log


@both(f"WITH s AS ({sql.SQL['seed_queue']}) SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'requeued') AS requeued FROM s")
def seeded(spark, d):
    corpus = views.table(spark, d, "orders").select((F.col("o_custkey") * 2).cast("string").alias("repo"))
    return queue.seed_summary(queue.seed(views.queue(spark, d), corpus, NOW))


@both(f"WITH {sql._QUEUE} SELECT repo, CASE WHEN repo = '5' AND status = 'queued' OR status = 'running' AND repo <> '5' THEN CASE WHEN repo = '5' THEN 'running' ELSE 'queued' END ELSE status END AS status, (attempts + CASE WHEN repo = '5' AND status = 'queued' THEN 1 ELSE 0 END)::INT AS attempts, CASE WHEN repo = '5' AND status = 'queued' THEN {NOW + 1} WHEN status = 'running' THEN {NOW} ELSE updated_at END AS updated_at FROM q")
def reclaimed_and_claimed(spark, d):
    """Rows of a dead run queued again, then one claimed."""
    return queue.claim(queue.reclaim(views.queue(spark, d), NOW), "5", NOW + 1).select("repo", "status", "attempts", "updated_at")


@both(f"WITH {sql._REPOS} SELECT r.repo, CASE WHEN c_custkey IS NOT NULL AND analyzed_sha IS NULL THEN 'failed' ELSE 'analyzed' END AS status, CASE WHEN c_custkey IS NOT NULL THEN 'late' END AS last_error FROM r LEFT JOIN customer c ON c_custkey = r.n AND c_nationkey % 2 = 0")
def failures_keep_versions(spark, d):
    repos = views.repos(spark, d).withColumn("status", F.lit("analyzed")).withColumn("last_error", F.lit(None).cast("string"))
    failed = views.table(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("repo"), F.lit("late").alias("error"))
    return queue.after_failure(repos, failed).select("repo", "status", "last_error")


@both(f"WITH {sql._QUEUE} SELECT DISTINCT repo FROM (SELECT o_custkey::VARCHAR AS repo FROM orders UNION ALL SELECT repo FROM q WHERE status = 'failed') WHERE repo NOT IN (SELECT repo FROM q WHERE status IN ('queued', 'running'))")
def requested_repos(spark, d):
    q = views.queue(spark, d)
    return queue.requested(views.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("repo")), q.where("status = 'failed'"), q.where("status in ('queued', 'running')"))


@both("SELECT o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1")
def scan_summary(spark, d):
    return queue.summary(views.table(spark, d, "orders").select(F.col("o_orderstatus").alias("outcome")))


@both(f"WITH {sql._JOBS}, k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id DESC) AS n FROM jobs), x AS (SELECT repo, string_agg(phase || ':' || status, ',' ORDER BY n) AS recent FROM k WHERE n <= 5 GROUP BY repo) SELECT c_custkey::VARCHAR AS repo, recent FROM customer LEFT JOIN x ON x.repo = c_custkey::VARCHAR")
def status_of_repos(spark, d):
    repos = views.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("repo"))
    return jobs.status_table(repos, views.jobs(spark, d)).select("repo", _joined("recent"))


@both(f"WITH {sql._JOBS} SELECT id, repo FROM jobs WHERE id % 4 <> 0 OR repo IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_nationkey = 1)")
def log_without_orphans(spark, d):
    log = views.jobs(spark, d).withColumn("status", F.when(F.col("id") % 4 == 0, "running").otherwise(F.col("status")))
    protected = views.table(spark, d, "customer").where("c_nationkey = 1").select(F.col("c_custkey").cast("string").alias("repo"))
    return jobs.without_orphans(log, protected).select("id", "repo")


@both("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_by_hour(spark, d):
    return event_windows(views.table(spark, d, "events").select("ts", "event_type")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@both("SELECT count(*) FILTER (doc_id % 4 <> 1 AND doc_id * 3 % 700 IN (SELECT doc_id FROM documents)) AS applied, count(*) FILTER (doc_id % 4 = 1 OR doc_id * 3 % 700 NOT IN (SELECT doc_id FROM documents)) AS rejected FROM documents")
def patch_counts(spark, d):
    p = views.table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("d"), (F.col("doc_id") * 3 % 700).cast("string")).alias("id"), F.when(F.col("doc_id") % 4 == 0, "exampleFix").when(F.col("doc_id") % 4 == 1, "id").otherwise("documentation").alias("field"), F.col("source").alias("value"))
    return verify.apply_patches(views.records(spark, d).select("id", "documentation", F.lit("old").alias("exampleFix")), p)[1]


# rules of scans


@both("SELECT p_partkey, p_size * 20 > 500 OR p_partkey % 4000 > 3000 AS large, p_partkey % 100 > 0 AND p_size > greatest(20.0, p_partkey % 100 * 0.25) AS wide, CASE WHEN p_size % 3 = 0 THEN 'candidates' WHEN p_size % 3 = 1 THEN 'delta-no-candidates' WHEN p_partkey % 10 < 5 THEN 'skipped-low-source' ELSE 'agentic' END AS mode FROM part")
def scan_sizes(spark, d):
    size, k = F.col("p_size"), F.col("p_partkey")
    mode = rules.discovery_mode(F.when(size % 3 == 0, 1).otherwise(0), size % 3 == 1, k % 10)
    return views.table(spark, d, "part").select("p_partkey", rules.needs_large_slot(size * 20, k % 4000).alias("large"), rules.too_large_to_patch(size, k % 100).alias("wide"), mode.alias("mode"))


@both("SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 2 THEN 0 WHEN event_id % 3 = 1 THEN user_id ELSE user_id + 1 END::BIGINT AS seconds FROM events")
def cache_times(spark, d):
    u = F.col("user_id").cast("string")
    control = F.when(F.col("event_id") % 3 == 2, F.lit("no-store, max-age=9")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("public, max-age="), u)).otherwise(F.concat(F.lit("max-age=5, s-maxage="), (F.col("user_id") + 1).cast("string")))
    return views.table(spark, d, "events").select("event_id", rules.cache_seconds(F.when(F.col("event_id") % 5 == 0, 404).otherwise(200), control, F.lit(False)).alias("seconds"))


@both(f"""WITH {sql._JOBS}, i AS (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY started_at, id) AS island FROM jobs),
s AS (SELECT repo, id, started_at, status, sum(CASE WHEN status = 'success' THEN 0 ELSE 1 END) OVER (PARTITION BY repo, island ORDER BY started_at, id)::BIGINT AS streak FROM i),
b AS (SELECT *, coalesce(lag(streak) OVER (PARTITION BY repo ORDER BY started_at, id), 0) AS before FROM s)
SELECT repo, id, before AS streak, 'recovered' AS note FROM b WHERE status = 'success' AND before >= 2 UNION ALL SELECT repo, id, streak, 'failing' FROM b WHERE status <> 'success' AND (streak = 2 OR streak % 12 = 0)""")
def notes_of_runs(spark, d):
    return jobs.alerts(views.jobs(spark, d), ["repo"]).select("repo", "id", "streak", "note")


class _Narrow:
    """A model that takes at most twelve numbers at once, and none that 97 divides."""

    def ask(self, prompt: str) -> str:
        said = prompt.split(",")
        if len(said) > 12:
            raise TimeoutError("too many")
        return "no" if any(int(x) % 97 == 0 for x in said) else f'{{"n": {len(said)}, "first": {said[0]}}}'


@both("""WITH RECURSIVE b AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 40 AS key, o_orderkey AS k FROM orders WHERE o_orderkey IS NOT NULL),
u AS (SELECT key, 0 AS "at", list(k ORDER BY k) AS items FROM b GROUP BY key
 UNION ALL SELECT key, "at" + CASE WHEN side = 0 THEN 0 ELSE (len(items) + 1) // 2 END, CASE WHEN side = 0 THEN items[1:(len(items) + 1) // 2] ELSE items[(len(items) + 1) // 2 + 1:] END
 FROM u, (SELECT unnest([0, 1]) AS side) WHERE len(items) >= 10 AND (len(items) > 12 OR len(list_filter(items, lambda x: x % 97 = 0)) > 0)),
f AS (SELECT *, len(items) > 12 AS many, len(list_filter(items, lambda x: x % 97 = 0)) > 0 AS odd FROM u)
SELECT key, "at"::INT AS "at", CASE WHEN NOT odd THEN len(items) END::BIGINT AS n, CASE WHEN NOT odd THEN items[1] END::BIGINT AS first, len(items)::INT AS size FROM f WHERE NOT (len(items) >= 10 AND (many OR odd))""")
def halved_batches(spark, d):
    """Batches of forty asked of a model that takes twelve: halved until they work, or are too short to be halved."""
    o = views.table(spark, d, "orders").where("o_orderkey is not null").select((F.col("o_orderkey")).alias("ord"))
    b = index.dense_index(o, "ord").select(F.floor(F.col("idx") / 40).cast("long").alias("key"), "ord")
    b = b.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")).alias("items"))
    got = oracle.ask_batches(b, [_Narrow()], scratch(spark, "asked"), 8, lambda items: F.array_join(items, ","), deep=True)
    return got.select("key", "at", F.get_json_object("json", "$.n").cast("long").alias("n"), F.get_json_object("json", "$.first").cast("long").alias("first"), F.size("items").alias("size"))


@both("""WITH t AS (SELECT DISTINCT l_suppkey AS n FROM lineitem), a AS (SELECT s_suppkey AS n, s_suppkey % 6 AS k FROM supplier)
SELECT a.n::VARCHAR AS repo, CASE WHEN k < 2 AND t.n IS NOT NULL THEN 'src/s' || a.n || ',src' WHEN k = 5 THEN '' END AS include, CASE WHEN k < 2 AND t.n IS NOT NULL THEN CASE WHEN k = 0 THEN 'src' ELSE '' END WHEN k = 5 THEN '' END AS exclude,
 CASE WHEN k < 2 AND t.n IS NULL THEN 'includeRoots:./src' WHEN k = 2 THEN 'excludeDirs:../x' WHEN k = 3 THEN 'json' WHEN k = 4 THEN 'includeRoots:/src' END AS error FROM a LEFT JOIN t USING (n)""")
def checked_scopes(spark, d):
    """Scope answers, good and bad, against the directories of their projects."""
    n = F.col("s_suppkey")
    good = F.concat(F.lit('{"includeRoots":["src/s'), n.cast("string"), F.lit('//","./src"]'))
    bodies = [F.concat(good, F.lit(',"excludeDirs":["src/"]}')), F.concat(good, F.lit("}")), F.lit('{"excludeDirs":["../x"]}'), F.lit('["src"]'), F.lit('{"includeRoots":["/src"]}'), F.lit('{"includeRoots":null}')]
    answers = views.table(spark, d, "supplier").select(n.cast("string").alias("repo"), F.element_at(F.array(*bodies), (n % 6 + 1).cast("int")).alias("json"))
    shown = views.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("repo")).distinct()
    trees = shown.select("repo", F.explode(F.array(F.lit("src"), F.concat(F.lit("src/s"), "repo"))).alias("path"))
    return extract.check_scopes(answers, trees).select("repo", F.array_join("includeRoots", ",").alias("include"), F.array_join("excludeDirs", ",").alias("exclude"), "error")


# drafts, resets, accounts, pages


@both(f"""WITH {_SAMPLED}, g AS (SELECT key, unnest({sql._guide_list("NULL::VARCHAR", "substr(text, 1, 300)")}) AS guide FROM sm UNION ALL SELECT key, 'timeouts' FROM clusters WHERE kind = 'class')
SELECT 's-' || value AS slug, 't' AS title, '' AS summary, (SELECT string_agg(DISTINCT guide, ',' ORDER BY guide) FROM g WHERE g.key = c.key) AS guides, (SELECT string_agg(id, ',' ORDER BY rank) FROM sm WHERE sm.key = c.key AND rank <= 20) AS ids, "errorCount"::INT AS n FROM clusters c WHERE kind = 'class'""")
def drafted_pages(spark, d):
    """Pages from drafts that name one guide that there is, and one that isn't."""
    chosen = _clusters(spark, d, "class")
    drafts = chosen.select("key", F.concat(F.lit("s-"), "value").alias("slug"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit("b").alias("background"), F.lit(None).cast("array<struct<cause:string,detail:string>>").alias("commonCauses"), F.lit(None).cast("array<string>").alias("fixes"), F.array(F.lit("timeouts"), F.lit("no-such")).alias("guideSlugs"))
    pages = cluster.drafted_pages(chosen, cluster.samples(views.records(spark, d), chosen), drafts, "2024-01-02T03:04:05Z", most_ids=20)
    return pages.select("slug", "title", "summary", F.array_join("guideSlugs", ",").alias("guides"), F.array_join("errorIds", ",").alias("ids"), F.col("errorCount").alias("n"))


def _reset(spark, d):
    repos = views.repos(spark, d).select("repo", F.lit("analyzed").alias("status"), "analyzed_sha", F.col("error_count").cast("long").alias("error_count"), F.lit("x").alias("last_error"))
    records = views.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("repo"), "o_orderkey")
    which = views.table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("repo"))
    return queue.reset(repos, records, views.jobs(spark, d), which)


_WHICH = "w AS (SELECT c_custkey AS n FROM customer WHERE c_nationkey < 5)"


@both(f"WITH {sql._REPOS}, {_WHICH} SELECT r.repo, CASE WHEN w.n IS NULL THEN 'analyzed' ELSE 'pending' END AS status, CASE WHEN w.n IS NULL THEN analyzed_sha END AS analyzed_sha, CASE WHEN w.n IS NULL THEN error_count ELSE 0 END AS error_count, CASE WHEN w.n IS NULL THEN 'x' END AS last_error FROM r LEFT JOIN w ON w.n = r.n")
def reset_repos(spark, d):
    return _reset(spark, d)[0]


@both(f"WITH {sql._REPOS}, {_WHICH} SELECT r.repo, error_count AS \"errorsDeleted\", (SELECT count(*) FROM events WHERE user_id = r.n) AS \"jobsDeleted\" FROM r JOIN w ON w.n = r.n")
def reset_summary(spark, d):
    return _reset(spark, d)[3]


@both(f"""WITH p AS ({sql.SQL["rescan_plan"]}), k AS (SELECT ("filePath"::BIGINT % 10)::VARCHAR AS repo, count(*) FILTER (disposition = 'carryOver') AS a, count(*) FILTER (disposition = 'remapped') AS b, count(*) FILTER (disposition = 'dropped') AS c FROM p GROUP BY 1),
f AS (SELECT (o_custkey % 12)::VARCHAR AS repo, count(*) FILTER (o_orderkey % 3 = 0) AS r, count(*) FILTER (o_orderkey % 3 <> 0) AS s FROM orders GROUP BY 1)
SELECT coalesce(k.repo, f.repo) AS repo, coalesce(a, 0) AS "carriedOver", coalesce(b, 0) AS remapped, coalesce(c, 0) AS dropped, coalesce(r, 0) AS reused, coalesce(s, 0) AS fresh FROM k FULL JOIN f ON k.repo = f.repo""")
def incremental_accounts(spark, d):
    plan = rescan.plan_rescan(views.lines(spark, d).distinct(), views.diffs(spark, d)).withColumn("repo", (F.col("filePath").cast("long") % 10).cast("string"))
    found = views.table(spark, d, "orders").select((F.col("o_custkey") % 12).cast("string").alias("repo"), (F.col("o_orderkey") % 3 == 0).alias("reuse"))
    return rescan.accounting(plan, found)


@both(f"WITH {sql._JOBS} SELECT repo, phase, status, duration_ms FROM jobs UNION ALL SELECT o_custkey::VARCHAR, 'verify', 'success', o_orderkey % 50 FROM orders")
def recorded_runs(spark, d):
    o = views.table(spark, d, "orders")
    new = o.select(F.col("o_custkey").cast("string").alias("repo"), F.lit("verify").alias("phase"), F.lit("success").alias("status"), F.col("o_orderkey").alias("started_at"), (F.col("o_orderkey") + F.col("o_orderkey") % 50).alias("completed_at"))
    return jobs.record_runs(views.jobs(spark, d), new).select("repo", "phase", "status", "duration_ms")


@both("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey % 3) AS o FROM lineitem WHERE l_orderkey % 5 < 3 GROUP BY ALL)
SELECT 'src/f' || k || '.c' AS path, i::INT AS line, 'k' || o AS kind, 'throw "text of ' || i || '"' AS snippet, 'text of ' || i AS literal, greatest(1, i - 2)::INT AS start, (i - greatest(1, i - 2) + 2)::INT AS lines FROM x""")
def sites_of_grep(spark, d):
    """Payloads of a grep, absolute paths among them, some excluded or outside of the tree."""
    li = views.table(spark, d, "lineitem")
    i, k = F.col("l_linenumber").cast("int"), F.col("l_orderkey")
    start = F.greatest(F.lit(1), i - 2)
    lines = F.transform(F.sequence(start, i + 1), lambda n: F.concat(F.lit('  throw "text of '), n.cast("string"), F.lit('"')))
    folder = F.when(k % 5 == 0, "/tree/src/f").when(k % 5 < 3, "src/f").when(k % 5 == 3, "/other/src/f").otherwise("src/tests/f")
    r = F.struct(F.concat(folder, k.cast("string"), F.lit(".c")).alias("path"), i.alias("line"), F.struct(lines.alias("lines"), F.array(F.lit(0)).alias("matched_lines"), start.alias("start_line")).alias("context"))
    o = F.col("l_partkey") % 3
    # a payload is what a grep answers for a project, here a hundred files: payloads grow in number, not in size
    bodies = li.groupBy(o.alias("ordinal"), F.floor(k / 100).alias("part")).agg(F.to_json(F.struct(F.collect_list(r).alias("results"))).alias("json"))
    found = extract.grep_sites(bodies.select(F.concat(F.lit("k"), F.col("ordinal").cast("string")).alias("kind"), "ordinal", "json"), root="/tree")
    return found.select("path", "line", "kind", "snippet", "literal", F.col("context.start").alias("start"), F.size("context.lines").alias("lines"))


@both(f"WITH t AS ({sql.SQL['scope_tally']}) SELECT 'scope: excluded ' || n || ' candidate location(s) under ' || top || '/' AS line FROM t")
def scope_lines(spark, d):
    return extract.scope_log(QUERIES["scope_tally"](spark, d))


_FIXED = ["/about/", "/request-crawl/", "/api-docs/", "/blog/", "/guides/", "/troubleshooting/", "/info/"] + [f"/guides/{g[0]}/" for g in rules.GUIDES]


@both(f"WITH h AS ({sql.SQL['page_links']}), p AS (SELECT href AS path FROM h UNION ALL SELECT unnest([{', '.join(sql._quote(p) for p in _FIXED)}]) UNION ALL SELECT '/blog/p' || o_orderkey || '/' FROM orders UNION ALL SELECT '/info/i' || item_id || '/' FROM benchmark) SELECT path, '  <url><loc>https://s.example' || path || '</loc></url>' AS line FROM p")
def sitemap_of_pages(spark, d):
    posts = views.table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("slug"))
    pages = views.table(spark, d, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("slug"))
    return feeds.pages_sitemap(reports.errors_by_repo(views.entries(spark, d)), posts, pages, "https://s.example")


@both(f"WITH {sql._RECORDS} SELECT doc_id, md5(CASE WHEN code <> '' THEN code || ': ' || text ELSE text END || ' — ' || repo || ' | Site') AS title, md5(substr(text, 1, 155)) AS description, '/og/repo-' || tag || '-' || cls || '.png' AS card, '/og/blog-' || cls || '.png' AS post, '/guides/' || cls || '/' AS guide FROM records")
def texts_of_pages(spark, d):
    r = views.records(spark, d)
    title = text.page_title(F.col("errorCode"), F.col("errorMessage"), F.col("repo"), "Site")
    return r.select("doc_id", F.md5(title).alias("title"), F.md5(text.page_description(F.col("documentation"))).alias("description"), text.repo_card(F.col("repo")).alias("card"), text.post_card(F.col("errorClass")).alias("post"), text.page_path("guides", F.col("errorClass")).alias("guide"))


@both(f"WITH {sql._MADE} SELECT id, repo || ' — ' || text AS about, 'https://example.org/' || repo || '/' AS parent, 'What causes \"' || text || '\" in ' || repo || '?' AS question FROM made")
def linked_data(spark, d):
    body = _assembled(spark, d).select("id", text.page_data().alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return body.select("id", at("$['@graph'][1].about").alias("about"), at("$['@graph'][0].itemListElement[1].item").alias("parent"), at("$['@graph'][2].mainEntity[0].name").alias("question"))


@both("SELECT doc_id, i::BIGINT AS n FROM (SELECT doc_id, unnest(range(3)) AS i FROM documents) WHERE i <> doc_id % 3")
def answers_by_number(spark, d):
    """Items of answers whose number isn't one are left out."""
    items = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit('{"errorIndex":'), F.when(i == F.col("doc_id") % 3, F.lit("null")).otherwise(i.cast("string")), F.lit(',"severity":"error"}')))
    body = F.concat(F.lit('{"enriched":['), F.array_join(items, ","), F.lit("]}"))
    rows = views.table(spark, d, "documents").select("doc_id", F.explode(payloads.by_number(body, "enriched", "severity:string")).alias("e"))
    return rows.select("doc_id", F.col("e.errorIndex").cast("long").alias("n"))


@both(f"""WITH {sql._QUEUE}, s AS ({sql.SQL['seed_queue']}) SELECT repo, CASE WHEN status IN ('queued', 'running') THEN CASE WHEN repo::BIGINT % 10 = 0 THEN 'failed' WHEN repo::BIGINT % 10 = 1 THEN 'skipped' ELSE 'done' END ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN (attempts + 1)::INT ELSE attempts END AS attempts FROM s""")
def drained_queue(spark, d):
    """Seeded, reclaimed and drained, claims committed first: runs fail, skip or succeed by name."""

    def run(claimed):
        n = F.col("repo").cast("long") % 10
        return claimed.select("repo", F.when(n == 0, "failed").when(n == 1, "skipped").otherwise("done").alias("outcome"), F.when(n == 0, "bad answer").alias("error"), F.col("solo").alias("ran_at"), F.lit(False).alias("held_large"))

    corpus = views.table(spark, d, "orders").select((F.col("o_custkey") * 2).cast("string").alias("repo"))
    q = views.queue(spark, d).withColumn("solo", F.lit(0))
    table = Keyed(spark, scratch(spark, "drain"), ["repo"], q.schema)
    table.commit(q)
    drain.drain(table, corpus, views.repos(spark, d), run, lambda: NOW, drain.Limits(slots=100_000, breaker=1 << 30))
    return table.read().select("repo", "status", "attempts")


@both("SELECT c_custkey AS k FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'FURNITURE'")
def looked_up(spark, d):
    return state.lookup(views.table(spark, d, "customer"), c_nationkey=7, c_mktsegment="FURNITURE").select(F.col("c_custkey").alias("k"))
