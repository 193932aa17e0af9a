"""The queries of mishap.plans.queries as DuckDB SQL."""

from __future__ import annotations

from mishap.functions.rules import AGENTS, GENERIC_FAMILIES, GUIDES, HOST_FAULT
from mishap.operators.extract import SKIPPED_DIRS, TEST_DIR, TEST_FILE

NOW = 200_000_000
MARKS = ["the ", "und ", "que ", "les ", "of ", "con ", "@", "http", "#", "!", "0", "7"]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form(x: str) -> str:
    x = f"lower({x})"
    for pattern in (r"/[\w./-]+", "0x[0-9a-f]+", r"\b\d+\b", "'[^']*'|\"[^\"]*\"", "[^a-z ]+", r"\s+"):
        x = f"regexp_replace({x}, {_quote(pattern)}, ' ', 'g')"
    return f"trim({x})"


def _codes(x: str) -> str:
    return f"list_concat(regexp_extract_all({x}, '\\b[A-Z][A-Z0-9_]{{2,}}\\b'), regexp_extract_all({x}, '\\bE[A-Z]+\\b'))"


def _code(x: str) -> str:
    return f"({_codes(x)})[1]"


def _kebab(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _slug(x: str) -> str:
    return f"coalesce(nullif({_kebab(f'substr({x}, 1, 50)')}, ''), 'error')"


def _id(repo: str, key: str, path: str) -> str:
    return f"substr(sha256({repo} || chr(1) || {key} || chr(1) || {path}), 1, 16)"


def _escape(x: str) -> str:
    return f"regexp_replace({x}, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"


def _derived(x: str) -> str:
    for pattern in (r"\$\{[^}]*\}", r"%\([^)]*\)[sdifge]", "%[sdifjv]", r"\{[^}]*\}"):
        x = f"regexp_replace({x}, {_quote(pattern)}, chr(1), 'g')"
    return f"replace({_escape(x)}, chr(1), '(.+?)')"


def _weight(x: str) -> str:
    return f"length(trim(regexp_replace(replace({x}, '(.+?)', ''), '\\\\(.)', '\\1', 'g')))"


def _good(p: str) -> str:
    return f"({_weight(p)} >= 6 AND length({p}) <= 500 AND NOT regexp_matches({p}, '\\\\[1-9]') AND NOT regexp_matches({p}, '\\([^()]*[+*?][^()]*\\)[+*?{{]'))"


def _guide_list(code: str, msg: str) -> str:
    tests = []
    for slug, codes, words in GUIDES:
        hit = f"regexp_matches({msg}, {_quote('(?i)' + words)})"
        if codes:
            hit = f"(coalesce(regexp_matches({code}, {_quote(codes)}), false) OR {hit})"
        tests.append(f"CASE WHEN {hit} THEN '{slug}' END")
    return f"list_filter([{', '.join(tests)}], lambda g: g IS NOT NULL)"


_ENTRIES = f"entries AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, lang || '/' || source AS repo, {_code('text')} AS code, text AS msg FROM documents)"
_TOKENS = f"tokens AS (SELECT DISTINCT idx, token FROM (SELECT idx, unnest(string_split({_form('msg')}, ' ')) AS token FROM entries) WHERE token <> '')"
_WEIGHTS = "n AS (SELECT count(*) AS n FROM entries), weights AS (SELECT token, count(*) AS df, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf, floor((ln((any_value(n.n) + 1) / (count(*) + 1)) + 1) * 100 + 0.5)::BIGINT AS weight FROM tokens, n GROUP BY token)"
_NORMS = "norms AS (SELECT idx, floor(sqrt(sum(idf * idf)) * 100 + 0.5)::BIGINT AS norm FROM tokens JOIN weights USING (token) GROUP BY idx)"
_MESSAGES = f"""sentences AS (SELECT doc_id, lang || '/' || source AS repo, unnest(range(len(p))) AS pos, unnest(list_transform(p, lambda x: trim(x))) AS msg FROM (SELECT *, string_split_regex(text, '[.\\n]') AS p FROM documents)),
entries AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS idx, *, {_code('msg')} AS code, {_id('repo', 'msg', "'doc'")} AS id, CASE WHEN {_good(_derived('msg'))} THEN {_derived('msg')} ELSE {_escape('msg')} END AS pattern
  FROM (SELECT msg, min(doc_id * 1000000 + pos) AS ord, arg_min(repo, doc_id * 1000000 + pos) AS repo FROM sentences WHERE msg <> '' GROUP BY msg))"""
_QUERIES = "queries AS (SELECT qid, text || CASE WHEN regexp_matches(text, '^[A-Za-z]+ ') THEN ' ' || upper(string_split(text, ' ')[1]) ELSE '' END AS text FROM (SELECT item_id * 1000000 + unnest(range(len(p))) AS qid, unnest(list_transform(p, lambda x: trim(x))) AS text FROM (SELECT *, string_split_regex(text, '[.\\n]') AS p FROM benchmark)) WHERE text <> '')"
_ASKED = f"asked AS (SELECT DISTINCT qid, token FROM (SELECT qid, unnest(string_split({_form('text')}, ' ')) AS token FROM queries) WHERE token <> '')"
_EXACT = f"exact AS (SELECT DISTINCT qid, idx FROM (SELECT qid, unnest({_codes('text')}) AS code FROM queries) q JOIN entries e ON q.code = e.code AND e.code <> '')"
_COSINE = """cosine AS (SELECT qid, idx, round(dot / (norm / 100 * qnorm), 9) AS score FROM
  (SELECT qid, sqrt(sum(w * w)) AS qnorm FROM (SELECT qid, coalesce(weight / 100, ln(n.n + 1) + 1) AS w FROM asked LEFT JOIN weights USING (token), n) GROUP BY qid) q
  JOIN (SELECT qid, idx, sum(weight / 100 * weight / 100) AS dot FROM asked JOIN weights USING (token) JOIN tokens USING (token) GROUP BY qid, idx) d USING (qid) JOIN norms USING (idx) WHERE norm > 0)"""
_JACCARD = """jaccard AS (SELECT * FROM (SELECT qid, idx, round(inter / (wq + we - inter), 9) AS score FROM
  (SELECT qid, idx, sum(idf) AS inter FROM asked JOIN weights USING (token) JOIN tokens USING (token) GROUP BY qid, idx)
  JOIN (SELECT qid, sum(coalesce(idf, 1.0)) AS wq FROM asked LEFT JOIN weights USING (token) GROUP BY qid) USING (qid)
  JOIN (SELECT idx, sum(idf) AS we FROM tokens JOIN weights USING (token) GROUP BY idx) USING (idx)) WHERE score >= 0.4)"""
# a text with a match holds the pattern's longest literal: pairs are joined on that before the pattern is tried
_PATTERN = f"""pieces AS MATERIALIZED (SELECT idx, pattern, list_transform(string_split(pattern, '(.+?)'), lambda x: regexp_replace(x, '\\\\(.)', '\\1', 'g')) AS l FROM entries WHERE length(pattern) <= 500 AND {_weight('pattern')} >= 6),
longest AS MATERIALIZED (SELECT idx, pattern, list_reduce(l, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) AS piece FROM pieces),
near AS MATERIALIZED (SELECT qid, idx, text, pattern FROM queries JOIN longest ON contains(text, piece)),
pattern AS (SELECT qid, idx FROM near WHERE regexp_matches(text, pattern))"""
_SEARCH = ",\n".join([_MESSAGES, _QUERIES, _TOKENS, _WEIGHTS, _NORMS, _ASKED])
_RECORDS = f"records AS (SELECT doc_id, 'd' || doc_id AS id, lang || '/' || source AS repo, {_code('text')} AS code, source AS cls, lang AS tag, text FROM documents)"
_MEMBERS = """members AS (SELECT *, 'code' AS kind, code AS value FROM records WHERE code <> '' UNION ALL
  SELECT *, 'class', cls FROM records WHERE coalesce(code, '') = '' AND cls <> '' UNION ALL SELECT *, 'tag', tag FROM records WHERE tag <> ''),
clusters AS (SELECT kind || ':' || value AS key, kind, value, count(*) AS "errorCount", count(DISTINCT repo) AS "repoCount" FROM members GROUP BY kind, value HAVING count(*) >= 5 AND count(DISTINCT repo) >= 2)"""
_GUIDES = f"""p AS (SELECT page_id AS idx, regexp_extract(url, '://([^/?#:]*)', 1) AS repo, {_code('html')} AS code,
  concat_ws(' ', html, CASE WHEN page_id % 5 = 0 THEN 'connection reset' WHEN page_id % 5 = 1 THEN 'request timed out' END) AS msg FROM pages),
m AS (SELECT unnest({_guide_list('code', 'msg')}) AS guide, idx, repo FROM p)"""
_JOBS = "jobs AS (SELECT event_id AS id, user_id::VARCHAR AS repo, event_type AS phase, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status, epoch_ms(date_trunc('hour', ts)) AS started_at, event_id % 1000 AS duration_ms FROM events)"
_AGENT = "CASE WHEN coalesce(ua, '') = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(ua, {_quote('(?i)' + p)}) THEN '{c}'" for c, p in AGENTS) + " ELSE 'human' END"
_HOST, _PATH = "coalesce(regexp_extract(url, '://([^/?#:]*)', 1), '')", "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
_QUEUE = """q AS (SELECT c_custkey AS n, c_custkey::VARCHAR AS repo, c_nationkey AS priority, ['queued', 'running', 'done', 'failed', 'skipped'][c_custkey % 5 + 1] AS status, (c_custkey % 4)::INT AS attempts, (c_custkey % 3)::INT AS solo,
  CASE WHEN c_custkey % 5 = 3 THEN 'cannot fork' END AS last_error, c_custkey * 3600000 % 172800000 AS updated_at FROM customer)"""
_REPOS = "r AS (SELECT o_custkey AS n, o_custkey::VARCHAR AS repo, CASE WHEN count(*) > 5 THEN sha1(o_custkey::VARCHAR) END AS analyzed_sha, count(*) AS error_count, max(o_orderdate) AS analyzed_at FROM orders GROUP BY o_custkey)"
_DIFFS = "h AS (SELECT l_orderkey AS k, (l_linenumber * 10 + 2)::BIGINT AS s, l_quantity::BIGINT % 3 AS ol, l_quantity::BIGINT % 5 AS nl FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'D' ELSE 'M' END AS status FROM h GROUP BY k)"
_FILES = "t AS (SELECT string_split(regexp_extract(url, '://([^/?#:]*)', 1) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || '.py', '/') AS p, regexp_extract(url, '://([^/?#:]*)', 1) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || '.py' AS path FROM pages)"
_BAD_DIR = "list_contains([" + ", ".join(_quote(x) for x in SKIPPED_DIRS) + f"], x) OR regexp_matches(x, {_quote(TEST_DIR)})"
_SEEN = f"len(list_filter(p[:len(p) - 1], lambda x: {_BAD_DIR})) = 0 AND len(list_filter(p, lambda x: starts_with(x, '.'))) = 0 AND NOT regexp_matches(path, {_quote(TEST_FILE)}) AND regexp_matches(path, '[^/]\\.py$')"
_REGION = "greatest(1, {l} - 18) AS s, least(len(string_split(text, chr(10))), {l} + 18) AS e"
_MADE = f"""made AS (SELECT doc_id, lang || '/' || source AS repo, text, {_id("lang || '/' || source", 'text', "'f' || doc_id")} AS id, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4)::INT END AS line, (n_chars % 700)::INT AS http, doc_id % 2 = 0 AS bad, doc_id % 3 = 0 AS defended FROM documents),
region AS (SELECT *, CASE WHEN line IS NOT NULL THEN greatest(1, line - 18) END AS s, CASE WHEN line IS NOT NULL THEN least(len(string_split(text, chr(10))), line + 18) END AS e FROM made),
checked AS (SELECT *, http < 100 OR http > 599 AS bad_http, text = '' AS empty_text, coalesce(line < s, false) AS bad_line, coalesce(e < s, false) AS bad_end FROM region)"""

SQL = {
    "entries_normalized": f"SELECT doc_id, {_form('text')} AS form FROM documents",
    "code_tokens": f"SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({_codes('text')}) AS token FROM documents)",
    "doc_frequency_idf": f"WITH {_ENTRIES}, {_TOKENS}, {_WEIGHTS} SELECT token, df, round(idf, 9) AS idf, weight FROM weights",
    "posting_lists": f"WITH {_ENTRIES}, {_TOKENS}, {_WEIGHTS} SELECT (list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(token, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 256)::INT AS shard, token, weight, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS entries FROM tokens JOIN weights USING (token) GROUP BY token, weight",
    "entry_norms": f"WITH {_ENTRIES}, {_TOKENS}, {_WEIGHTS}, {_NORMS} SELECT * FROM norms",
    "token_shards": f"WITH {_ENTRIES}, {_TOKENS}, s AS (SELECT token, (list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(token, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 256)::INT AS shard FROM (SELECT DISTINCT token FROM tokens)) SELECT token, shard, lower(printf('%02x', shard)) AS file FROM s",
    "code_index": f"WITH {_ENTRIES} SELECT code, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS entries FROM entries WHERE code <> '' GROUP BY code",
    "id_shards": f"""WITH {_ENTRIES}, i AS (SELECT idx, {_id('repo', 'coalesce(code, msg)', "'doc/' || doc_id")} AS id FROM entries) SELECT (('0x' || substr(id, 1, 2))::INT % 256)::INT AS shard, id, idx FROM i""",
    "meta_chunks": f"WITH {_MESSAGES} SELECT idx // 2000 AS chunk, count(*) AS n, min(msg) AS first FROM entries GROUP BY 1",
    "search_cosine": f"""WITH {_SEARCH}, {_EXACT}, {_COSINE},
hits AS (SELECT qid, idx, 1.0::DOUBLE AS score, 'exact-code' AS match, 0 AS tier FROM exact UNION ALL SELECT qid, idx, least(score, 1.0), 'fuzzy', 1 FROM cosine WHERE score >= 0.4 AND (qid, idx) NOT IN (SELECT (qid, idx) FROM exact)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, idx)::INT AS rank FROM hits)
SELECT qid, rank, idx, floor(score * 1000 + 0.5) / 1000 AS score, match FROM ranked WHERE rank <= 5""",
    "search_jaccard": f"WITH {_SEARCH}, {_JACCARD} SELECT qid, idx, floor(score * 1000 + 0.5) / 1000 AS score FROM jaccard",
    "search_exact_code": f"WITH {_MESSAGES}, {_QUERIES}, {_EXACT} SELECT * FROM exact",
    "search_pattern": f"WITH {_MESSAGES}, {_QUERIES}, {_PATTERN} SELECT * FROM pattern",
    "search_tiered": f"""WITH {_SEARCH}, {_EXACT}, {_PATTERN}, {_JACCARD},
hits AS (SELECT qid, idx, 1.0::DOUBLE AS score, 1 AS tier FROM exact UNION ALL SELECT qid, idx, 0.9, 2 FROM pattern UNION ALL SELECT qid, idx, score, 3 FROM jaccard),
best AS (SELECT *, min(tier) OVER (PARTITION BY qid) AS b FROM hits),
named AS (SELECT best.*, repo, row_number() OVER (PARTITION BY qid, id ORDER BY score DESC, idx) AS n FROM best JOIN entries USING (idx) WHERE tier = b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx)::INT AS rank FROM named WHERE n = 1)
SELECT qid, rank, idx, repo, floor(score * 1000 + 0.5) / 1000 AS score, ['exact-code', 'pattern', 'fuzzy'][tier] AS match FROM ranked WHERE rank <= 5""",
    "message_patterns": f"""WITH {_MESSAGES}, x AS (SELECT idx, msg || ' at ${{path}} in {{0}}: %s' AS t FROM entries), y AS (SELECT idx, t, {_derived('t')} AS d FROM x),
z AS (SELECT idx, CASE WHEN {_good('d')} THEN d ELSE {_escape('t')} END AS pattern, CASE WHEN {_good('d')} THEN 'derived' ELSE 'literal' END AS source FROM y) SELECT idx, pattern, source, {_weight('pattern')}::INT AS weight FROM z""",
    "clusters_code": f"WITH {_RECORDS}, {_MEMBERS} SELECT * FROM clusters WHERE kind = 'code'",
    "clusters_class": f"WITH {_RECORDS}, {_MEMBERS} SELECT * FROM clusters WHERE kind = 'class'",
    "clusters_union": f"WITH {_RECORDS}, {_MEMBERS} SELECT * FROM clusters",
    "clusters_new": f"WITH {_RECORDS}, {_MEMBERS} SELECT * FROM clusters WHERE NOT (kind = 'tag' AND value <> 'en') AND (kind = 'code' OR lower(value) NOT IN ({', '.join(map(_quote, GENERIC_FAMILIES))}))",
    "cluster_sample": f"WITH {_RECORDS}, {_MEMBERS}, s AS (SELECT c.key, m.id, m.repo, m.text, row_number() OVER (PARTITION BY c.key ORDER BY length(m.text) DESC, m.id)::INT AS rank FROM members m JOIN clusters c ON m.kind = c.kind AND m.value = c.value WHERE c.kind = 'class') SELECT key, rank, id, repo, md5(substr(text, 1, 300)) AS message, length(substr(text, 1, 1200))::INT AS n FROM s WHERE rank <= 30",
    "cluster_slugs": f"""WITH {_RECORDS}, {_MEMBERS} SELECT key, coalesce(nullif(regexp_replace(substr({_kebab('value')}, 1, 60), '-+$', ''), ''), 'cluster') AS slug FROM clusters""",
    "guide_matches": f"WITH {_GUIDES} SELECT * FROM m",
    "guide_top_repos": f"""WITH {_GUIDES}, g AS (SELECT guide, regexp_replace(repo, '^.*\\.', '') AS repo, idx FROM m), c AS (SELECT guide, repo, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY guide ORDER BY n DESC, repo)::INT AS repo_rank FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY guide, repo ORDER BY idx) AS r FROM g)
SELECT guide, repo_rank, repo, any_value(n) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS shown, greatest(any_value(n) - 5, 0) AS more FROM k JOIN s USING (guide, repo) WHERE repo_rank <= 10 AND r <= 5 GROUP BY guide, repo_rank, repo""",
    "related_by_tags": f"""WITH {_ENTRIES}, t AS (SELECT repo, doc_id AS id, idx, list_filter([{', '.join(_quote(m) for m in MARKS)}], lambda m: contains(msg, m)) AS tags FROM entries),
a AS (SELECT DISTINCT repo, id, unnest(tags) AS tag FROM t), b AS (SELECT repo, id AS other, idx, unnest(tags) AS tag FROM t),
p AS (SELECT a.id, b.other, b.idx, count(*) AS overlap FROM a JOIN b ON a.repo = b.repo AND a.tag = b.tag AND a.id <> b.other GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, idx)::INT AS rank FROM p) SELECT id, rank, other, overlap FROM k WHERE rank <= 5""",
    "latest_phase_run": f"WITH {_JOBS} SELECT repo, phase, id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY repo, phase ORDER BY started_at DESC, id DESC) = 1",
    "recent_phases": f"WITH {_JOBS}, k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id DESC) AS n FROM jobs) SELECT repo, string_agg(phase || ':' || status, ',' ORDER BY n) AS recent FROM k WHERE n <= 5 GROUP BY repo",
    "phase_duration_sum": f"WITH {_JOBS} SELECT phase, sum(duration_ms)::BIGINT AS ms FROM jobs WHERE status = 'success' GROUP BY phase",
    "failure_streaks": f"""WITH {_JOBS}, i AS (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY started_at, id) AS island FROM jobs),
s AS (SELECT repo, id, sum(CASE WHEN status = 'success' THEN 0 ELSE 1 END) OVER (PARTITION BY repo, island ORDER BY started_at, id)::BIGINT AS streak FROM i) SELECT repo, id, streak, streak >= 3 AS tripped FROM s""",
    "phase_batches": f"WITH {_JOBS}, b AS (SELECT repo, id, (row_number() OVER (PARTITION BY repo ORDER BY id) - 1) // 40 AS batch FROM jobs) SELECT repo, batch, count(*) AS n, min(id) AS first FROM b GROUP BY ALL",
    "top_pages": f"""WITH t AS (SELECT '/' || {_HOST} || {_PATH} || '/' AS path, event_type || CASE WHEN event_id % 2 = 0 THEN 'bot' ELSE '' END AS ua, event_id % 7 + 1 AS weight FROM events JOIN pages ON page_id = user_id),
g AS (SELECT path, {_AGENT} AS agent, sum(weight) AS w, count(*) AS n FROM t WHERE path LIKE '/%/%/%/' GROUP BY ALL)
SELECT path, sum(w)::BIGINT AS requests, first(agent ORDER BY n DESC, agent) AS top_agent FROM g GROUP BY path ORDER BY requests DESC, path LIMIT 20""",
    "traffic_points": f"SELECT page_id, substr({_PATH}, 1, 256) AS path, 'ai-bot' AS agent, 'miss' AS cache, substr({_HOST}, 1, 256) AS host, 200.0::DOUBLE AS status, substr({_PATH}, 1, 96) AS sampling_key FROM pages",
    "claim_order": f"WITH {_QUEUE}, {_REPOS} SELECT row_number() OVER (ORDER BY analyzed_sha IS NULL, priority DESC, updated_at, q.repo)::INT AS rank, q.repo, priority, updated_at FROM q LEFT JOIN r ON r.repo = q.repo WHERE status = 'queued' AND solo < 2",
    "seed_queue": f"""WITH {_QUEUE}, c AS (SELECT DISTINCT (o_custkey * 2)::VARCHAR AS repo FROM orders),
x AS (SELECT coalesce(q.repo, c.repo) AS repo, c.repo IS NOT NULL AS wanted, q.* EXCLUDE (repo) FROM q FULL JOIN c ON c.repo = q.repo),
y AS (SELECT *, CASE WHEN status IS NULL THEN 'added' WHEN wanted AND status NOT IN ('queued', 'running') AND NOT (status = 'failed' AND {NOW} - updated_at < 86400000) THEN 'requeued' END AS change FROM x)
SELECT repo, coalesce(priority, 0)::INT AS priority, CASE WHEN change IS NOT NULL THEN 'queued' ELSE status END AS status, coalesce(attempts, 0)::INT AS attempts, CASE WHEN change IS NOT NULL THEN 0 ELSE solo END AS solo,
  CASE WHEN change IS NULL THEN last_error END AS last_error, CASE WHEN change IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at, change FROM y""",
    "settle_queue": f"""WITH {_QUEUE}, o AS (SELECT repo, CASE WHEN n % 2 = 0 THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN n % 4 = 0 THEN '[spawn] unable to create thread' WHEN n % 2 = 0 THEN 'bad answer' END AS error, solo AS ran_at, n % 3 = 0 AS held FROM q WHERE status = 'running'),
x AS (SELECT q.*, outcome, error, ran_at, held, coalesce(outcome = 'failed' AND regexp_matches(error, {_quote('(?i)' + HOST_FAULT)}) AND ran_at < 2, false) AS infra FROM q LEFT JOIN o USING (repo))
SELECT repo, priority, CASE WHEN infra THEN 'queued' ELSE coalesce(outcome, status) END AS status, attempts, CASE WHEN infra THEN CASE WHEN ran_at >= 1 OR held THEN 2 ELSE 1 END ELSE solo END AS solo,
  CASE WHEN outcome IS NOT NULL THEN error ELSE last_error END AS last_error, CASE WHEN outcome IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at FROM x""",
    "rescan_decisions": f"""WITH {_REPOS} SELECT repo, CASE WHEN analyzed_sha IS NOT NULL AND n % 3 = 0 AND epoch_ms('1998-01-10'::TIMESTAMP) - epoch_ms(analyzed_at) < 14 * 86400000 THEN 'dampened' WHEN analyzed_sha IS NOT NULL AND n % 2 = 0 THEN 'unchanged' ELSE 'due' END AS decision FROM r""",
    "rescan_plan": f"""WITH {_DIFFS}, l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 10 AS line FROM lineitem),
x AS (SELECT l.k, line, status, EXISTS (SELECT 1 FROM h WHERE h.k = l.k AND line BETWEEN s - 3 AND CASE WHEN ol = 0 THEN s + 1 ELSE s + ol - 1 END + 3) AS touched,
  (SELECT coalesce(sum(nl - ol), 0) FROM h WHERE h.k = l.k AND CASE WHEN ol = 0 THEN s < line ELSE s + ol - 1 < line END) AS shift FROM l LEFT JOIN f ON f.k = l.k)
SELECT k::VARCHAR AS "filePath", line::INT AS "lineNumber", CASE WHEN status IS NULL THEN 'carryOver' WHEN status = 'D' OR touched THEN 'dropped' ELSE 'remapped' END AS disposition,
  CASE WHEN status IS NULL THEN line WHEN status = 'D' OR touched THEN NULL ELSE line + shift END::BIGINT AS "newLine" FROM x""",
    "lines_in_review": f"""WITH {_DIFFS}, l AS (SELECT DISTINCT l_orderkey AS k, (l_linenumber * 10 + 4)::INT AS line FROM lineitem)
SELECT l.k::VARCHAR AS file, line FROM l JOIN f ON f.k = l.k AND status = 'M' WHERE EXISTS (SELECT 1 FROM h WHERE h.k = l.k AND line BETWEEN s - 3 AND CASE WHEN nl = 0 THEN s + 1 ELSE s + nl - 1 END + 3)""",
    "innermost_interval": """WITH y AS (SELECT l_orderkey AS k, l_linenumber AS first, (l_linenumber + l_quantity % 5)::INT AS last, 'f' || l_partkey AS name FROM lineitem), t AS (SELECT DISTINCT l_orderkey, l_linenumber + 1 AS line FROM lineitem)
SELECT t.l_orderkey, line, first, last, name FROM t LEFT JOIN y ON y.k = t.l_orderkey AND line BETWEEN first AND last QUALIFY row_number() OVER (PARTITION BY t.l_orderkey, line ORDER BY last - first, first, last, name) = 1""",
    "merged_regions": """WITH w AS (SELECT l_orderkey, l_linenumber * 4 AS s, (l_quantity % 8 + 1)::INT AS size FROM lineitem),
m AS (SELECT *, max(s + size) OVER (PARTITION BY l_orderkey ORDER BY s, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, size ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, island::BIGINT AS island, min(s)::INT AS first, max(s + size)::INT AS "end" FROM i GROUP BY l_orderkey, island""",
    "assembled_ids_slugs": f"""WITH e AS (SELECT lang AS repo, doc_id AS ordinal, coalesce({_code('text')}, text) AS key, {_slug(f"coalesce({_code('text')}, text)")} AS slug, 'f' || doc_id % 10 AS path FROM documents), i AS (SELECT *, {_id('repo', 'key', 'path')} AS id FROM e),
u AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1)
SELECT ordinal, repo, id, CASE WHEN row_number() OVER (PARTITION BY repo, slug ORDER BY ordinal) > 1 THEN slug || '-' || substr(id, 1, 6) ELSE slug END AS slug FROM u""",
    "validation_rejects": f"""WITH {_MADE}, i AS (SELECT 'httpStatus: must be from 100 to 599' AS issue FROM checked WHERE bad_http UNION ALL SELECT 'severity: must be one of critical, error, warning, info' FROM checked WHERE bad
UNION ALL SELECT 'tags: has a bad item' FROM checked WHERE bad UNION ALL SELECT 'errorMessage: must be filled' FROM checked WHERE empty_text UNION ALL SELECT 'messagePattern: must be filled' FROM checked WHERE empty_text
UNION ALL SELECT 'lineNumber: must not be before sourceCodeStart' FROM checked WHERE bad_line UNION ALL SELECT 'sourceCodeEnd: must not be before sourceCodeStart' FROM checked WHERE bad_end) SELECT issue, count(*) AS n FROM i GROUP BY issue""",
    "assembled_records": f"""WITH {_MADE}, s AS (SELECT *, {_slug('text')} AS base FROM checked), u AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY repo, base ORDER BY doc_id) > 1 THEN base || '-' || substr(id, 1, 6) ELSE base END AS slug FROM s)
SELECT id, repo, slug, CASE doc_id % 3 WHEN 0 THEN 'panic' WHEN 1 THEN 'error_code' ELSE 'exception' END AS "errorType", CASE WHEN bad THEN 'fatal' ELSE 'error' END AS severity, line AS "lineNumber", s::INT AS "sourceCodeStart", e::INT AS "sourceCodeEnd",
'https://github.com/' || repo || '/blob/' || sha1(regexp_extract(repo, '/(.*)$', 1)) || '/f' || doc_id || CASE WHEN s IS NOT NULL AND e <> s THEN '#L' || s || '-L' || e WHEN s IS NOT NULL THEN '#L' || s ELSE '' END AS "githubUrl",
md5(CASE WHEN text = '' THEN '' WHEN {_good(_derived('text'))} THEN {_derived('text')} ELSE {_escape('text')} END) AS pattern, NOT (bad OR bad_http OR empty_text OR bad_line OR bad_end) AS valid FROM u""",
    "verify_gaps": f"""WITH {_MADE} SELECT id, true AS "hasDoc", false AS "hasSolutions", coalesce(trim(array_to_string(string_split(text, chr(10))[s:e], chr(10))) <> '', false) AS "hasSource", defended AS "hasDefense" FROM checked""",
    "applied_patches": """WITH p AS (SELECT doc_id AS o, 'd' || doc_id * 3 % 700 AS id, CASE WHEN doc_id % 4 = 0 THEN 'exampleFix' WHEN doc_id % 4 = 1 THEN 'id' ELSE 'documentation' END AS f, source AS v FROM documents)
SELECT d.id, md5(coalesce((SELECT arg_max(v, o) FROM p WHERE p.id = d.id AND f = 'documentation'), text)) AS documentation, coalesce((SELECT arg_max(v, o) FROM p WHERE p.id = d.id AND f = 'exampleFix'), 'old') AS "exampleFix" FROM (SELECT 'd' || doc_id AS id, text FROM documents) d""",
    "quality_report": f"""SELECT lang AS label, count(*) AS records, count({_code('text')}) AS "withCode", floor(avg(length(text)) + 0.5)::BIGINT AS "avgDocChars", count(*) FILTER (length(text) < 100) AS "shortDocs", floor(avg(len(string_split(source, '1'))) * 10 + 0.5) / 10 AS "avgSolutions", 0::BIGINT AS "noSolutions",
count(*) FILTER (quality = 1) AS "withExampleFix", count(*) FILTER (toxic = 0) AS "withSource", count(*) FILTER (toxic = 1) AS "withDefense", floor(avg(len(string_split(source, '2'))) * 10 + 0.5) / 10 AS "avgPreventionTips", 0.0::DOUBLE AS "avgTags" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "scope_tree_counts": f"""WITH {_FILES}, x AS (SELECT unnest(range(1, least(3, len(p) - 1) + 1)) AS depth, p FROM t WHERE len(p) > 1 AND {_SEEN}), c AS (SELECT array_to_string(p[1:depth], '/') AS path, depth::INT AS depth, count(*) AS n FROM x GROUP BY ALL)
SELECT path, depth, least(n, 50) AS "sourceFiles", n > 50 AS capped FROM c""",
    "scope_tally": f"WITH {_FILES} SELECT p[1] AS top, count(*) AS n FROM t WHERE (starts_with(path, 'thther.example.org/en/') OR starts_with(path, 'ththre.example.com/') OR path IN ('thther.example.org/en', 'ththre.example.com')) AND {_SEEN} GROUP BY 1",
    "source_region": f"WITH r AS (SELECT doc_id, text, {_REGION.format(l='(doc_id % 30 + 1)')} FROM documents) SELECT doc_id, s::INT AS start, e::INT AS \"end\", md5(array_to_string(string_split(text, chr(10))[s:e], chr(10))) AS code FROM r",
    "parsed_targets": """WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_extract(url || CASE WHEN page_id % 2 = 0 THEN '/x' ELSE '' END, '^https?://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/') AS p FROM pages)
SELECT page_id, CASE WHEN len(p) = 3 AND NOT list_contains(p, '') THEN p[1] || '/' || p[2] END AS repo, CASE WHEN len(p) = 3 AND NOT list_contains(p, '') THEN p[3] END AS slug FROM u""",
    "paged_repos": """WITH c AS (SELECT lang || '/' || source AS repo, count(*) AS "errorCount" FROM documents GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY "errorCount" DESC, repo)::INT AS n, greatest(1, ceil(count(*) OVER () / 25))::INT AS pages FROM c),
p AS (SELECT *, ceil(n / 25)::INT AS page FROM n) SELECT *, CASE WHEN page = 2 THEN '/' WHEN page > 2 THEN '/repos/' || (page - 1) || '/' END AS prev, CASE WHEN page < pages THEN '/repos/' || (page + 1) || '/' END AS next FROM p""",
    "page_links": "WITH n AS (SELECT greatest(1, ceil(count(DISTINCT lang || '/' || source) / 25))::BIGINT AS n FROM documents) SELECT page, CASE WHEN page <= 1 THEN '/' ELSE '/repos/' || page || '/' END AS href FROM (SELECT unnest(range(1, n + 1)) AS page FROM n)",
    "background_articles": f"""WITH {_RECORDS} SELECT id, CASE WHEN tag IN ('en', 'der', 'fr') THEN tag WHEN {_kebab('code')} IN ('en', 'der', 'fr') THEN {_kebab('code')} END AS article FROM records""",
    "page_entries": f"""WITH {_ENTRIES} SELECT item_id::VARCHAR AS page, i::INT AS pos, (item_id * 40 + i)::VARCHAR AS id, repo FROM (SELECT item_id, unnest(range(20)) AS i FROM benchmark) b JOIN entries e ON e.doc_id = item_id * 40 + i""",
    "peak_hours": "SELECT event_id, isodow(ts) <= 5 AND hour(ts) >= 6 AND hour(ts) < 10 AS peak, CASE WHEN isodow(ts) <= 5 AND hour(ts) >= 6 AND hour(ts) < 10 THEN epoch_ms(date_trunc('day', ts) + INTERVAL 10 HOUR) - epoch_us(ts) // 1000 ELSE 0 END AS ms FROM events",
    "identity_reuse": "SELECT doc_id % 3 = 0 AS reuse, count(*) AS n FROM documents GROUP BY 1",
    "upserted_repos": f"""WITH {_REPOS}, c AS (SELECT c_custkey::VARCHAR AS repo, CASE WHEN c_nationkey > 10 THEN c_nationkey END::BIGINT AS error_count FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(r.repo, c.repo) AS repo, analyzed_sha, coalesce(c.error_count, r.error_count) AS error_count FROM r FULL JOIN c ON c.repo = r.repo""",
    "change_marker": f"WITH {_REPOS} SELECT max(analyzed_at) AS analyzed_at, count(*) AS repos, (SELECT max(event_id) FROM events) AS pages_at FROM r WHERE analyzed_sha IS NOT NULL",
    "pending_work": f"WITH {_QUEUE} SELECT count(*) AS pending FROM q WHERE status IN ('queued', 'running')",
    "phases_done": f"WITH {_JOBS} SELECT repo, phase, status = 'success' AS done FROM jobs QUALIFY row_number() OVER (PARTITION BY repo, phase ORDER BY started_at DESC, id DESC) = 1",
    "guide_counts": f"WITH {_GUIDES} SELECT 'guide' AS kind, guide AS slug, count(*) AS n FROM m GROUP BY guide UNION ALL SELECT 'info', 'p' || item_id, length(text) FROM benchmark",
    "content_keys": "SELECT event_id, sha1(event_type || chr(1) || CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE '' END || chr(1) || coalesce(props, '')) AS key FROM events",
    "sitemap_lines": f"""WITH {_ENTRIES}, l AS (SELECT '  <url><loc>https://example.org/' || repo || '&amp;x/' || {_slug('coalesce(code, msg)')} || '/</loc><lastmod>2026-07-14</lastmod></url>' AS line FROM entries) SELECT line, count(*) AS n FROM l GROUP BY line""",
    "tree_lines": f"""WITH {_FILES}, x AS (SELECT unnest(range(1, least(3, len(p) - 1) + 1)) AS depth, p FROM t WHERE len(p) > 1 AND {_SEEN}), c AS (SELECT array_to_string(p[1:depth], '/') AS path, depth, count(*) AS n FROM x GROUP BY ALL)
SELECT path, repeat('  ', depth - 1) || path || '/ (' || least(n, 2) || CASE WHEN n > 2 THEN '+' ELSE '' END || ' source files)' || CASE WHEN n >= 2 THEN ' [SUSPECT: unusually large, vendored or generated code?]' ELSE '' END AS line FROM c""",
    "host_faults": "SELECT event_id, event_id % 6 IN (0, 3) AS host, event_id % 6 IN (2, 4) AS patience FROM events",
    "repo_metadata": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 7 <> 0 THEN source END AS description, CASE WHEN doc_id % 7 <> 0 THEN lang END AS language, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS stars, CASE WHEN doc_id % 7 <> 0 THEN 'main' END AS "defaultBranch" FROM documents""",
    "run_comparison": f"""WITH q AS (SELECT lang, count(*) AS records, count({_code('text')}) AS a, count(*) FILTER (length(text) < 100) AS b, count(*) FILTER (toxic = 0) AS c, count(*) FILTER (toxic = 1) AS d FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
m AS (SELECT lang, unnest(['records', 'withCode', 'shortDocs', 'withSource', 'withDefense']) AS metric, unnest([records::VARCHAR] || list_transform([a, b, c, d], lambda x: floor(x * 100 / records + 0.5)::BIGINT || '%')) AS v FROM q)
SELECT metric, max(v) FILTER (lang = 'de') AS de, max(v) FILTER (lang = 'en') AS en FROM m GROUP BY metric""",
    "checkpointed_batches": """WITH e AS (SELECT user_id::VARCHAR AS repo, CASE WHEN event_id % 4 = 0 THEN 'old' ELSE 'new' END AS sha, event_id FROM events), f AS (SELECT * FROM e WHERE sha = 'new' AND event_id % 3 = 0 AND repo <> '1')
SELECT repo, sha, CASE WHEN event_id IN (SELECT event_id FROM f) THEN 'b' ELSE 'a' END AS result, count(*) AS n FROM e WHERE sha = 'new' OR repo NOT IN (SELECT repo FROM f) GROUP BY ALL""",
    "record_markdown": f"""WITH {_MADE} SELECT id, md5('# ' || substr(text, 1, 80) || chr(10) || chr(10) || '**Repo:** ' || repo || chr(10) || '**Message:** `' || text || '`' || chr(10) || '**Severity:** ' || CASE WHEN bad THEN 'fatal' ELSE 'error' END || chr(10) || chr(10)
|| '## What it means' || chr(10) || 'Error "' || text || '" is raised in ' || repo || '.' || chr(10) || chr(10) || CASE WHEN line = 1 THEN '## Example fix' || chr(10) || '```' || chr(10) || 'fix()' || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
|| CASE WHEN defended THEN '## Defensive pattern' || chr(10) || 'Strategy: retry' || chr(10) || 'Prevention: check' || chr(10) || chr(10) ELSE '' END
|| 'Source: https://github.com/' || repo || '/blob/' || sha1(regexp_extract(repo, '/(.*)$', 1)) || '/f' || doc_id || CASE WHEN s IS NOT NULL AND e <> s THEN '#L' || s || '-L' || e WHEN s IS NOT NULL THEN '#L' || s ELSE '' END || chr(10)
|| 'Analyzed: ' || repo || '@' || substr(sha1(regexp_extract(repo, '/(.*)$', 1)), 1, 10) || ' on 2024-01-02') AS markdown FROM checked""",
    "declared_names": """WITH l AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'export const ' || source || CASE WHEN doc_id % 3 = 0 THEN ' := x' ELSE ' == x' END ELSE source || 'Err = y' END AS line FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN source || 'Err' WHEN doc_id % 3 = 0 THEN source END AS name, CASE WHEN doc_id % 2 = 1 OR doc_id % 3 = 0 THEN false END AS exported FROM l""",
}
