"""From working tables to a published set and back, feeds, oracles and the stream."""

import gzip
import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mishap import oracle
from mishap.api import KnowledgeBase
from mishap.schema import INFO_PAGE, QUEUE, REPO
from mishap.sinks import feeds, publish, state
from mishap.sinks.commits import Keyed
from mishap.operators.search import ranked
from mishap.sources import files
from mishap.sources.shards import Shards
from mishap.streaming.queue_stream import event_windows, seed_from_stream
from tests.test_operators import errors

PAGE = ("net", "code:ENET", "t", "s", "b", [("a", "b")], ["f"], [], ["1"], 5, 2, "2026-07-14T00:00:00Z", 1)


@pytest.fixture
def published(spark, tmp_path):
    repos = spark.createDataFrame([("o/n", None, None, 1, None, "main", "a" * 40, "2026-07-14T00:00:00Z", 2), ("o/bad", None, None, -1, None, "main", "a" * 40, "2026-07-14T00:00:00Z", 1), ("o/raw", None, None, 1, None, "main", "a" * 40, "2026-07-14T00:00:00Z", 1)], REPO)
    repos = repos.withColumn("status", F.when(F.col("repo") == "o/raw", "pending").otherwise("analyzed"))
    records = errors(spark, {"id": "a" * 16, "slug": "conn", "errorCode": "ECONN", "errorMessage": "connection refused by peer", "messagePattern": "connection refused by peer"}, {"id": "b" * 16, "slug": "cert", "errorCode": None, "errorMessage": "unable to verify certificate"}, {"id": "c" * 16, "severity": "odd"}, {"id": "d" * 16, "repo": "o/raw"})
    out = str(tmp_path / "data")
    return out, lambda v: publish.publish(spark, repos, records, spark.createDataFrame([PAGE], INFO_PAGE), out, v)


def test_publish_and_read(spark, published):
    out, go = published
    m = go("v1")
    assert m["counts"] == {"repos": 1, "errors": 2, "infoPages": 1} and m["rejected"] == 2
    kb = KnowledgeBase(spark, out)
    assert kb.version == "v1" and not kb.refresh()
    assert [r.id for r in kb.search("saw ECONN").collect()] == ["a" * 16]
    assert kb.search_index("unable verify certificate").first().match == "fuzzy"
    got = kb.get(repo="o/n", slug="cert").first()
    assert got.id == "b" * 16 and got.markdown.startswith("# unable to verify") and "## Solutions\n1. do" in got.markdown
    assert kb.get(id="f" * 16).count() == 0
    assert [(r.repo, r.errorCount) for r in kb.repos().collect()] == [("o/n", 2)]
    at = publish.home(spark, out)
    shard = json.loads(open(f"{at}/search/summary.json").read())
    assert shard["entryCount"] == 2 and len(json.loads(open(f"{at}/search/norms/0.json").read())) == 2
    assert [r.slug for r in kb.pages().collect()] == ["net"] and kb.page("net").first().clusterKey == "code:ENET" and kb.page("none").count() == 0
    whole = gzip.decompress(open(f"{at}/index.json.gz", "rb").read())
    assert [e["id"] for e in json.loads(whole)["errors"]] == ["a" * 16, "b" * 16] and m["files"]["index"]["rawSha256"] == hashlib.sha256(whole).hexdigest()
    go("v2")
    assert kb.refresh() and kb.version == "v2"


def test_requests_as_rows(spark, published):
    """Every kind of request at once, faults, nulls and parameters in any order among them."""
    out, go = published
    go("v1")
    kb = KnowledgeBase(spark, out)
    urls = {
        1: "https://s.example/api/search?limit=1&q=saw+ECONN%20again", 2: "/api/search/?message=unable%20verify%20certificate&repo=o/n", 3: "/api/search?q=unable+verify+certificate&repo=o%2Fother",
        4: "/api/search?q=&message=x", 5: "/api/search?xq=a", 6: f"/api/errors/{'a' * 16}", 7: f"/api/errors/{'f' * 16}/", 8: f"/api/errors/{'A' * 16}", 9: "/api/repos#top", 10: "/api", 11: "", 12: None, 15: "/api/search?q=%zz&limit=x",
    }
    asked = [(n, "GET", u) for n, u in urls.items()] + [(13, "OPTIONS", "/x"), (14, None, "/api/repos")]
    got = {r.rid: (r.status, r.body and json.loads(r.body)) for r in kb.respond(spark.createDataFrame(asked, "rid long, method string, url string")).collect()}
    assert {n: s for n, (s, _) in got.items()} == {1: 200, 2: 200, 3: 200, 4: 400, 5: 400, 6: 200, 7: 404, 8: 404, 9: 200, 10: 404, 11: 404, 12: 404, 13: 204, 14: 405, 15: 200}
    assert [(m["id"], m["matchType"], m["score"]) for m in got[1][1]["matches"]] == [("a" * 16, "exact-code", 1.0)] and got[1][1]["datasetVersion"] == "v1"
    assert [(m["repo"], m["url"], "code" in m) for m in got[2][1]["matches"]] == [("o/n", "https://example.org/o/n/cert/", False)]
    assert got[3][1]["matches"] == got[15][1]["matches"] == [] and got[13][1] is None
    assert got[6][1]["record"]["errorMessage"] == "connection refused by peer" and got[7][1] == {"error": "not found"} and got[4][1] == {"error": "missing q parameter"}
    assert [r["repo"] for r in got[9][1]["repos"]] == ["o/n"] and got[10][1]["error"] == "unknown endpoint" and got[14][1] == {"error": "method not allowed"}
    named = spark.createDataFrame([("o/n", "cert"), ("o/n", "cert"), ("o/n", "none"), (None, None)], "repo string, slug string")
    assert [r.id for r in kb.get_named(named).collect()] == ["b" * 16]
    assert kb.respond(spark.createDataFrame([], "rid long, method string, url string")).count() == 0


def test_tampered_index(spark, published):
    out, go = published
    go("v1")
    with open(f"{publish.home(spark, out)}/index/0.gz", "ab") as f:
        f.write(b"x")
    with pytest.raises(publish.Tampered, match=r"\[0\]"):
        publish.read_index(spark, out)
    with pytest.raises(publish.Tampered, match=r"\[0\]"):
        publish.sync(spark, out, f"{out}.cache")
    assert not Path(f"{out}.cache/current.json").exists()


def test_only_changed_chunks_are_read(spark, tmp_path, monkeypatch):
    """Chunks of two entries: one record of five changes, so that one of three chunks is fetched."""
    for module in (publish, publish.ix):
        monkeypatch.setattr(module, "META_CHUNK", 2)
    repos = spark.createDataFrame([("o/n", None, None, 1, None, "main", "a" * 40, "2026-07-14T00:00:00Z", 5)], REPO).withColumn("status", F.lit("analyzed"))
    make = lambda said: errors(spark, *({"id": c * 16, "slug": c, "errorMessage": f"{said if c == '4' else 'thing'} number {c}"} for c in "12345"))
    out, cache = str(tmp_path / "d"), str(tmp_path / "c")
    go = lambda said, v: publish.publish(spark, repos, make(said), spark.createDataFrame([PAGE], INFO_PAGE), out, v)
    first = go("thing", "v1")
    assert publish.sync(spark, out, cache) == {"version": "v1", "chunks": 3, "fetched": 3} and publish.sync(spark, out, cache)["fetched"] == 0
    second = go("other", "v2")
    assert first["files"]["index"]["tree"] != second["files"]["index"]["tree"]
    assert publish.sync(spark, out, cache) == {"version": "v2", "chunks": 3, "fetched": 1}
    want = [(i, c * 16, f"{'other' if c == '4' else 'thing'} number {c}") for i, c in enumerate("12345")]
    for got in (publish.read_cache(spark, cache), publish.read_index(spark, out)):
        assert sorted((r.idx, r.id, r.msg) for r in got.collect()) == want
    # the version before stays readable until the next but one
    assert len(list((tmp_path / "d/versions").iterdir())) == 2


def test_a_crash_in_publishing_leaves_the_version_before(spark, published, monkeypatch):
    out, go = published
    go("v1")
    monkeypatch.setattr(publish, "write_text", lambda *x: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        go("v2")
    assert publish.read_manifest(spark, out)["datasetVersion"] == "v1" and publish.read_index(spark, out).count() == 2


ENTRIES = [
    ("aa00000000000001", "o/a", "Request failed with status code", "ERR_BAD_RESPONSE"),
    ("bb00000000000002", "o/a", "timeout of {n} ms exceeded", "ECONNABORTED"),
    ("cc00000000000003", "o/b", "connect ECONNREFUSED at address", None),
    ("dd00000000000004", "o/a", "self signed certificate in certificate chain", None),
    ("ee00000000000005", "o/a", "unexpected token in JSON at position", None),
]


def test_shards(spark, tmp_path):
    """Searches and lookups read few files of an index, and find what a search over all entries finds."""
    rows = [(n, i, repo, i, code, msg, msg, "exception", None, [], "error") for n, (i, repo, msg, code) in enumerate(ENTRIES)]
    entries = spark.createDataFrame(rows, publish.ENTRY)
    publish.write_index(entries, str(tmp_path))
    asked = spark.createDataFrame(list(enumerate(["got ERR_BAD_RESPONSE from server", "self signed certificate in chain", "connect ECONNREFUSED at address", "timeout exceeded", "völlig unrelated Zeichenkette", ""])), "qid long, text string")
    shards = Shards(spark, str(tmp_path))
    got = shards.search(asked).collect()
    assert sorted((r.qid, r["rank"], r.idx, r.score, r.match) for r in got) == sorted(tuple(r) for r in ranked(asked, entries).collect())
    best = {r.qid: (r.id, r.match) for r in got if r["rank"] == 1}
    assert best == {0: ("aa00000000000001", "exact-code"), 1: ("dd00000000000004", "fuzzy"), 2: ("cc00000000000003", "fuzzy"), 3: ("bb00000000000002", "fuzzy")}
    assert all(r.repo == "o/a" for r in shards.search(asked, repo="o/a").collect())
    own = lambda rows: sorted((r.qid, r["rank"], r.idx) for r in rows.collect())
    each = asked.withColumn("repo", F.element_at(F.array(F.lit("o/a"), F.lit("o/b"), F.lit(None)), (F.col("qid") % 3 + 1).cast("int")))
    assert own(shards.search(each)) == sorted(own(shards.search(asked.where("qid % 3 = 0"), repo="o/a")) + own(shards.search(asked.where("qid % 3 = 1"), repo="o/b")) + own(shards.search(asked.where("qid % 3 = 2"))))
    few = Shards(spark, str(tmp_path))
    few.search(asked.where("qid = 3")).collect()
    assert len([p for p in few.reads if p.startswith("tokens/")]) <= 2 and not [p for p in few.reads if p.startswith("codes/")]
    found = few.lookup(spark.createDataFrame([("cc00000000000003",), ("0123456789abcdef",)], "id string")).collect()
    assert [(r.id, r.repo, r.idx) for r in found] == [("cc00000000000003", "o/b", 2)]
    assert Shards(spark, str(tmp_path / "none")).search(asked).count() == 0


def test_files_of_many_pieces(spark, tmp_path):
    """A token whose list has several blocks, and chunks of entries, come out whole."""
    rows = spark.range(5000).select(F.col("id").alias("idx"), F.substring(F.sha1(F.col("id").cast("string")), 1, 16).alias("id"), F.lit("o/n").alias("repo"), F.lit("s").alias("slug"), F.when(F.col("id") % 2 == 0, 'E"Q').alias("code"), F.when(F.col("id") % 3 == 0, "common rare").otherwise("common").alias("msg"), F.lit("p").alias("pattern"), F.lit("t").alias("type"), F.lit(None).cast("string").alias("cls"), F.array().cast("array<string>").alias("tags"), F.lit("error").alias("sev"))
    publish.write_index(rows, str(tmp_path))
    tokens = {k: v for f in (tmp_path / "search/tokens").iterdir() if f.suffix == ".json" for k, v in json.loads(f.read_text()).items()}
    assert tokens["common"][1] == list(range(5000)) and tokens["rare"][1] == list(range(0, 5000, 3)) and set(tokens) == {"common", "rare"}
    codes = {k: v for f in (tmp_path / "search/codes").iterdir() if f.suffix == ".json" for k, v in json.loads(f.read_text()).items()}
    assert codes == {'E"Q': list(range(0, 5000, 2))}
    assert [len(json.loads((tmp_path / f"search/meta/{k}.json").read_text())) for k in range(3)] == [2000, 2000, 1000]
    assert [len(json.loads((tmp_path / f"search/norms/{k}.json").read_text())) for k in range(3)] == [2000, 2000, 1000]
    # the directory names the bytes of each block
    for r in spark.read.parquet(str(tmp_path / "search/blocks")).collect():
        text = (tmp_path / r.path).read_bytes()[r.offset : r.offset + r.length]
        assert [int(x) for x in text.split(b",")] == [i for i in tokens[r.token][1] if i // 2000 == r.block]


def test_a_search_reads_few_blocks(spark, tmp_path, monkeypatch):
    """Block maxima: what can't reach the best hits so far isn't read, and the hits stay the same."""
    for module in (publish, publish.ix):
        monkeypatch.setattr(module, "META_CHUNK", 50)
    rng = random.Random(5)
    words = ["common", "often", *(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    said = ["common often " + " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 30]))) for _ in range(1500)]
    rows = [(n, f"{n:016x}", "o/a", "s", None, msg, msg, "exception", None, [], "error") for n, msg in enumerate(said)]
    entries = spark.createDataFrame(rows, publish.ENTRY)
    publish.write_index(entries, str(tmp_path))
    asked = spark.createDataFrame([(0, "common often wordac"), (1, "wordaa wordba"), (2, "often common"), (3, "nothing here")], "qid long, text string")
    shards = Shards(spark, str(tmp_path))
    got = sorted((r.qid, r["rank"], r.idx, r.score, r.match) for r in shards.search(asked).collect())
    assert got == sorted(tuple(r) for r in ranked(asked, entries).collect()) and len(got) >= 10
    assert 0 < shards.blocks["read"] < 0.75 * shards.blocks["known"]


def test_a_lost_manifest_marks_the_data_stale(spark, published, tmp_path):
    out, go = published
    go("v1")
    kb = KnowledgeBase(spark, out)
    (tmp_path / "data" / "current.json").unlink()
    assert not kb.refresh() and kb.stale and kb.version == "v1" and publish.is_stale(spark, out, "v1")


def test_missing_files_have_no_rows(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none.json"), REPO).count() == 0


def test_feeds(spark):
    r = errors(spark, {})
    assert feeds.repo_sitemap(r, "https://s").first().line == "  <url><loc>https://s/o/n/bad-thing/</loc><lastmod>2026-07-14</lastmod></url>"
    assert "<sitemapindex" in feeds.frame([x.line for x in feeds.sitemap_index(r, "https://s").collect()], "sitemapindex")
    posts = spark.createDataFrame([("a", "A & B", "d", "2026-07-14")], "slug string, title string, description string, date string")
    text = feeds.feed([x.item for x in feeds.feed_items(posts, "https://s").collect()], "https://s", "T", "D")
    assert "<title>A &amp; B</title>" in text and "Tue, 14 Jul 2026" in text
    assert "2 error records of 1" in feeds.overview({"errors": 2, "repos": 1}, "https://s", "T", ["timeouts"])
    bare = errors(spark, {"solutions": [], "errorCode": None}).select(feeds.markdown().alias("m")).first().m
    assert "## Solutions" not in bare and "## Defensive" not in bare and bare.endswith("on 2026-07-14")


def test_trees_and_settings(spark, tmp_path):
    root = tmp_path / "build (1)+x" / "docs"
    for p, t in {"src/a.py": "raise X", "node_modules/b.js": "x", ".hid/c.py": "x", "d.txt": "x", "big.py": "y" * 100}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    got = files.read_tree(spark, str(root), max_bytes=50)
    assert [tuple(r) for r in got.collect()] == [("src/a.py", "raise X")]
    (tmp_path / "corpus.txt").write_text("# list\no/a\n\n o/b # twice\no/a\n")
    corpus = files.read_corpus(spark, str(tmp_path / "corpus.txt"))
    assert {r.repo for r in corpus.collect()} == {"o/a", "o/b"}
    found = spark.createDataFrame([("o/a", False), ("o/c", False), ("o/d", True)], "repo string, fork boolean")
    assert [r.repo for r in files.new_candidates(found, corpus).collect()] == ["o/c"]
    (tmp_path / "c.json").write_text('{"min_errors": 7}')
    assert files.load_config(str(tmp_path / "c.json")).min_errors == 7 and files.load_config().min_errors == 5
    (tmp_path / "p.json").write_text('{"providers": {"a": {"args": ["-x"]}}, "phase_providers": {"verify": "a"}, "primary": "b", "max_concurrent": 0, "rescan_share": 7, "provider_max_concurrent": -1}')
    c = files.load_config(str(tmp_path / "p.json"))
    assert (c.providers["a"].command, c.providers["a"].args, c.providers["a"].timeout_ms) == ("a", ["-x"], 600_000)
    assert (c.provider_of("verify"), c.provider_of("scope"), c.max_concurrent, c.rescan_share, c.provider_max_concurrent) == ("a", "b", 1, 1.0, 0)
    with pytest.raises(ValueError):
        files.Config(phase_providers={"odd": "a"})
    points = spark.createDataFrame([("2024-01-02 03:04:05", "/p")], "at string, path string")
    assert state.append_traffic(points, str(tmp_path / "t")) and state.append_traffic(points, str(tmp_path / "t")) and spark.read.parquet(str(tmp_path / "t/traffic")).count() == 2
    (tmp_path / "file").write_text("x")
    assert not state.append_traffic(points, str(tmp_path / "file"))
    (tmp_path / "d.json").write_text('{"odd": 7}')
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "d.json"))
    with pytest.raises(FileNotFoundError):
        files.load_config(str(tmp_path / "none.json"))


def test_oracles(spark):
    good, slept = oracle.Fixed({"p": 'ok {"a": 1}'}), []

    class Limited:
        def ask(self, prompt):
            raise RuntimeError("rate limit")

    class Slow:
        n = 0

        def ask(self, prompt):
            self.n += 1
            raise TimeoutError("late")

    slow = Slow()
    assert oracle.ask_json("p", [Limited(), slow, good], sleep=slept.append) == ('{"a": 1}', None)
    assert slept == [30.0] and slow.n == 1
    assert oracle.ask_json("q", [good], sleep=slept.append)[1] == "empty"
    prompts = spark.createDataFrame([("k", "p"), ("l", "q")], "key string, prompt string")
    recorded = spark.createDataFrame([("p", "yes")], "prompt string, answer string")
    assert {r.key: r.answer for r in oracle.answer(prompts, recorded).collect()} == {"k": "yes", "l": ""}
    assert {r.key: r.json for r in oracle.answer_with(prompts, [oracle.Fixed({"p": "[1]"})]).collect()} == {"k": "[1]", "l": None}
    assert oracle.split_batch(list(range(40)), lambda b: len(b) <= 10) == [list(range(i, i + 10)) for i in (0, 10, 20, 30)]


def test_batches_are_halved_once_and_after_timeouts_only():
    asked = []

    def ask(part):
        asked.append(len(part))
        return (None, "timeout: late") if len(part) > 10 else (f"{part[0]}+{len(part)}", None)

    known = {}
    assert oracle.ask_or_halve(list(range(15)), ask, known=known) == ["0+8", "8+7"] and asked == [15, 8, 7]
    assert oracle.ask_or_halve(list(range(15)), ask, known=known) == ["0+8", "8+7"] and len(asked) == 3
    assert oracle.ask_or_halve(list(range(30)), ask) is None and asked[3:] == [30, 15, 15]
    assert oracle.ask_or_halve(list(range(12)), lambda part: (None, "parse")) is None
    assert oracle.ask_or_halve([1], lambda part: (None, "timeout: late")) is None


def test_stream_seeds_the_queue(spark, tmp_path):
    src, q = tmp_path / "in", str(tmp_path / "queue")
    src.mkdir()
    for n, text in enumerate(["o/a\no/b # x\n", "o/b\no/c\n"]):
        (src / f"{n}.txt").write_text(text)
        seed_from_stream(spark, str(src), q, str(tmp_path / "cp"), now=lambda: 7).awaitTermination(60)
    assert {(r.repo, r.status) for r in Keyed(spark, q, ["repo"], QUEUE).read().collect()} == {("o/a", "queued"), ("o/b", "queued"), ("o/c", "queued")}


def test_event_windows(spark):
    e = spark.createDataFrame([("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 01:10:00", "a")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in event_windows(e).collect()) == [1, 2]


def test_schemas():
    assert set(publish.json_schemas()) == {"error", "repo", "info-page", "index"}
