"""Faults that a reviewer found in round 3."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mishap import oracle
from mishap.functions import text
from mishap.operators import extract, index, queue, search
from mishap.plans import parts, views  # noqa: F401  parts adds its queries
from mishap.plans.queries import QUERIES
from mishap.sinks import commits, publish
from mishap.sources import shards

SF = "/root/testdata/sf0.001"


def _documents(spark, root, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return str(root)


def test_texts_are_numbered_before_columns_are_made_of_them(spark, tmp_path, monkeypatch):
    """Codes, ids, slugs and patterns were made for a sample and again for the sort, whatever a query reads."""
    d, seen, own = _documents(spark, tmp_path, [(0, "One two. ENOENT here", "en", "a", 20), (1, "One two", "en", "b", 7)]), [], views.dense_index
    monkeypatch.setattr(views, "dense_index", lambda rows, *a: seen.append(set(rows.columns)) or own(rows, *a))
    m = {r.idx: (r.repo, r.msg, r.code) for r in views.messages(spark, d).collect()}
    assert m == {0: ("en/a", "One two", None), 1: ("en/a", "ENOENT here", "ENOENT")}
    assert {r.idx: r.code for r in views.entries(spark, d).collect()} == {0: "ENOENT", 1: None}
    assert seen == [{"ord", "repo", "msg"}, {"doc_id", "repo", "msg", "cls", "tag", "n_chars"}]


def test_pattern_is_made_once(spark):
    """F16: each use of a pattern made it anew, twelve regular expressions at a time."""
    p = text.message_pattern(F.col("m"))
    rows = spark.createDataFrame([("no ${x} in file [a]",), ("",), (None,), ("%s",)], "m string").select(p["pattern"].alias("pattern"), p["source"].alias("source"))
    assert [tuple(r) for r in rows.collect()] == [(r"no (.+?) in file \[a\]", "derived"), ("", "literal"), ("", "literal"), ("%s", "literal")]
    plan = rows.select("pattern")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"%\([^)]*\)[sdifge]") == 1


class Echo:
    def ask(self, prompt):
        return f'{{"said": "{prompt}"}}'


def test_answers_are_kept_in_few_files(spark, tmp_path):
    """each answer was a file of its own, all of which the driver listed."""
    folder = str(tmp_path / "kept")
    prompts = spark.range(500).select(F.col("id").alias("key"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    assert oracle.ask_resumably(prompts, [Echo()], folder, 2).where("json is not null and error is null").count() == 500
    files = [f for _, _, names in os.walk(f"{folder}/answers") for f in names]
    assert 1 <= len(files) <= 20
    at = next(os.path.join(d, f) for d, _, names in os.walk(f"{folder}/answers") for f in names)
    with open(at, "a") as f:  # a line that a crash cut short
        f.write('{"content": "abc", "js')
    assert oracle.ask_resumably(prompts, [], folder, 2).where("json is not null").count() == 500  # none is asked again


def test_payloads_of_a_grep_stay_small(spark, tmp_path, monkeypatch):
    """all lines were in 21 payloads, however many there are."""
    rows = spark.range(40_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, own = [], extract.grep_sites
    monkeypatch.setattr(extract, "grep_sites", lambda payloads, **k: seen.append(payloads) or own(payloads, **k))
    assert QUERIES["sites_of_grep"](spark, str(tmp_path)).count() == 24_000
    assert seen[0].agg(F.max(F.length("json"))).first()[0] < 100_000


class Seen(Exception):
    pass


def _seen(rows, *a, **k):
    raise Seen(rows.inputFiles())


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_what_is_published_is_made_once(spark, monkeypatch):
    """records were made and checked anew for the counts, the numbers and the files. F4: first entries of ids, for each kind of file."""
    with monkeypatch.context() as m:
        m.setattr(publish, "write_index", _seen)
        with pytest.raises(Seen) as e:
            QUERIES["lookups_by_id"](spark, SF)
        assert e.value.args[0] and all("/entries/" in f for f in e.value.args[0])
    monkeypatch.setattr(publish.ix, "dense_index", _seen)
    with pytest.raises(Seen) as e:
        QUERIES["published_counts"](spark, SF)
    assert e.value.args[0] and all("/_records/" in f for f in e.value.args[0])


def test_patterns_that_no_query_can_have_are_left_out():
    """each gram of each pattern was hashed by itself, and patterns went on that no query's grams allow."""
    counts = next(search._count_grams(iter([pa.record_batch({"text": ["lost connection to h\u00f6st", None, "\U0001f600 ab"]})])))
    table = np.zeros(search.BUCKETS, np.int64)
    table[counts.column("b").to_numpy()] = counts.column("n").to_numpy()
    patterns = [r"lost (.+?) to", "never said so", r"\(.+?\)", "(?:a|b)+", "\U0001f600 ab", "to", r"h\u00f6st\\(.+?)x", "", r"on\sto h"]
    for p in patterns:
        assert search._literals(p) == search.required_literals(p)
    batch = pa.record_batch({"idx": list(range(len(patterns))), "pattern": patterns})
    got = {r["idx"]: (r["piece"], r["gram"]) for b in search._anchored(table)(iter([batch])) for r in b.to_pylist()}
    assert 1 not in got and got[0][0] == "lost " and got[0][1] in ("los", "ost", "st ", " to") and got[3] == got[7] == ("", "")
    assert got[4] == ("\U0001f600 ab", got[4][1]) and got[4][1] in "\U0001f600 ab" and got[5] == ("to", "to")


def test_words_of_a_text_are_made_once(spark):
    """words were made twice, once to see whether there are any, by seven passes over the text each time."""
    rows = spark.createDataFrame([(0, "Cannot open '/a b' at /etc/x-1.y or 0xfe 12 \"no\" Ünd so so it's"), (1, "12 /x"), (2, None)], "idx long, msg string")
    tokens = index.postings(rows)
    assert sorted(tuple(r) for r in tokens.collect()) == [(0, t) for t in ("at", "cannot", "it", "nd", "open", "or", "s", "so")]
    assert tokens._jdf.queryExecution().optimizedPlan().toString().count("0x[0-9a-f]") == 1


def test_list_gives_its_weight(spark):
    """words were made, and dealt out, a second time for the weights, which follow from the lists' lengths."""
    rows = spark.createDataFrame([(0, "one two"), (1, "two"), (2, "three, two")], "idx long, msg string")
    tokens, n = index.postings(rows), index.entry_count(rows)
    lists = index.posting_lists(tokens, n)
    weights = {r.token: r.weight for r in index.weights(tokens, n).collect()}
    assert {r.token: (r.weight, r.entries) for r in lists.collect()} == {"one": (weights["one"], [0]), "two": (weights["two"], [0, 1, 2]), "three": (weights["three"], [2])}
    assert lists._jdf.queryExecution().optimizedPlan().toString().count("0x[0-9a-f]") == 1


def test_search_keeps_only_what_it_reads(spark):
    """ids, slugs and patterns of all entries were made and kept for searches that read words alone."""
    made = F.udf(lambda m: 1 / 0, "string")
    entries = spark.createDataFrame([(0, "connection lost", None), (1, "connection found", "LOST")], "idx long, msg string, code string").withColumn("pattern", made("msg"))
    asked = spark.createDataFrame([(7, "connection lost LOST")], "qid long, text string")
    assert [r.idx for r in search.jaccard(asked, entries).collect()] == [0]
    assert [(r.idx, r.match) for r in search.ranked(asked, entries).orderBy("rank").collect()] == [(1, "exact-code"), (0, "fuzzy")]


def test_lists_are_summed_in_arrays_and_once(spark, tmp_path):
    """each number of each list of each query was a row to shuffle, and all of that was done twice."""
    words = "open close read write file socket disk host".split()
    message = F.concat_ws(" ", *(F.when(F.col("idx") % (i + 2) < 2, w) for i, w in enumerate(words)), F.concat(F.lit("x"), F.translate((F.col("idx") % 97).cast("string"), "0123456789", "abcdefghij")))
    entries = spark.range(6000).select(F.col("id").alias("idx"), F.sha1(F.col("id").cast("string")).alias("id"), F.lit("r").alias("repo"), F.when(F.col("id") % 1000 == 5, "EBAD").alias("code")).withColumn("msg", message)
    entries = entries.select("idx", "id", "repo", F.lit("s").alias("slug"), "code", "msg", *(F.lit("").alias(c) for c in ("pattern", "type", "cls", "sev")), F.array().cast("array<string>").alias("tags"))
    publish.write_index(entries, str(tmp_path))
    asked = spark.createDataFrame([("a", "open the file xc"), ("b", "write disk host"), ("c", "EBAD socket"), ("d", "nothing"), ("e", "")], "qid string, text string")
    found = shards.Shards(spark, str(tmp_path)).search(asked)
    want = search.ranked(asked, entries)
    key = lambda rows: sorted((r.qid, r.rank, r.idx, r.score, r.match) for r in rows.collect())
    assert key(found) == key(want) and {r.qid for r in want.collect()} == {"a", "b", "c"}
    assert "numbers" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_contents_are_made_once(spark, tmp_path):
    """contents were made for the test of their size and again for their lines, line by line."""
    d = _documents(spark, tmp_path, [(0, "Not so, 1!\n\n  badé\r\n", "en", "a", 20), (1, None, "en", "a", 0), (2, "", "en", "a", 0)])
    rows = views.sources(spark, d).orderBy("path")
    assert [r.content for r in rows.collect()] == ['    raise ValueError("Not so ")\n    raise ValueError("")\n    raise ValueError("  bad")\n    raise ValueError("")', None, '    return fmt.Errorf("", x)']
    assert extract.extract_sites(rows)._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z") == 1


def test_rounds_of_a_drain_do_not_pass_the_driver(spark, tmp_path):
    """claims, outcomes and the keys of commits were broadcast, through the driver, in each round."""
    q = spark.range(6).select(F.col("id").cast("string").alias("repo"), F.lit(1).alias("priority"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("solo"), F.lit(None).cast("string").alias("last_error"), F.lit(0).cast("long").alias("updated_at"))
    table = commits.Keyed(spark, str(tmp_path), ["repo"], q.schema)
    table.commit(q)
    table.commit(q.where("repo = '1'").withColumn("attempts", F.lit(3)))
    outcomes = spark.createDataFrame([("1", "failed", "bad", 0, False)], "repo string, outcome string, error string, ran_at int, held_large boolean")
    repos = spark.createDataFrame([("2", "sha")], "repo string, analyzed_sha string")
    for rows in (table.read(), queue.settle(table.read(), outcomes, 5), queue.claim_order(table.read(), repos)):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 6
    assert [(r.repo, r.attempts) for r in table.read().where("attempts > 0").collect()] == [("1", 3)]
