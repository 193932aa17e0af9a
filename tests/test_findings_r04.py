"""Faults that a reviewer found in round 4."""

import io
import json

from pyspark.sql import functions as F

from mishap import storage
from mishap.operators import index
from mishap.plans import parts, queries  # noqa: F401  parts adds its queries
from mishap.sinks import publish
from mishap.sources import shards


def test_index_is_made_by_blocks(spark, tmp_path):
    """Each posting was a row that was shuffled some seven times for weights, norms and lists."""
    rows = spark.createDataFrame([(i, f"open w{'abcdef'[i % 6]} file {'it' if i % 2 else ''}" if i != 4 else "12") for i in range(11)], "idx long, msg string")
    n = index.entry_count(rows)
    got = index.measured_blocks(index.words(rows), n, str(tmp_path / "tokens"), 4).collect()
    tokens = index.postings(rows)
    weighted = index.weights(tokens, n)
    want = index.posting_blocks(tokens, weighted, 4, least=True).collect()
    assert sorted((r.token, r.block, r.shard, r.weight, r.least, r.entries) for r in got if r.token) == sorted((r.token, r.block, r.shard, r.weight, r.least, r.entries) for r in want)
    norms = {r.idx: r.norm for r in index.norms(tokens, weighted).collect()}
    assert {r.block: r.entries for r in got if r.token is None} == {b: [norms.get(i, 0) for i in range(4 * b, min(11, 4 * b + 4))] for b in range(3)}
    first = {t: min(r.block for r in want if r.token == t) for t in {r.token for r in want}}
    assert all(r.first == first[r.token] for r in got if r.token)


def test_chunks_are_read_by_many_tasks_and_not_broadcast(spark, tmp_path):
    """one task read all chunks of entries, and all that it read was broadcast through the driver."""
    (tmp_path / "search/meta").mkdir(parents=True)
    for k in range(3):
        (tmp_path / f"search/meta/{k}.json").write_text(json.dumps([{"id": f"i{k}{j}", "repo": "r"} for j in range(2)]))
    (tmp_path / "search/summary.json").write_text(json.dumps({"entryCount": 6, "metaChunk": 2, "weightScale": 100}))
    paths = spark.createDataFrame([(f"search/meta/{k}.json",) for k in range(3)], "path string")
    assert storage.read_texts(paths, str(tmp_path)).rdd.getNumPartitions() == 4
    found = shards.Shards(spark, str(tmp_path)).entries(spark.createDataFrame([(0, "a"), (3, "b"), (3, "c"), (9, "d")], "idx long, q string"))
    assert sorted((r.q, r.idx, r.id) for r in found.collect()) == [("a", 0, "i00"), ("b", 3, "i11"), ("c", 3, "i11")]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_items_of_a_file_are_read_one_by_one(spark, tmp_path, monkeypatch):
    """a project's file was read, and parsed, as one text."""
    monkeypatch.setattr(storage, "PART", 5)
    rows = [{"a": 'x]},{"[\\"', "b": [1, {"c": None}]}, {}, {"a": "\u00fc\U0001f600" * 9}, {"n": -1.5e3}]
    for text in (json.dumps(rows), json.dumps(rows, ensure_ascii=False, indent=1)):
        assert [json.loads(x) for x in storage.items(io.BytesIO(text.encode()).read)] == rows
    assert list(storage.items(io.BytesIO(b"[]").read)) == list(storage.items(io.BytesIO(b"").read)) == []
    asked = []
    next(storage.items(lambda n: asked.append(n) or b'[{"a": 1}, '))
    assert sum(asked) <= 10
    (tmp_path / "f.json").write_text(json.dumps(rows))
    got = storage.read_items(spark.createDataFrame([("f.json",), ("none.json",)], "path string"), str(tmp_path)).collect()
    assert [json.loads(r.value) for r in got] == rows


def test_files_are_written_in_arrays(spark, tmp_path):
    """each piece went through Python by itself. Files, and ranges within them, are as before across batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.createDataFrame([(f"f{i % 2}", f"h\u00e9:{i}", 4 if i % 3 == 0 else 0, i) for i in range(10)], "f string, piece string, skip int, o long")
        pieces = publish._pieces(rows, F.concat("f", F.lit(".json")), F.col("piece"), ["o"], skip=F.col("skip"), keep=["f", "o"])
        publish.write_files(pieces, str(tmp_path / "w"), ["f", "o"], str(tmp_path / "at"), "f")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(2):
        assert (tmp_path / f"w/f{k}.json").read_text() == "[" + ",".join(f"h\u00e9:{i}" for i in range(k, 10, 2)) + "]"
    for r in spark.read.parquet(str(tmp_path / "at")).collect():
        piece = f"h\u00e9:{r.o}".encode()[4 if r.o % 3 == 0 else 0 :]
        assert (tmp_path / "w" / r.path).read_bytes()[r.offset : r.offset + r.length] == piece


def test_single_pages_are_read_from_their_files(spark, tmp_path, monkeypatch):
    """the pages of slugs on 7 weren't read once more, but copied from what was read of all."""
    (tmp_path / "info").mkdir()
    (tmp_path / "info/index.json").write_text(json.dumps([{"slug": f"p-{k}", "errorCount": k} for k in (6, 7)]))
    for k in (6, 7):
        (tmp_path / f"info/p-{k}.json").write_text(json.dumps({"slug": f"p-{k}", "clusterKey": "k", "errorCount": k}))
    monkeypatch.setattr(parts, "_published", lambda spark, d: (str(tmp_path), {}))
    own = publish.read_pages
    monkeypatch.setattr(publish, "read_pages", lambda *a: own(*a).withColumn("errorCount", F.lit(99)))
    assert sorted(tuple(r) for r in queries.QUERIES["published_pages"](spark, "").select("slug", "listed", "paged", "one").collect()) == [("p-6", 6, 99, None), ("p-7", 7, 99, 7)]
