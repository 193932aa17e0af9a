"""The pipeline's stages against brute force, and queries against their SQL."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mishap.llm import decontaminate, minhash, register, substrings, toxicity
from tests.llm.test_operators import brute_contamination, prose, water
from tests.test_queries import duck, normal  # noqa: F401

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(SF)).cache()
        rows = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
            assert set(rows) == {i for i in before if not scored[i]}
        elif name == "near_dedup":
            want = minhash.brute_force(before)
            assert set(rows) == {i for i in before if want[i][2]}
        elif name == "suffix_dedup":
            want = dict(zip(before, substrings.brute_force(list(before.values()), substrings.LEAST)))
            assert set(rows) == set(before)
            assert all((rows[i].text == before[i]) == (want[i][1] == 0) and len(rows[i].text.encode()) <= want[i][0] - want[i][1] for i in before)
            assert all(r.n_chars == len(r.text) for i, r in rows.items() if want[i][1])
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            want = dict(zip(before, brute_contamination(list(before.values()), items, 13).values()))
            assert set(rows) == {i for i in before if not want[i][4]}
        else:
            sources = {r.doc_id: r.source for r in docs.collect()}
            sizes = {}
            for i, t in before.items():
                sizes[sources[i]] = sizes.get(sources[i], 0) + len((t or "").split())
            want = water(sizes, (5, 2, 1))
            taken = {}
            for i, r in rows.items():
                taken[sources[i]] = taken.get(sources[i], 0) + r.taken
            assert all(abs(taken.get(s, 0) - t) <= 0.1 * t + 2000 for s, t in want.items())
            assert out.columns == [*columns, "size", "source_size", "target", "taken"] and all(r.text == before[i] and r.score == "clash" for i, r in rows.items())
            continue
        assert out.columns == columns
        docs, before = out, {i: r.text for i, r in rows.items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, str(SF)).count() > 50


def test_one_whole_copy_of_repeated_rows_survives(spark):
    """Rows that repeat an id, and copies with null ids, are near copies as others are."""
    a, b, c = (prose(seed, 100) for seed in (1, 2, 3))
    rows = [(7, a), (7, a), (None, a), (8, b + " x"), (8, b), (None, c), (None, c), (9, None), (None, None), (3, a.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, str(SF)).cache()
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "near_dedup":
            assert [i for i, _ in got] == [3, 8, 9, None, None]
    assert (3, a.upper()) in got and (None, c) in got and (8, b) in [(i, (t or "").removesuffix(" x")) for i, t in got]
    assert docs.columns == before.columns
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, str(SF))
    assert sorted(r.doc_id or 0 for r in mixed.collect()) == [0, 3, 8]


def test_stages_take_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(SF))
        assert out.count() == 0
        docs = docs if "taken" in out.columns else out


@pytest.mark.parametrize("name", sorted(register.SQL))
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    df = register.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    found = duck.execute(register.SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert normal(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect())) == normal(want)


def test_planted_passage_is_found(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.createDataFrame([(1, "so " + passage.upper() + " end"), (2, "clean words only")], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert got == {1: True, 2: False}
