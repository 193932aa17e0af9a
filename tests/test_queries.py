"""Every query against its SQL on the smallest tables, where those are there."""

from pathlib import Path

import pytest

from mishap.plans import parts  # noqa: F401  adds its queries
from mishap.plans.queries import QUERIES
from mishap.plans.sql import SQL

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return repr(x)
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) else repr(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert normal(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect())) == normal(want)


def test_queries_without_sql(spark):
    assert set(QUERIES) == set(SQL)
    assert QUERIES["extract_json"](spark, str(SF)).where("said is null").count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_guides_match_whole_pages(spark, tmp_path):
    """Phrases past 100,000 characters count, in each query on guides."""
    rows = [(2, "https://a.example.com/x", "y " * 60_000 + "handshake"), (3, "https://b.example.com/x", "plain"), (4, "https://c.example.com/x", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [tuple(r) for r in QUERIES["guide_matches"](spark, str(tmp_path)).collect()] == [("ssl-tls-certificates", 2, "a.example.com")]
    assert [(r.guide, r.repo, r.n, r.shown) for r in QUERIES["guide_top_repos"](spark, str(tmp_path)).collect()] == [("ssl-tls-certificates", "com", 1, "2")]
    assert [tuple(r) for r in QUERIES["guide_counts"](spark, str(tmp_path)).collect()] == [("info", "p1", 4), ("guide", "ssl-tls-certificates", 1)]


def test_extraction_meets_whole_texts(spark, tmp_path):
    """Answers and lines keep their length; only the operator's own limits (literals of 200, lines of 500) hold."""
    said = 'it {said} "so" ' * 100
    spark.createDataFrame([(1, turn, said) for turn in range(3)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["extract_json"](spark, str(tmp_path)).collect()
    assert [r.said for r in got] == [said] * 3
    text = "\n".join(c * n for c, n in (("a", 60), ("b", 61), ("c", 200), ("d", 201), ("e", 600)))
    spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sites = QUERIES["extract_sites"](spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.line, r.literal) for r in sites] == [(1, "a" * 60), (2, "b" * 61), (3, "c" * 200), (4, None)]
