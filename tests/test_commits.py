"""Tables of commits: several writers, crashes after each step, claims."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from mishap import storage
from mishap.operators import drain, queue
from mishap.schema import BATCH, QUEUE
from mishap.sinks import commits, state
from mishap.sinks.commits import Keyed


@pytest.fixture
def table(spark, tmp_path):
    return Keyed(spark, str(tmp_path / "t"), ["k"], "k string, n int")


def rows(spark, *values):
    return spark.createDataFrame(values, "k string, n int")


def all_of(table, number=None):
    return sorted((tuple(r) for r in table.read(number).collect()), key=str)


def plus_one(df):
    return df.withColumn("n", F.col("n") + 1)


def test_commits(spark, table):
    assert all_of(table) == [] and table.number() == -1
    assert table.commit(rows(spark)) is None and table.number() == -1
    table.commit(rows(spark, ("a", 1), ("a", 2), ("b", 3)))
    table.commit(rows(spark, ("a", 9), ("c", None)))
    assert all_of(table) == [("a", 9), ("b", 3), ("c", None)]
    # keys without rows are gone
    table.commit((rows(spark, ("d", 4)), spark.createDataFrame([("b",), ("d",)], "k string")))
    assert all_of(table) == [("a", 9), ("c", None), ("d", 4)] and all_of(table, 0) == [("a", 1), ("a", 2), ("b", 3)]
    assert table.commit(lambda _: None) is None and table.number() == 2


def test_whole_tables_now_and_then(spark, table, monkeypatch):
    monkeypatch.setattr(commits, "EVERY", 3)
    for i in range(8):
        table.commit(rows(spark, (f"k{i % 3}", i)))
    assert all_of(table) == [("k0", 6), ("k1", 7), ("k2", 5)]
    assert len(table._entries()) <= 4 and all_of(table, 1) == [("k0", 0), ("k1", 1)]


def test_a_second_writer_makes_its_change_again(spark, table):
    table.commit(rows(spark, ("a", 1)))
    other, calls = Keyed(spark, table.root, ["k"], table.schema), []

    def slow(df):
        if not calls:
            other.commit(plus_one)  # is faster
        calls.append(1)
        return plus_one(df)

    table.commit(slow)
    assert all_of(table) == [("a", 3)] and len(calls) == 2 and table.number() == 2
    # what doesn't depend on the table is written once, and both writers' keys stay
    real, first = commits.write_once, []

    def taken(spark_, path, text):
        if not first:
            first.append(1)
            monkey.setattr(commits, "write_once", real)
            other.commit(rows(spark, ("b", 1)))
        return real(spark_, path, text)

    with pytest.MonkeyPatch.context() as monkey:
        monkey.setattr(commits, "write_once", taken)
        table.commit(rows(spark, ("c", 1)))
    assert all_of(table) == [("a", 3), ("b", 1), ("c", 1)] and table.sweep() == 0


@pytest.mark.parametrize("step", ["rows", "keys", "log", "after"])
def test_a_crash_leaves_the_state_before_or_after(spark, table, monkeypatch, step):
    table.commit(rows(spark, ("a", 1)))

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    if step == "rows":
        monkeypatch.setattr(Keyed, "_write", crash)
    elif step == "keys":
        real_write = Keyed._write
        monkeypatch.setattr(Keyed, "_write", lambda self, made: (real_write(self, made), crash()))
    elif step == "log":
        monkeypatch.setattr(commits, "write_once", crash)
    else:
        real_once = commits.write_once
        monkeypatch.setattr(commits, "write_once", lambda *x: (real_once(*x), crash()))
    with pytest.raises(Crash):
        table.commit(plus_one)
    monkeypatch.undo()
    assert all_of(table) == [("a", 2 if step == "after" else 1)]
    table.commit(plus_one)
    assert all_of(table) == [("a", 3 if step == "after" else 2)]
    assert table.sweep() == {"rows": 0, "keys": 1, "log": 1, "after": 0}[step] and len(all_of(table)) == 1


def test_write_once_and_write_text(spark, tmp_path):
    at = f"file://{tmp_path}/x/one.json"
    assert storage.write_once(spark, at, "1") and not storage.write_once(spark, at, "2")
    assert storage.read_text(spark, at) == "1" and storage.names(spark, f"{tmp_path}/x") == ["one.json"]
    storage.write_text(spark, at, "é3")
    assert storage.read_text(spark, at) == "é3" and storage.names(spark, f"{tmp_path}/x") == ["one.json"]
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: storage.write_once(spark, f"{tmp_path}/x/two", str(i)), range(16))) == 1


def test_claims_of_two_drains_never_meet(spark, tmp_path):
    root = str(tmp_path / "q")
    queued = spark.createDataFrame([(f"r{i}", i % 3, "queued", 0, 0, None, i) for i in range(12)], QUEUE)
    Keyed(spark, root, ["repo"], QUEUE).commit(queued)
    repos = spark.createDataFrame([], "repo string, analyzed_sha string")

    def worker(_):
        table, mine = Keyed(spark, root, ["repo"], QUEUE), []
        while (got := queue.claim_next(table, repos, 2, 7)) is not None:
            mine.append([(r.place, r.repo) for r in got.orderBy("place").collect()])
        return mine

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(worker, range(2)))
    claimed = [r for mine in found for batch in mine for r in batch]
    assert sorted(r for _, r in claimed) == sorted(f"r{i}" for i in range(12))
    assert {(r.status, r.attempts) for r in Keyed(spark, root, ["repo"], QUEUE).read().collect()} == {("running", 1)}


def test_a_crashed_run_is_claimed_again(spark, tmp_path):
    """Claims are committed before they run: the next drain finds them running and queues them again."""
    table = Keyed(spark, str(tmp_path / "q"), ["repo"], QUEUE)
    corpus, repos = spark.createDataFrame([("a",), ("b",)], "repo string"), spark.createDataFrame([], "repo string, analyzed_sha string")

    def dies(claimed):
        raise OSError("gone")

    with pytest.raises(OSError):
        drain.drain(table, corpus, repos, dies, lambda: 5)
    assert {(r.repo, r.status, r.attempts) for r in table.read().collect()} == {("a", "running", 1), ("b", "running", 1)}
    fine = lambda claimed: claimed.select("repo", F.lit("done").alias("outcome"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("ran_at"), F.lit(False).alias("held_large"))
    assert drain.drain(table, corpus.limit(0), repos, fine, lambda: 6)["ok"] == 2
    assert {(r.repo, r.status, r.attempts) for r in table.read().collect()} == {("a", "done", 2), ("b", "done", 2)}


def test_batches(spark, tmp_path):
    table = state.batches(spark, str(tmp_path / "b"))
    put = lambda *key: table.commit(spark.createDataFrame([(*key, "said", 1)], BATCH))
    put("r", "old", "p", "1")
    put("r", "old", "p", "1")
    put("s", "old", "p", "1")
    put("r", "new", "p", "2")
    assert [r.batch_key for r in state.open_batches(table, "r", "new").collect()] == ["2"]
    assert {(r.repo, r.sha) for r in table.read().collect()} == {("r", "new"), ("s", "old")}


def test_records_of_two_writers(spark, tmp_path):
    root, schema = str(tmp_path / "r"), "repo string, id string"
    make = lambda repo: spark.createDataFrame([(repo, str(i)) for i in range(3)], schema)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda r: state.replace_repo_records(spark, root, make(r)), "abc"))
    assert {r.repo for r in state.read_records(spark, root).collect()} == {"a", "b", "c"}
    state.replace_repo_records(spark, root, make("b").limit(0), spark.createDataFrame([("b",)], "repo string"))
    assert sorted(r.repo for r in state.read_records(spark, root).collect()) == [*"aaaccc"]
