"""The stream of the queue against the batch operators; asking behind a gate, resumed after a crash."""

import json
import os
import time
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mishap import oracle
from mishap.operators import queue
from mishap.schema import QUEUE
from mishap.sinks.commits import Keyed
from mishap.sources.files import Config
from mishap.streaming.queue_stream import EVENT, run_queue

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
HOUR = 3_600_000


def at(hours):
    return START + timedelta(hours=hours)


def ms(hours):
    return int(at(hours).timestamp() * 1000)


def event(repo, hours, what, outcome=None, error=None, ran_at=0, held=False):
    return (repo, at(hours), what, outcome, error, ran_at, held)


FIRST = [
    *(event(r, 0, "asked") for r in "abcde"), *(event(r, 1, "claimed") for r in "abcd"), event("x", 1, "claimed"),
    event("a", 2, "settled", "done"), event("b", 2, "settled", "failed", "bad answer"), event("c", 2, "settled", "failed", "cannot fork"), event("d", 2, "settled", "failed", "no space left on device", 0, True),
    *(event(r, 3, "asked") for r in "abcdf"),
]
SECOND = [event("c", 4, "claimed"), event("c", 5, "settled", "failed", "EAGAIN", 1), event("a", 5, "claimed"), event("a", 6, "settled", "skipped"), event("e", 30, "asked")]


def by_batches(spark, events):
    """The table after the batch operators, one time of events after the other; asks during a cool-off come again at its end."""
    table, asks = spark.createDataFrame([], QUEUE), {}
    for hours in sorted({(e[1] - START).total_seconds() / 3600 for e in events} | {2 + 24}):
        now, own = ms(hours), [e for e in events if e[1] == at(hours)]
        rows = {r.repo: r for r in table.collect()}
        asked = [e[0] for e in own if e[2] == "asked"]
        for r in asked:
            if r in rows and rows[r].status == "failed" and now - rows[r].updated_at < 24 * HOUR:
                asks[r] = rows[r].updated_at + 24 * HOUR
        asked += [r for r, due in asks.items() if due == now]
        if asked:
            table = queue.seed(table, spark.createDataFrame([(r,) for r in asked], "repo string"), now).drop("change")
        for e in own:
            if e[2] == "claimed":
                table = queue.claim(table, e[0], now)
        outcomes = [(e[0], *e[3:]) for e in own if e[2] == "settled"]
        if outcomes:
            table = queue.settle(table, spark.createDataFrame(outcomes, "repo string, outcome string, error string, ran_at int, held_large boolean"), now)
        table = spark.createDataFrame(table.collect(), QUEUE)
    return {tuple(r) for r in table.collect()}


def put(spark, folder, events):
    spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").json(folder)


def test_the_stream_equals_the_batch_operators(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "events"), str(tmp_path / "cp")
    table = Keyed(spark, str(tmp_path / "q"), ["repo"], QUEUE)

    def run():
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(folder)
        run_queue(events, table, checkpoint).awaitTermination(120)
        return {tuple(r) for r in table.read().collect()}

    put(spark, folder, FIRST)
    got = run()
    assert got == by_batches(spark, FIRST) - {r for r in by_batches(spark, FIRST) if r[0] == "b"} | {("b", 0, "failed", 1, 0, "bad answer", ms(2))}
    # a new run goes on from the checkpoint; b's timer goes off once the events have passed its cool-off
    put(spark, folder, SECOND)
    assert run() == by_batches(spark, FIRST + SECOND)
    assert {r.repo: (r.status, r.updated_at) for r in table.read().collect()}["b"] == ("queued", ms(26))


class Counting:
    """Answers after a moment, and notes the calls in flight and each call; dies after `die` calls."""

    def __init__(self, folder, die=None):
        self.folder, self.die = str(folder), die
        os.makedirs(f"{folder}/now", exist_ok=True)

    def ask(self, prompt):
        name = uuid.uuid4().hex
        open(f"{self.folder}/now/{name}", "w").close()
        n = len(os.listdir(f"{self.folder}/now"))
        time.sleep(0.1)
        os.remove(f"{self.folder}/now/{name}")
        if self.die is not None and len(self.calls()) >= self.die:
            raise KeyboardInterrupt
        with open(f"{self.folder}/{name}.call", "w") as f:
            json.dump([prompt, n], f)
        return json.dumps({"said": prompt}) if prompt != "never" else "no JSON"

    def calls(self):
        return [json.load(open(f"{self.folder}/{n}")) for n in os.listdir(self.folder) if n.endswith(".call")]


def test_a_gate_for_all_tasks(spark, tmp_path):
    model = Counting(tmp_path / "model")
    prompts = spark.createDataFrame([(i, f"p{i % 24}") for i in range(30)] + [(99, "never"), (100, None)], "key long, prompt string").repartition(6)
    rows = {r.key: (r.json, r.error) for r in oracle.ask_resumably(prompts, [model], str(tmp_path / "kept"), 2).collect()}
    assert rows[29] == ('{"said": "p5"}', None) and rows[99][0] is None and rows[99][1]
    assert len(rows) == 32 and rows[100] == (None, "empty")
    calls = model.calls()
    assert max(n for _, n in calls) <= 2 and sorted(p for p, _ in calls if p != "never") == sorted(f"p{i}" for i in range(24))
    assert oracle.slots(Config(max_concurrent=3, batch_concurrency=2)) == 6 and oracle.slots(Config(max_concurrent=3, batch_concurrency=2, provider_max_concurrent=4)) == 4


def test_a_killed_run_asks_no_answered_prompt_again(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "key long, prompt string")
    first, second, folder = Counting(tmp_path / "one", die=5), Counting(tmp_path / "two"), str(tmp_path / "kept")
    with pytest.raises(Exception):
        oracle.ask_resumably(prompts, [first], folder, 1).collect()
    answered = {p for p, _ in first.calls()}
    assert len(answered) == 5
    rows = {r.key: r.json for r in oracle.ask_resumably(prompts, [second], folder, 3).collect()}
    assert rows == {i: json.dumps({"said": f"p{i}"}) for i in range(12)}
    assert {p for p, _ in second.calls()} == {f"p{i}" for i in range(12)} - answered
    assert prompts.where(F.lit(False)).count() == 0 and oracle.ask_resumably(prompts.limit(0), [second], folder, 1).count() == 0


class Narrow(Counting):
    """Times out over `most` items, has no answer to what holds an x."""

    most = 12

    def ask(self, prompt):
        super().ask(prompt)
        if prompt.count(",") >= self.most:
            raise TimeoutError("late")
        return "no" if "x" in prompt else json.dumps({"n": prompt.count(",") + 1})


def test_batches_are_halved_level_by_level(spark, tmp_path):
    """Deep: down to short parts, whose failures are their own. Once: only after timeouts. Later runs ask halves at once."""
    items = [str(i) for i in range(29)]
    rows = [("a", items), ("b", [*items[:9], "x"]), ("c", []), ("c", None), (None, ["7"])]
    batches = spark.createDataFrame(rows, "key string, items array<string>")
    text = lambda c: F.array_join(c, ",")
    ask = lambda model, folder, **k: sorted(((r.key, r.at, len(r["items"]), r.json, (r.error or "")[:7]) for r in oracle.ask_batches(batches, [model], str(folder), 2, text, **k).collect()), key=str)
    yes = lambda n: json.dumps({"n": n})
    first = Narrow(tmp_path / "one")
    deep = [("a", 0, 8, yes(8), ""), ("a", 15, 7, yes(7), ""), ("a", 22, 7, yes(7), ""), ("a", 8, 7, yes(7), ""), ("b", 0, 5, yes(5), ""), ("b", 5, 5, None, "parse"), (None, 0, 1, yes(1), "")]
    assert ask(first, tmp_path / "kept", deep=True) == sorted(deep, key=str)
    assert {p.count(",") + 1 for p, _ in first.calls()} == {29, 15, 14, 8, 7, 10, 5, 1} and max(n for _, n in first.calls()) <= 2
    later = Narrow(tmp_path / "two")
    assert ask(later, tmp_path / "kept", deep=True) == sorted(deep, key=str)
    assert {p for p, _ in later.calls()} == {",".join(rows[1][1]), ",".join(rows[1][1][5:])}  # only what failed, and what it is a half of
    once = ask(Narrow(tmp_path / "three"), tmp_path / "fresh")
    assert [r for r in once if r[0] == "a"] == [("a", 0, 15, None, "timeout"), ("a", 15, 14, None, "timeout")] and ("b", 0, 10, None, "parse") in once
    assert oracle.ask_batches(batches.limit(0), [later], str(tmp_path / "none"), 1, text).count() == 0
