"""A drain of the work queue: rounds of claims, runs and settlements until nothing is left or a limit is hit.

The queue is a table of commits. A round claims up to `slots` rows in a commit, before they run;
has all of them run; and settles their outcomes in a commit of the rows that change. Rows and
outcomes stay tables, a round's counts are one row. Rows at level 2 run alone, at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mishap.functions.rules import claim_kind
from mishap.operators.queue import claim_next, is_escalated, reclaim, seed, seed_summary, settle
from mishap.sinks.commits import Keyed

OUTCOMES = "repo string, outcome string, error string, ran_at int, held_large boolean"


@dataclass
class Summary:
    added: int = 0
    requeued: int = 0
    ok: int = 0
    failed: int = 0
    skipped: int = 0
    infra_requeued: int = 0
    left_queued: int = 0
    tripped: bool = False
    stopped_for_restart: bool = False


@dataclass
class Limits:
    slots: int = 4
    breaker: int = 5  # failures in a row that stop a drain
    budget_ms: int = 240 * 60_000  # no claims after so long; 0: no end
    share: float = 0.25  # of claims that go to known repos
    reclaim: bool = True  # whether running rows are those of a dead drain; not while another drain is at work


def drain(table: Keyed, corpus: DataFrame, repos: DataFrame, run: Callable[[DataFrame], DataFrame], clock: Callable[[], int], limits: Limits = Limits()) -> dict:
    """Drains a queue (a table of commits by repo); what happened.

    run: claimed rows (repo, solo, kind, place, ...) to outcomes (repo, outcome done/skipped/failed,
    error, ran_at, held_large), a row each; a claimed row without one has failed. A crash leaves rows
    running, which the next drain queues again. Skipped claims earn their kind no share. The breaker
    counts failures in the order of a round's claims; one success starts it anew."""
    out, began = Summary(), clock()
    seeded = table.commit(lambda queue: seed(queue, corpus, began).where("change is not null"))
    if seeded:
        first = seed_summary(seeded.rows).first()
        out.added, out.requeued = first.added, first.requeued
    if limits.reclaim:
        table.commit(lambda queue: reclaim(queue.where("status = 'running'"), began))
    started, row = {"fresh": 0, "rescan": 0}, 0
    for exclusive in (False, True):
        while not out.tripped:
            if limits.budget_ms and clock() - began >= limits.budget_ms:
                out.stopped_for_restart = True
                break
            claimed = claim_next(table, repos, 1 if exclusive else limits.slots, clock(), exclusive, claim_kind(started["fresh"], started["rescan"], limits.share))
            if claimed is None:
                break
            # runs happen once, whatever reads their outcomes
            found = run(claimed).select("repo", "outcome", "error", "ran_at", "held_large")
            at = f"{table.root}/outcomes/{uuid.uuid4().hex}"
            known = claimed.select("repo", "kind", "place").join(found.hint("merge"), "repo", "left")
            known.withColumn("error", F.when(F.col("outcome").isNull(), "no outcome").otherwise(F.col("error"))).fillna({"outcome": "failed", "ran_at": 0, "held_large": False}).write.parquet(at)
            outcomes = claimed.sparkSession.read.parquet(at)
            now = clock()
            table.commit(lambda queue: settle(queue.join(outcomes.select("repo").hint("merge"), "repo", "left_semi"), outcomes.select("repo", "outcome", "error", "ran_at", "held_large"), now))
            row = _count(out, outcomes, started, row, limits.breaker)
    out.left_queued = table.read().where("status = 'queued'").count()
    out.stopped_for_restart = out.stopped_for_restart and out.left_queued > 0
    return asdict(out)


def _count(out: Summary, outcomes: DataFrame, started: dict[str, int], row: int, breaker: int) -> int:
    """Adds a round's outcomes to the summary; failures in a row at its end. row: those at its start."""
    rows = outcomes.withColumn("infra", is_escalated()).withColumn("failed", (F.col("outcome") == "failed").cast("int"))
    # failures between two successes, in the order of at most `slots` claims
    rows = rows.withColumn("since", F.sum((F.col("outcome") == "done").cast("int")).over(Window.orderBy("place")))
    runs = rows.groupBy("since").agg(
        F.sum("failed").alias("failed"), F.count_if("infra").alias("infra"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "skipped")), *(F.count_if((F.col("outcome") != "skipped") & (F.col("kind") == k)).alias(k) for k in started)
    )
    length = F.col("failed") + F.when(F.col("since") == 0, row).otherwise(0)
    r = runs.agg(F.max(length).alias("longest"), F.max_by(length, "since").alias("last"), *(F.sum(c).alias(c) for c in ("failed", "infra", "done", "skipped", *started))).first()
    out.ok, out.skipped, out.failed, out.infra_requeued = out.ok + r.done, out.skipped + r.skipped, out.failed + r.failed - r.infra, out.infra_requeued + r.infra
    # a breaker that trips within a round trips: its claims had all been started
    out.tripped = out.tripped or bool(r.failed) and r.longest >= breaker
    for kind in started:
        started[kind] += r[kind]
    return r.last
