"""The work queue as a state table: seeding, claiming, settling, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishap.functions.rules import is_host_fault
from mishap.sinks.commits import Keyed

COOLOFF_MS = 24 * 3_600_000


def seed(queue: DataFrame, corpus: DataFrame, now: int, cooloff: int = COOLOFF_MS) -> DataFrame:
    """The queue after a seeding, with change: added, requeued or null.

    Unknown repos are added; settled ones are queued again, failed ones after the cool-off; queued
    and running rows stay as they are."""
    rows = queue.join(corpus.select("repo").distinct().withColumn("__c", F.lit(True)), "repo", "full")
    settled = F.col("__c") & ~F.col("status").isin("queued", "running")
    due = settled & ~((F.col("status") == "failed") & (now - F.col("updated_at") < cooloff))
    added = F.col("status").isNull()
    change = F.when(added, "added").when(due, "requeued")
    new = {
        "priority": F.coalesce("priority", F.lit(0)),
        "status": F.when(change.isNotNull(), "queued").otherwise(F.col("status")),
        "attempts": F.coalesce("attempts", F.lit(0)),
        "solo": F.when(change.isNotNull(), 0).otherwise(F.col("solo")),
        "last_error": F.when(change.isNull(), F.col("last_error")),
        "updated_at": F.when(change.isNotNull(), F.lit(now)).otherwise(F.col("updated_at")),
    }
    return rows.select("repo", *(v.cast(queue.schema[k].dataType).alias(k) for k, v in new.items()), change.alias("change"))


def seed_summary(seeded: DataFrame) -> DataFrame:
    return seeded.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "requeued").alias("requeued"))


def claim_order(queue: DataFrame, repos: DataFrame, exclusive: bool = False, prefer: str = "fresh") -> DataFrame:
    """Queued rows of the level in the order of claims: preferred kind, priority, age, name."""
    rows = queue.where("status = 'queued'").where(F.col("solo") == 2 if exclusive else F.col("solo") < 2)
    return rows.join(repos.select("repo", "analyzed_sha").hint("merge"), "repo", "left").orderBy(*order_of_claims(prefer))


def order_of_claims(prefer: str) -> list[Column]:
    other = F.col("analyzed_sha").isNull() if prefer == "rescan" else F.col("analyzed_sha").isNotNull()
    return [other, F.desc("priority"), F.col("updated_at"), F.col("repo")]


def claim(queue: DataFrame, repo: str, now: int) -> DataFrame:
    mine = (F.col("repo") == repo) & (F.col("status") == "queued")
    return _patch(queue, mine, **_claimed(now))


def _claimed(now: int) -> dict[str, Column]:
    return {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "updated_at": F.lit(now)}


def claim_next(table: Keyed, repos: DataFrame, slots: int, now: int, exclusive: bool = False, prefer: str = "fresh") -> DataFrame | None:
    """Marks the first `slots` rows in the order of claims as running, in one commit; None if none is queued.

    Returns them with place (from 1, in that order) and kind (fresh, rescan). A row is claimed only if
    it is still queued when the commit is made: of several that claim at once, each gets other rows."""

    def take(queue: DataFrame) -> DataFrame:
        rows = claim_order(queue, repos, exclusive, prefer).limit(slots)
        place = F.row_number().over(Window.orderBy(*order_of_claims(prefer)))  # of `slots` rows
        rows = rows.select("*", place.alias("place"), F.when(F.col("analyzed_sha").isNotNull(), "rescan").otherwise("fresh").alias("kind"))
        return _patch(rows.drop("analyzed_sha"), F.lit(True), **_claimed(now))

    made = table.commit(take)
    return made and made.rows


def reclaim(queue: DataFrame, now: int) -> DataFrame:
    """Rows that a dead run left running, queued again."""
    return _patch(queue, F.col("status") == "running", status=F.lit("queued"), updated_at=F.lit(now))


def is_escalated() -> Column:
    """Whether an outcome (outcome, error, ran_at) is a host fault that gets another run, alone or with fewer others."""
    return F.coalesce((F.col("outcome") == "failed") & is_host_fault(F.col("error")) & (F.col("ran_at") < 2), F.lit(False))


def settle(queue: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """The queue after outcomes (repo, outcome done/skipped/failed, error, ran_at, held_large).

    A host fault below level 2 is queued again, at level 2 if it ran at level 1 or held the large
    slot, else at 1; other failures settle."""
    rows = queue.join(outcomes.hint("merge"), "repo", "left")  # a round's outcomes don't pass the driver
    infra = is_escalated()
    level = F.when((F.col("ran_at") >= 1) | F.col("held_large"), 2).otherwise(1)
    hit = F.col("outcome").isNotNull()
    new = {
        "status": F.when(infra, "queued").when(hit, F.col("outcome")).otherwise(F.col("status")),
        "solo": F.when(infra, level).otherwise(F.col("solo")),
        "last_error": F.when(hit, F.col("error")).otherwise(F.col("last_error")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return rows.select(*(new[c].cast(queue.schema[c].dataType).alias(c) if c in new else F.col(c) for c in queue.columns))


def after_failure(repos: DataFrame, failed: DataFrame) -> DataFrame:
    """A failure keeps a published version; only repos never published become failed."""
    rows = repos.join(failed.select("repo", F.col("error").alias("__e")), "repo", "left")
    status = F.when(F.col("__e").isNotNull() & F.col("analyzed_sha").isNull(), "failed").otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("last_error", F.coalesce("__e", "last_error")).select(*repos.columns)


def requested(asked: DataFrame, failed: DataFrame, active: DataFrame) -> DataFrame:
    """Asked-for and failed repos that aren't at work."""
    return asked.select("repo").union(failed.select("repo")).distinct().join(active.select("repo"), "repo", "left_anti")


def pending_count(queue: DataFrame) -> DataFrame:
    return queue.where("status in ('queued', 'running')").agg(F.count("*").alias("pending"))


def summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def publish_due(repos: int, last_ms: int, now_ms: int, changed: bool, slow_from: int = 150, slow_ms: int = 4 * 3_600_000) -> bool:
    """Whether to publish: something changed, and large sets no more often than every four hours."""
    return changed and (repos < slow_from or now_ms - last_ms >= slow_ms)


def alert_due(failures: int) -> bool:
    """At the second failure in a row, and at each whose number in the row is a multiple of twelve."""
    return failures == 2 or (failures > 0 and failures % 12 == 0)


def _patch(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    return rows.select(*(F.when(where, values[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in rows.columns))


def reset(repos: DataFrame, records: DataFrame, log: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(repos, records, log, summary) with the repos of `which` back to pending: without records, runs, version and failure.

    The summary counts what went: (repo, errorsDeleted, jobsDeleted). Other facts of a repo stay."""
    named = which.select("repo").distinct()
    counts = lambda rows, c: rows.join(named, "repo", "left_semi").groupBy("repo").agg(F.count("*").alias(c))
    summary = named.join(repos.select("repo"), "repo", "left_semi").join(counts(records, "errorsDeleted"), "repo", "left").join(counts(log, "jobsDeleted"), "repo", "left").fillna(0, ["errorsDeleted", "jobsDeleted"])
    hit = repos.join(named.withColumn("__r", F.lit(True)), "repo", "left")
    new = {"status": F.lit("pending"), "last_error": F.lit(None), "analyzed_sha": F.lit(None), "analyzed_at": F.lit(None), "error_count": F.lit(0)}
    back = hit.select(*(F.when(F.col("__r"), new[c]).otherwise(F.col(c)).cast(repos.schema[c].dataType).alias(c) if c in new else F.col(c) for c in repos.columns))
    return back, records.join(named, "repo", "left_anti").select(*records.columns), log.join(named, "repo", "left_anti").select(*log.columns), summary
