"""The queue as streams: the corpus list seeds it; or events drive it, with state by repo and timers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mishap.functions.rules import HOST_FAULT
from mishap.operators.queue import COOLOFF_MS, seed
from mishap.schema import QUEUE
from mishap.sinks.commits import Keyed


def seed_from_stream(spark: SparkSession, corpus_dir: str, queue_dir: str, checkpoint: str, now: Callable[[], int] = lambda: int(time.time() * 1000)):
    """Merges each micro-batch of corpus lines into the queue, a table of commits. Seeding twice changes nothing more."""
    table = Keyed(spark, queue_dir, ["repo"], QUEUE)

    def merge(batch: DataFrame, _: int) -> None:
        corpus = batch.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("repo")).where("repo != ''")
        at = now()
        table.commit(lambda queue: seed(queue, corpus, at).where("change is not null").drop("change"))

    lines = spark.readStream.format("text").load(corpus_dir)
    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What happens to a repo of the queue: asked (by the corpus), claimed, or settled with an outcome.
EVENT = StructType()
for _name, _kind in {"repo": "string", "at": "timestamp", "what": "string", "outcome": "string", "error": "string", "ran_at": "integer", "held_large": "boolean"}.items():
    EVENT.add(_name, _kind)


def _settled(row: dict, e) -> dict:
    """The row after an outcome, by the rule of operators.queue.settle."""
    infra = e.outcome == "failed" and bool(re.search(HOST_FAULT, e.error or "", re.I | re.A)) and e.ran_at < 2
    level = (2 if e.ran_at >= 1 or e.held_large else 1) if infra else row["solo"]
    return row | {"status": "queued" if infra else e.outcome, "solo": level, "last_error": e.error}


def _advance(cooloff: int):
    """Keyed state of one repo: its queue row, and whether it was asked for while it cools off."""
    fields = QUEUE.fieldNames()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *values, waits = state.get if state.exists else (key[0], 0, None, 0, 0, None, 0, False)
        row, before = dict(zip(fields, values)), tuple(values) if state.exists else None

        def requeued(now: int) -> dict:
            return row | {"status": "queued", "solo": 0, "last_error": None, "updated_at": now}

        if state.hasTimedOut:
            row, waits = requeued(row["updated_at"] + cooloff), False
        else:
            events = pd.concat(list(batches)).sort_values("at", kind="stable")
            for e in events.itertuples():
                now = int(e.at.timestamp() * 1000)
                if waits and now >= row["updated_at"] + cooloff:  # events came before the timer could
                    row, waits = requeued(row["updated_at"] + cooloff), False
                if e.what == "asked" and row["status"] not in ("queued", "running"):
                    waits = row["status"] == "failed" and now - row["updated_at"] < cooloff
                    row = row if waits else requeued(now)
                elif e.what == "claimed" and row["status"] == "queued":
                    row = row | {"status": "running", "attempts": row["attempts"] + 1, "updated_at": now}
                elif e.what == "settled" and row["status"] is not None:
                    row, waits = _settled(row, e) | {"updated_at": now}, False
        if row["status"] is None:  # claims and outcomes of unknown repos
            return
        state.update((*(row[f] for f in fields), waits))
        if waits:
            state.setTimeoutTimestamp(max(row["updated_at"] + cooloff, state.getCurrentWatermarkMs() + 1))
        if tuple(row.values()) != before:
            yield pd.DataFrame([row])[fields]

    return run


def queue_changes(events: DataFrame, cooloff: int = COOLOFF_MS, late: str = "0 seconds") -> DataFrame:
    """Changed queue rows of a stream of EVENTs, one row a repo and micro-batch at most.

    The same as seeding, claiming and settling the table event by event, and more: a failed repo that
    is asked for during its cool-off is remembered, and a timer queues it again when that ends. Host
    faults are queued again at once, at the next level. Events later than `late` don't count."""
    held = StructType([*QUEUE, *StructType.fromDDL("waits boolean")])
    return events.withWatermark("at", late).groupBy("repo").applyInPandasWithState(_advance(cooloff), QUEUE, held, "update", "EventTimeTimeout")


def run_queue(events: DataFrame, table: Keyed, checkpoint: str, **more):
    """A started stream that commits the changes of each micro-batch. One that is run again after a crash commits the same rows again."""

    def put(batch: DataFrame, _: int) -> None:
        table.commit(batch)

    return queue_changes(events, **more).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event type and window, with a watermark; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
