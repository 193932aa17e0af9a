"""Language models behind an interface: prompts in, texts out. The engine runs without one."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishap.functions.rules import RATE_LIMIT
from mishap.sources.files import Config
from mishap.sources.payloads import find_json
from mishap.storage import exists, open_root
from mishap.workers import reach


#: Seconds after which a file of answers is closed: where open files can't be read, a crash loses so much of a slot.
KEEP_OPEN_S = 5.0


class Oracle(Protocol):
    def ask(self, prompt: str) -> str: ...


class Fixed:
    """Answers from a table of recorded prompts; unknown prompts get an empty text."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def ask(self, prompt: str) -> str:
        return self.answers.get(prompt, "")


def ask_json(prompt: str, oracles: Iterable[Oracle], tries: int = 2, pause: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(JSON, error): each oracle is tried twice, once if it times out, after a pause if it asks for patience."""
    error = "no oracle"
    for oracle in oracles:
        for n in range(tries):
            try:
                found, error = find_json(oracle.ask(prompt))
                if found is not None:
                    return found, None
            except TimeoutError as e:
                error = f"timeout: {e}"
                break
            except Exception as e:  # whatever a provider raises is its failure, not the batch's
                error = str(e)
            if n + 1 < tries and re.search(RATE_LIMIT, error or "", re.I):
                sleep(pause)
    return None, error


def answer(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """prompts (key, prompt) with the recorded answer, by join: the deterministic oracle."""
    return prompts.join(recorded.select("prompt", "answer"), "prompt", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def answer_with(prompts: DataFrame, oracles: list[Oracle]) -> DataFrame:
    """prompts (key, prompt) to (key, json, error), asked by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask_json(p, oracles) for p in b["prompt"]]
            yield pd.DataFrame({"key": b["key"], "json": [g[0] for g in got], "error": [g[1] for g in got]})

    reach(prompts.sparkSession)
    return prompts.select("key", "prompt").mapInPandas(run, f"key {prompts.schema['key'].dataType.simpleString()}, json string, error string")


def slots(config: Config) -> int:
    """Calls that may be in flight: the batches of all projects at work, up to the provider's gate if it has one."""
    wanted = config.max_concurrent * config.batch_concurrency
    return min(wanted, config.provider_max_concurrent or wanted)


def ask_resumably(prompts: DataFrame, oracles: list[Oracle], folder: str, at_once: int, pause: float = 30.0) -> DataFrame:
    """prompts (key, prompt) to (key, json, error), with at most `at_once` calls in flight; answers last.

    The gate is a number of dealt slots: so many tasks, each of which asks one prompt after the other.
    An answer is kept under its prompt's content key as soon as it is there, and what has one is
    not asked again: not by a task that is run again, not by a later run, not for a prompt that comes
    twice. Failures aren't kept. A slot appends its answers to a file, which it closes after some seconds
    for a new one: files grow with the time that the asking takes, not with the prompts. `folder` is one
    that driver and executors share."""
    spark, kind, name = prompts.sparkSession, prompts.schema["key"].dataType, uuid.uuid4().hex
    reach(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(f"{folder}/answers/{name}/{TaskContext.get().partitionId()}")
        files.create_dir(base, recursive=True)
        known, out, opened = set(), None, 0.0
        for info in files.get_file_info(fs.FileSelector(base)):  # of earlier tries of this task
            with files.open_input_stream(info.path, compression=None) as f:
                known.update(m[1] for m in re.finditer(r'^\{"content": "(\w+)".*\}$', f.read().decode(), re.M))
        try:
            for batch in batches:
                for content, prompt in zip(batch.column("content").to_pylist(), batch.column("prompt").to_pylist()):
                    found, error = (None, None) if content in known else ask_json(prompt, oracles, pause=pause)
                    if found is not None:
                        if out is None:
                            out, opened = files.open_output_stream(f"{base}/{uuid.uuid4().hex}.json", compression=None), time.monotonic()
                        out.write((json.dumps({"content": content, "json": found}) + "\n").encode())
                        out.flush()
                    if out is not None and time.monotonic() - opened > KEEP_OPEN_S:
                        out.close()
                        out = None
                    yield pa.RecordBatch.from_arrays([pa.array([content]), pa.array([error], pa.string())], names=["content", "error"])
        finally:
            if out is not None:
                out.close()

    def kept() -> DataFrame:
        if not exists(spark, f"{folder}/answers"):
            return spark.createDataFrame([], "content string, json string")
        rows = spark.read.schema("content string, json string").option("recursiveFileLookup", "true").json(f"{folder}/answers")
        return rows.where("content is not null and json is not null").dropDuplicates(["content"])  # a line cut short by a crash has no answer

    named = prompts.select("key", "prompt", F.sha2("prompt", 256).alias("content"))
    asked = named.where("prompt is not null").select("content", "prompt").dropDuplicates(["content"])
    asked = asked.join(kept().select("content"), "content", "left_anti").repartition(at_once, "content")
    turn = f"{folder}/turns/{name}"
    asked.mapInArrow(run, "content string, error string").write.parquet(turn)  # the asking happens here, once
    failed = spark.read.schema("content string, error string").parquet(turn).where("error is not null")
    out = named.join(kept(), "content", "left").join(failed, "content", "left")
    return out.select(F.col("key").cast(kind).alias("key"), "json", F.when(F.col("json").isNull(), F.coalesce("error", F.lit("empty"))).alias("error"))


def ask_batches(batches: DataFrame, oracles: list[Oracle], folder: str, at_once: int, prompt: Callable[[Column], Column], least: int = 10, deep: bool = False, pause: float = 30.0) -> DataFrame:
    """Batches (key, items) to the parts that were asked last: (key, at, items, json, error), at being the
    place of a part's first item. `prompt` makes a prompt of a column of items.

    A batch of at least `least` items that timed out is asked again as two halves, the first being the
    longer one; with `deep`, whatever its error, and the halves likewise until they are shorter. A part
    that still fails loses its own items only. Parts of a level are asked together by
    `ask_resumably`, so the gate and the answers kept hold for halves, too; of what was split with
    success it is kept that it must be, so that a later run asks the halves at once. Empty batches aren't
    asked and have no rows; keys may repeat, a null prompt is an error of its part."""
    spark, turn = batches.sparkSession, f"{folder}/turns/{uuid.uuid4().hex}"
    split = spark.read.schema("content string").parquet(f"{folder}/splits") if exists(spark, f"{folder}/splits") else spark.createDataFrame([], "content string")
    parts = batches.where(F.size("items") > 0).select(F.expr("uuid()").alias("part"), "key", F.lit(0).alias("at"), "items", F.array().cast("array<string>").alias("above"))
    level, last = 0, []
    while True:
        named = parts.withColumn("prompt", prompt(F.col("items"))).withColumn("content", F.sha2("prompt", 256))
        named.join(split.withColumn("known", F.lit(True)).distinct(), "content", "left").write.parquet(f"{turn}/asked{level}")
        named = spark.read.parquet(f"{turn}/asked{level}")
        may = (F.size("items") >= least) & F.lit(deep or level == 0)
        straight = F.coalesce("known", F.lit(False)) & may
        got = ask_resumably(named.where(~straight).select(F.col("part").alias("key"), "prompt"), oracles, folder, at_once, pause)
        named.join(got.select(F.col("key").alias("part"), "json", "error"), "part", "left").write.parquet(f"{turn}/told{level}")
        told = spark.read.parquet(f"{turn}/told{level}")
        again = straight | (may & F.col("json").isNull() & (F.lit(deep) | F.coalesce(F.startswith("error", F.lit("timeout")), F.lit(False))))
        last.append(told.where(~again).select("key", "at", "items", "json", "error", "above"))
        more = told.where(again)
        if more.isEmpty():
            break
        half = F.ceil(F.size("items") / 2).cast("int")
        halves = F.array(F.struct(F.col("at"), F.slice("items", F.lit(1), half).alias("items")), F.struct((F.col("at") + half).alias("at"), F.slice("items", half + 1, F.size("items") - half).alias("items")))
        parts = more.select("key", F.array_append("above", F.col("content")).alias("above"), F.explode(halves).alias("h")).select(F.expr("uuid()").alias("part"), "key", "h.at", "h.items", "above")
        level += 1
    out = reduce(DataFrame.union, last)
    if level:
        worked = out.select(F.explode("above").alias("content"), "json").groupBy("content").agg(F.bool_and(F.col("json").isNotNull()).alias("all")).where("all").select("content")
        worked.join(split, "content", "left_anti").write.mode("append").parquet(f"{folder}/splits")
    return out.drop("above")


def split_batch(items: list, works: Callable[[list], bool], least: int = 10) -> list[list]:
    """Batches that work: one that fails is halved until it has fewer than `least` items."""
    if works(items) or len(items) < least:
        return [items]
    half = -(-len(items) // 2)
    return split_batch(items[:half], works, least) + split_batch(items[half:], works, least)


def ask_or_halve(items: list, ask: Callable[[list], tuple[str | None, str | None]], least: int = 10, known: dict | None = None, key: Callable[[list], str] = repr) -> list[str] | None:
    """Answers of a batch, in order: one for all, or one a half if it timed out and has `least` items; None if any is missing.

    Only a timeout is split, and only once: other failures would come again, and cost again. `known`
    holds answers by batch: what it has isn't asked for, and answers are put there, also the halves'
    under the whole's key, so that a later run need not find out anew that the batch must be split."""
    known = {} if known is None else known

    def one(part: list) -> tuple[list[str] | None, str | None]:
        if key(part) in known:
            return known[key(part)], None
        found, error = ask(part)
        if found is not None:
            known[key(part)] = [found]
        return (None if found is None else [found]), error

    got, error = one(items)
    if got is None and (error or "").startswith("timeout") and len(items) >= least:
        half = -(-len(items) // 2)
        parts = [one(items[:half])[0], one(items[half:])[0]]
        got = None if None in parts else parts[0] + parts[1]
        if got is not None:
            known[key(items)] = got
    return got
