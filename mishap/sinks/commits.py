"""Keyed tables as a log of commits: compare-and-set by numbered files that are created once.

A commit carries, for some keys, all rows these keys have from then on (none: the keys are gone).
Its rows and keys are Parquet files in folders of the commit's own; then the next numbered file of
the log is created, which only one writer can do. A writer that comes second reads the new state,
makes its change again and takes the next number. Until its number is there a commit is not seen, so
that a crash at any step leaves the state before or the state after it.

Every so often a commit carries the whole table, and readers start from the last of those.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mishap.storage import names, read_text, remove, write_once

#: Commits between two whole tables, and tries of a change.
EVERY, TRIES = 32, 100


class Conflict(RuntimeError):
    """Other writers were faster, time and again."""


@dataclass(frozen=True)
class Commit:
    number: int
    rows: DataFrame  # as written, with columns beyond the table's, too


Change = Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame] | None]


class Keyed:
    """A table of rows by key columns (not null). Rows of one key are replaced together."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: StructType | str):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _at(self, number: int) -> str:
        return f"{self.root}/log/{number:020d}.json"

    def _entries(self, number: int | None = None) -> list[dict]:
        """Commits that make up the table at a number (default: the last), from the last whole one on."""
        there = sorted(int(n[:-5]) for n in names(self.spark, f"{self.root}/log") if n.endswith(".json"))
        there = [n for n in there if number is None or n <= number]
        if not there:
            return []
        last = json.loads(read_text(self.spark, self._at(there[-1])))
        return [*(json.loads(read_text(self.spark, self._at(n))) for n in range(last["whole"], there[-1])), last]

    def number(self) -> int:
        """The last commit's number; -1 before the first."""
        entries = self._entries()
        return entries[-1]["number"] if entries else -1

    def _files(self, what: str, entries: list[dict], schema: StructType) -> DataFrame:
        """Rows or keys of commits with the commit's number as __n."""
        number = F.lit(None).cast("long")
        for e in entries:
            number = F.when(F.col("__v") == e["folder"], e["number"]).otherwise(number)
        schema = StructType([*schema, *StructType.fromDDL("__v string")])
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/{what}").parquet(*(f"{self.root}/{what}/__v={e['folder']}" for e in entries))
        return found.withColumn("__n", number).drop("__v")

    def _table(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        key_schema = StructType([self.schema[k] for k in self.keys])
        whole, later = entries[:1], entries[1:]
        if not later:
            return self._files("rows", whole, self.schema).drop("__n")
        # the whole table but for keys of later commits, and of each of those what its last commit says
        # merged, as each round of a table's writers would send these keys through the driver for a broadcast
        last = self._files("keys", later, key_schema).groupBy(*self.keys).agg(F.max("__n").alias("__n")).hint("merge")
        old = self._files("rows", whole, self.schema).drop("__n").join(last.select(*self.keys).hint("merge"), self.keys, "left_anti")
        new = self._files("rows", later, self.schema).join(last, [*self.keys, "__n"]).drop("__n")
        return old.select(*self.schema.names).unionByName(new.select(*self.schema.names))

    def read(self, number: int | None = None) -> DataFrame:
        """The table after a commit (default: the last)."""
        return self._table(self._entries(number))

    def _write(self, made: DataFrame | tuple[DataFrame, DataFrame]) -> str | None:
        """The folder of a change's rows and keys; None if there are no keys."""
        rows, keys = made if isinstance(made, tuple) else (made, None)
        folder = "c" + uuid.uuid4().hex
        rows.sortWithinPartitions(*self.keys).write.parquet(f"{self.root}/rows/__v={folder}")
        if keys is None:  # of the rows as they were written, not as they might be computed again
            keys = self.spark.read.schema(rows.schema).parquet(f"{self.root}/rows/__v={folder}")
        keys.select(*self.keys).distinct().write.parquet(f"{self.root}/keys/__v={folder}")
        if self.spark.read.schema(keys.select(*self.keys).schema).parquet(f"{self.root}/keys/__v={folder}").isEmpty():
            self._drop(folder)
            return None
        return folder

    def _drop(self, folder: str) -> None:
        for what in ("rows", "keys"):
            remove(self.spark, f"{self.root}/{what}/__v={folder}")

    def commit(self, change: Change | DataFrame | tuple[DataFrame, DataFrame], whole: bool = False) -> Commit | None:
        """Applies a change: new rows of some keys, or (rows, keys) where keys may have none; None if there is nothing to do.

        A function is called with the table and called again if another writer was faster; a change
        that doesn't depend on the table can be given as it is and is written once."""
        depends, folder = callable(change), None
        for _ in range(TRIES):
            entries = self._entries()
            number = entries[-1]["number"] + 1 if entries else 0
            if folder is None:
                made = change(self._table(entries)) if depends else change
                folder = None if made is None else self._write(made)
                if folder is None:
                    return None
            first = number if whole or not entries else entries[-1]["whole"]
            if write_once(self.spark, self._at(number), json.dumps({"number": number, "folder": folder, "whole": first})):
                schema = (made[0] if isinstance(made, tuple) else made).schema
                if number - first >= EVERY:
                    self.commit(lambda table: (table, table.select(*self.keys)), whole=True)
                return Commit(number, self.spark.read.schema(schema).parquet(f"{self.root}/rows/__v={folder}"))
            if depends:
                self._drop(folder)
                folder = None
        raise Conflict(f"{self.root}: no commit in {TRIES} tries")

    def sweep(self) -> int:
        """Removes folders that no commit names, such as a crashed writer's; how many. Only while nobody writes."""
        named = {json.loads(read_text(self.spark, f"{self.root}/log/{n}"))["folder"] for n in names(self.spark, f"{self.root}/log") if n.endswith(".json")}
        lost = {n[4:] for what in ("rows", "keys") for n in names(self.spark, f"{self.root}/{what}") if n.startswith("__v=")} - named
        for folder in lost:
            self._drop(folder)
        return len(lost)
