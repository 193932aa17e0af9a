"""Records kept up to date from line diffs: what stays, what moves, what is looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 3


def _range(start: Column, length: Column) -> tuple[Column, Column]:
    """Lines that a side of a hunk touches; one without lines lies between two neighbours."""
    return start, F.when(length == 0, start + 1).otherwise(start + length - 1)


def touched(hunks: Column, line: Column, side: str = "old", pad: int = PAD) -> Column:
    def near(h: Column) -> Column:
        low, high = _range(h[f"{side}Start"], h[f"{side}Len"])
        return (line >= low - pad) & (line <= high + pad)

    return F.coalesce(F.exists(hunks, near), F.lit(False))


def moved(hunks: Column, line: Column) -> Column:
    """Where an untouched line of the old file is in the new one."""

    def above(h: Column) -> Column:
        return F.when(h["oldLen"] == 0, h["oldStart"] < line).otherwise(h["oldStart"] + h["oldLen"] - 1 < line)

    return line + F.aggregate(F.filter(hunks, above), F.lit(0).cast("long"), lambda acc, h: acc + h["newLen"] - h["oldLen"])


def plan_rescan(records: DataFrame, diff: DataFrame, pad: int = PAD) -> DataFrame:
    """Adds disposition (carryOver, remapped, dropped) and newLine to records (repo, filePath, lineNumber).

    diff: (repo, path, status A/M/D, hunks array<struct<oldStart,oldLen,newStart,newLen>>), of relevant files."""
    d = diff.select("repo", F.col("path").alias("filePath"), F.col("status").alias("__status"), F.col("hunks").alias("__hunks"))
    rows = records.join(d, ["repo", "filePath"], "left")
    line = F.col("lineNumber").cast("long")
    gone = (F.col("__status") == "D") | line.isNull() | touched(F.col("__hunks"), line, "old", pad)
    disposition = F.when(F.col("__status").isNull(), "carryOver").when(gone, "dropped").otherwise("remapped")
    rows = rows.withColumn("disposition", disposition)
    new = F.when(F.col("disposition") == "remapped", moved(F.col("__hunks"), line)).when(F.col("disposition") == "carryOver", line)
    return rows.withColumn("newLine", new).drop("__status", "__hunks")


def in_review(sites: DataFrame, diff: DataFrame, pad: int = PAD) -> DataFrame:
    """Sites (repo, file, line) in added files or within the pad of an edit of a modified one."""
    d = diff.where("status != 'D'").select("repo", F.col("path").alias("file"), "status", "hunks")
    return sites.join(d, ["repo", "file"]).where((F.col("status") == "A") | touched(F.col("hunks"), F.col("line"), "new", pad)).drop("status", "hunks")


def split_by_identity(discovered: DataFrame, published: DataFrame) -> DataFrame:
    """Adds reuse: whether a discovered id is published, so that its record needs no model."""
    return discovered.join(published.select("id").distinct().withColumn("reuse", F.lit(True)), "id", "left").fillna(False, ["reuse"])


def kept_records(plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """Carried-over and moved records together with fresh ones."""
    kept = plan.where("disposition != 'dropped'").withColumn("lineNumber", F.col("newLine").cast("int")).drop("disposition", "newLine")
    return kept.unionByName(fresh, allowMissingColumns=True)


def accounting(plan: DataFrame, discovered: DataFrame) -> DataFrame:
    """(repo, carriedOver, remapped, dropped, reused, fresh) of a plan (repo, disposition) and discovered sites (repo, reuse)."""
    count = lambda d: F.count_if(F.col("disposition") == d)
    kept = plan.groupBy("repo").agg(count("carryOver").alias("carriedOver"), count("remapped").alias("remapped"), count("dropped").alias("dropped"))
    found = discovered.groupBy("repo").agg(F.count_if("reuse").alias("reused"), F.count_if(~F.col("reuse")).alias("fresh"))
    names = ["carriedOver", "remapped", "dropped", "reused", "fresh"]
    return kept.join(found, "repo", "full").fillna(0, names).select("repo", *names)
