"""Intervals: windows of lines merged into islands, and the innermost interval around a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_windows(windows: DataFrame, by: list[str], start: str = "start", size: str = "size") -> DataFrame:
    """Islands (by..., island, first, end) of windows [start, start + size); those that touch are one."""
    end = F.col(start) + F.col(size)
    order = Window.partitionBy(*by).orderBy(start, size)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    rows = windows.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island").agg(F.min(start).alias("first"), F.max(end).alias("end"))


def merge_contexts(sites: DataFrame) -> DataFrame:
    """(file, island, start, lines) of sites' context windows; a line that windows share comes once.

    Windows that touch have no line between them missing: a sweep over a file's lines in order starts
    an island where a number is skipped and carries its start on, without joining lines and windows."""
    c = sites.where("context is not null").select("file", F.col("context.start").alias("start"), F.col("context.lines").alias("lines"))
    lines = c.select("file", F.posexplode("lines").alias("at", "text"), "start").select("file", (F.col("start") + F.col("at")).alias("no"), "text")
    lines = lines.groupBy("file", "no").agg(F.min("text").alias("text"))
    order = Window.partitionBy("file").orderBy("no")
    fresh = F.coalesce(F.col("no") > F.lag("no").over(order) + 1, F.lit(True))
    swept = lines.withColumn("fresh", fresh).withColumn("start", F.last(F.when(F.col("fresh"), F.col("no")), ignorenulls=True).over(order)).withColumn("island", F.sum(F.col("fresh").cast("int")).over(order))
    return swept.groupBy("file", "island", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]).alias("lines"))


def innermost(sites: DataFrame, symbols: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """Each site with the smallest symbol [first, last] around it, or none. Ties go to the earlier first line, then the name.

    A symbol of up to 2^level lines lies in at most two cells of that size, and a site looks into one
    cell of each level that its file has: they meet by an equi join on cells, not by all pairs of a file."""
    size = F.col("last") - F.col("first") + 1
    s = symbols.where("last >= first").withColumn("__level", F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))))
    levels = s.groupBy(*by).agg(F.collect_set("__level").alias("__levels"))
    cell = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), __level)")
    s = s.select(*by, "first", "last", "name", "__level", F.explode(F.array_distinct(F.array(cell("first"), cell("last")))).alias("__cell"))
    probes = sites.select(*by, line).distinct().join(levels, by).select(*by, line, F.explode("__levels").alias("__level")).withColumn("__cell", cell(line))
    near = probes.join(s, [*by, "__level", "__cell"]).where(F.col(line).between(F.col("first"), F.col("last")))
    best = near.groupBy(*by, line).agg(F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "first", "last", "name")).alias("__s"))
    return sites.join(best, [*by, line], "left").select(*sites.columns, F.col("__s.first").alias("first"), F.col("__s.last").alias("last"), F.col("__s.name").alias("name"))


def reached_by(refs: DataFrame, symbols: DataFrame, most_refs: int = 12, most: int = 6) -> DataFrame:
    """(value, names): functions around the first references (value, ordinal, file, line) of an error value."""
    few = refs.withColumn("__n", F.row_number().over(Window.partitionBy("value").orderBy("ordinal"))).where(F.col("__n") <= most_refs).drop("__n")
    found = innermost(few, symbols, ["file"]).where("name is not null")
    first = found.groupBy("value", "name").agg(F.min("ordinal").alias("ordinal"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"])
    return first.groupBy("value").agg(F.slice(names, 1, most).alias("names"))
