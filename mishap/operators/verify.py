"""Gaps in records, and patches that fill them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mishap.functions.text import json_strings

#: Fields that a patch may set (fixed values).
PATCHABLE = ["documentation", "triggerScenarios", "commonSituations", "solutions", "exampleFix", "sourceCode", "filePath"]


def gaps(records: DataFrame) -> DataFrame:
    """Records that lack documentation, solutions, source or defence, with what they have."""
    has = {
        "hasDoc": F.trim("documentation") != "",
        "hasSolutions": F.size("solutions") > 0,
        "hasSource": F.trim("sourceCode") != "",
        "hasDefense": F.col("handlingStrategy").isNotNull() | (F.size("preventionTips") > 0),
    }
    rows = records.select("id", F.col("errorMessage").alias("message"), F.col("filePath").alias("file"), F.col("lineNumber").alias("line"), *(F.coalesce(v, F.lit(False)).alias(k) for k, v in has.items()))
    return rows.where(~(F.col("hasDoc") & F.col("hasSolutions") & F.col("hasSource") & F.col("hasDefense")))


def apply_patches(records: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched records, one row of applied and rejected).

    patches: (ordinal, id, field, value); the last for a field of a record wins. Unknown ids and
    fields that a patch may not set are rejected. A value of solutions is a JSON list."""
    known = patches.join(records.select("id").distinct().withColumn("__k", F.lit(True)), "id", "left")
    known = known.withColumn("__ok", F.coalesce("__k", F.lit(False)) & F.col("field").isin(PATCHABLE))
    counts = known.agg(F.count_if("__ok").alias("applied"), F.count_if(~F.col("__ok")).alias("rejected"))
    new = known.where("__ok").groupBy("id").pivot("field", PATCHABLE).agg(F.max_by("value", "ordinal"), F.count("id").alias("n"))
    value = {f: f"{f}_max_by(value, ordinal)" for f in PATCHABLE}
    new = new.select("id", *(F.col(f"`{value[f]}`").alias(f"__{f}") for f in PATCHABLE), *(F.col(f"{f}_n").alias(f"__n_{f}") for f in PATCHABLE))
    rows = records.join(new, "id", "left")
    typed = lambda c: json_strings(F.col(f"__{c}")) if c == "solutions" else F.col(f"__{c}")
    out = [F.when(F.col(f"__n_{c}") > 0, typed(c)).otherwise(F.col(c)).alias(c) if c in PATCHABLE else F.col(c) for c in records.columns]
    return rows.select(*out), counts
