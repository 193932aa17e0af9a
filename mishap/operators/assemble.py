"""Discovered sites, enrichment and defence joined into validated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishap.functions.text import background_tag, error_id, error_type, message_pattern, record_slug, source_link
from mishap.schema import ERROR, VERSION, validate_errors


def source_region(content: Column, line: Column, around: int = 18, most: int = 40) -> Column:
    """struct(sourceCode, start, end) of the lines around a line, at most `most`; null without a line or content."""
    lines = F.split(content, "\n")
    start = F.greatest(F.lit(1), line - around)
    end = F.least(F.size(lines), line + around)
    long = end - start + 1 > most
    end2 = F.when(long, F.least(start + most - 1, F.size(lines))).otherwise(end)
    start2 = F.when(long & (start + most - 1 > F.size(lines)), F.greatest(F.lit(1), end2 - most + 1)).otherwise(start)
    size = F.greatest(end2 - start2 + 1, F.lit(0))
    good = line.isNotNull() & content.isNotNull()
    return F.when(good, F.struct(F.array_join(F.slice(lines, start2, size), "\n").alias("sourceCode"), start2.alias("start"), end2.alias("end")))


def _repeats(rows: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Rows with __again: another row of the id comes first, or the id is taken."""
    again = F.row_number().over(Window.partitionBy("id").orderBy("ordinal")) > 1
    if taken is None:
        return rows.withColumn("__again", again)
    rows = rows.join(taken.select("id").distinct().withColumn("__t", F.lit(True)), "id", "left")
    return rows.withColumn("__again", again | F.col("__t").isNotNull()).drop("__t")


def first_of_each_id(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Rows with the smallest ordinal of their id, and of ids that aren't taken."""
    return _repeats(rows, taken).where("not __again").select(*rows.columns)


def duplicate_rejects(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(repo, ordinal, message, error) of the rows that first_of_each_id leaves out, one each."""
    error = F.concat(F.lit("duplicate discovery (id "), "id", F.lit(")"))
    return _repeats(rows, taken).where("__again").select("repo", "ordinal", "message", error.alias("error"))


def identified(discovered: DataFrame) -> DataFrame:
    """Discovered sites with filePath, lineNumber, id and slug."""
    d = discovered.withColumn("filePath", F.coalesce("file", F.lit("unknown"))).withColumn("lineNumber", F.when(F.col("line") > 0, F.col("line").cast("int")))
    return d.withColumn("id", error_id(F.col("repo"), F.col("code"), F.col("message"), F.col("filePath"))).withColumn("slug", record_slug(F.col("code"), F.col("message")))


def unique_slugs(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """A slug that an earlier row of the repo or a taken (repo, slug) has gets the id's first six digits."""
    n = F.row_number().over(Window.partitionBy("repo", "slug").orderBy("ordinal"))
    used = n > 1
    if taken is not None:
        rows = rows.join(taken.select("repo", "slug").distinct().withColumn("__t", F.lit(True)), ["repo", "slug"], "left")
        used = used | F.col("__t").isNotNull()
    return rows.withColumn("slug", F.when(used, F.concat("slug", F.lit("-"), F.substring("id", 1, 6))).otherwise(F.col("slug"))).drop("__t")


def assemble(discovered: DataFrame, enriched: DataFrame, defence: DataFrame, files: DataFrame, analyzed_at: str, taken: DataFrame | None = None) -> DataFrame:
    """Records with `issues` and `valid`; duplicates of an id (the first stays) and taken ids are left out:
    duplicate_rejects(identified(discovered)) names them.

    discovered: (repo, sha, ordinal, message, type, file, line, code, errorClass, httpStatus);
    enriched and defence: (repo, ordinal, ...) with what a model said; files: (repo, path, content)."""
    d = unique_slugs(first_of_each_id(identified(discovered), taken), taken)
    d = d.join(enriched, ["repo", "ordinal"], "left").join(defence, ["repo", "ordinal"], "left")
    d = d.join(files.select("repo", F.col("path").alias("filePath"), "content"), ["repo", "filePath"], "left")
    d = d.withColumn("region", source_region(F.col("content"), F.col("lineNumber")))
    none = F.array().cast("array<string>")
    col = lambda c: F.col(c) if c in d.columns else F.lit(None).cast(ERROR[c].dataType)
    where = F.concat(F.col("filePath"), F.coalesce(F.concat(F.lit(":"), F.col("lineNumber").cast("string")), F.lit("")))
    out = {
        "id": F.col("id"), "repo": F.col("repo"), "slug": F.col("slug"), "errorCode": F.col("code"), "errorMessage": F.col("message"), "messagePattern": message_pattern(F.col("message"))["pattern"],
        "errorType": error_type(F.col("type")), "errorClass": col("errorClass"), "httpStatus": col("httpStatus").cast("int"), "severity": F.coalesce(col("severity"), F.lit("error")), "filePath": F.col("filePath"), "lineNumber": F.col("lineNumber"),
        "sourceCode": F.col("region.sourceCode"), "sourceCodeStart": F.col("region.start"), "sourceCodeEnd": F.col("region.end"),
        "githubUrl": source_link(F.col("repo"), F.col("sha"), F.col("filePath"), F.coalesce("region.start", "lineNumber"), F.col("region.end")),
        "documentation": F.coalesce(col("documentation"), F.concat(F.lit('Error "'), F.col("message"), F.lit('" is raised in '), F.col("repo"), F.lit("."))),
        "triggerScenarios": F.coalesce(col("triggerScenarios"), F.concat(F.lit("Raised at "), where, F.lit("."))), "commonSituations": F.coalesce(col("commonSituations"), F.lit("See trigger scenarios.")),
        "solutions": F.coalesce(col("solutions"), none), "exampleFix": col("exampleFix"), "handlingStrategy": col("handlingStrategy"), "validationCode": col("validationCode"), "typeGuard": col("typeGuard"),
        "tryCatchPattern": col("tryCatchPattern"), "preventionTips": F.coalesce(col("preventionTips"), none), "tags": F.transform(F.coalesce(col("tags"), none), F.lower), "backgroundTag": background_tag(col("backgroundTag")),
        "analyzedSha": F.col("sha"), "analyzedAt": F.lit(analyzed_at), "schemaVersion": F.lit(VERSION),
    }
    return validate_errors(d.select(*(v.alias(k) for k, v in out.items())))
