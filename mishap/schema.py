"""Records' schemas and validation rules. Rejects are counted and named, never coerced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

VERSION = 2
ERROR_TYPES = ["exception", "error_code", "console", "http", "validation", "panic"]
SEVERITIES = ["critical", "error", "warning", "info"]
STRATEGIES = ["try-catch", "type-guard", "validation", "retry", "fallback"]
REPO_STATUS = ["pending", "analyzing", "analyzed", "failed", "exported"]
PHASES = ["scope", "discovery", "enrichment", "defense", "cross-linking", "verify", "review"]

_SCALARS = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def _parts(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that aren't inside of <>."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == sep and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> DataType:
    if text.startswith("array<"):
        return ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return struct_of(text[7:-1], ":")
    return _SCALARS[text]


def struct_of(fields: str, sep: str = " ") -> StructType:
    """A schema from "name type, ..."; unlike Spark's own it needs no session."""
    out = StructType()
    for f in _parts(fields):
        name, kind = f.split(sep, 1)
        out = out.add(name, _type(kind.strip()))
    return out


ERROR = struct_of(
    "id string, repo string, slug string, errorCode string, errorMessage string, messagePattern string, errorType string, errorClass string, httpStatus int, severity string, "
    "filePath string, lineNumber int, sourceCode string, sourceCodeStart int, sourceCodeEnd int, githubUrl string, documentation string, triggerScenarios string, commonSituations string, "
    "solutions array<string>, exampleFix string, handlingStrategy string, validationCode string, typeGuard string, tryCatchPattern string, preventionTips array<string>, tags array<string>, "
    "backgroundTag string, analyzedSha string, analyzedAt string, schemaVersion int"
)
REPO = struct_of("repo string, description string, language string, stars int, sourceFiles int, defaultBranch string, analyzedSha string, analyzedAt string, errorCount int")
INFO_PAGE = struct_of(
    "slug string, clusterKey string, title string, summary string, background string, commonCauses array<struct<cause:string,detail:string>>, fixes array<string>, guideSlugs array<string>, "
    "errorIds array<string>, errorCount int, repoCount int, generatedAt string, schemaVersion int"
)
JOB = struct_of("id long, repo string, phase string, status string, started_at long, completed_at long, duration_ms long, analyzed_sha string, error_log string, result string")
QUEUE = struct_of("repo string, priority int, status string, attempts int, solo int, last_error string, updated_at long")
BATCH = struct_of("repo string, sha string, phase string, batch_key string, result string, updated_at long")

_SHAPES = {
    "id": ("^[0-9a-f]{16}$", "must be 16 hex digits"),
    "repo": (r"^[^/\s]+/[^/\s]+$", "must be owner/name"),
    "slug": ("^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$", "must be kebab-case"),
    "analyzedSha": ("^[0-9a-f]{40}$", "must be 40 hex digits"),
    "analyzedAt": (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$", "must be a UTC time"),
    "generatedAt": (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$", "must be a UTC time"),
    "githubUrl": (r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$", "must be a URL"),
}
_TAG = "^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$"


def _c(name: str) -> Column:
    return F.col(name)


def _fails(path: str, bad: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{path}: {message}"))


def _filled(*names: str) -> list[Column]:
    return [_fails(n, _c(n).isNull() | (_c(n) == ""), "must be filled") for n in names]


def _not_empty(*names: str) -> list[Column]:
    return [_fails(n, _c(n) == "", "must be null or filled") for n in names]


def _shaped(*names: str) -> list[Column]:
    return [_fails(n, _c(n).isNull() | ~_c(n).rlike(_SHAPES[n][0]), _SHAPES[n][1]) for n in names]


def _one_of(name: str, values: list[str], nullable: bool = False) -> Column:
    bad = ~_c(name).isin(values)
    return _fails(name, bad if nullable else _c(name).isNull() | bad, "must be one of " + ", ".join(values))


def _bounded(name: str, low: int, high: int | None = None, nullable: bool = True) -> Column:
    bad = _c(name) < low if high is None else (_c(name) < low) | (_c(name) > high)
    return _fails(name, bad if nullable else _c(name).isNull() | bad, f"must be at least {low}" if high is None else f"must be from {low} to {high}")


def _items(name: str, bad) -> Column:
    return _fails(name, _c(name).isNull() | F.exists(name, lambda x: F.coalesce(bad(x), F.lit(True))), "has a bad item")


def error_rules() -> list[Column]:
    spans = [
        _fails("sourceCode", F.size(F.split("sourceCode", "\n")) > 40, "must be at most 40 lines"),
        _fails("sourceCodeEnd", _c("sourceCodeEnd") < _c("sourceCodeStart"), "must not be before sourceCodeStart"),
        _fails("lineNumber", _c("lineNumber") < _c("sourceCodeStart"), "must not be before sourceCodeStart"),
    ]
    return [
        *_shaped("id", "repo", "slug"), *_not_empty("errorCode"), *_filled("errorMessage", "messagePattern"), _one_of("errorType", ERROR_TYPES), *_not_empty("errorClass"),
        _bounded("httpStatus", 100, 599), _one_of("severity", SEVERITIES), *_filled("filePath"), _bounded("lineNumber", 1), _bounded("sourceCodeStart", 1), _bounded("sourceCodeEnd", 1), *_shaped("githubUrl"),
        *_filled("documentation", "triggerScenarios", "commonSituations"), _items("solutions", lambda x: x == ""), _one_of("handlingStrategy", STRATEGIES, nullable=True), _items("preventionTips", lambda x: x == ""),
        _items("tags", lambda x: ~x.rlike(_TAG)), _fails("backgroundTag", ~_c("backgroundTag").rlike(_TAG), "must be a kebab-case tag"), *_shaped("analyzedSha", "analyzedAt"),
        _fails("schemaVersion", _c("schemaVersion").isNull() | (_c("schemaVersion") != VERSION), f"must be {VERSION}"), *spans,
    ]


def repo_rules() -> list[Column]:
    return [*_shaped("repo"), _bounded("stars", 0, nullable=False), _bounded("sourceFiles", 0), *_filled("defaultBranch"), *_shaped("analyzedSha", "analyzedAt"), _bounded("errorCount", 0, nullable=False)]


def info_rules() -> list[Column]:
    return [*_shaped("slug"), *_filled("clusterKey", "title", "summary", "background"), _items("fixes", lambda x: x == ""), _bounded("errorCount", 0, nullable=False), _bounded("repoCount", 0, nullable=False), *_shaped("generatedAt")]


def validate(rows: DataFrame, rules: list[Column], schema: StructType) -> DataFrame:
    """Adds `issues`, "path: message" for each rule that a row breaks, and `valid`.

    Columns that the schema lacks make every row invalid, as do missing ones; a missing
    backgroundTag is null."""
    if "backgroundTag" in schema.fieldNames() and "backgroundTag" not in rows.columns:
        rows = rows.withColumn("backgroundTag", F.lit(None).cast("string"))
    odd = [F.lit(f"{c}: unknown key") for c in rows.columns if c not in schema.fieldNames()]
    odd += [F.lit(f"{c}: missing") for c in schema.fieldNames() if c not in rows.columns]
    checks = odd if any(c not in rows.columns for c in schema.fieldNames()) else [*rules, *odd]
    issues = F.array_compact(F.array(*checks))
    return rows.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def validate_errors(rows: DataFrame) -> DataFrame:
    return validate(rows, error_rules(), ERROR)


def validate_repos(rows: DataFrame) -> DataFrame:
    return validate(rows, repo_rules(), REPO)


def validate_info_pages(rows: DataFrame) -> DataFrame:
    return validate(rows, info_rules(), INFO_PAGE)
