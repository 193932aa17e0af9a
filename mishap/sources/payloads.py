"""Diffs, model output and metadata: texts that become rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishap.workers import reach

_HEADER = r"^diff --git a/.* b/.*$"
_PATH = r"^diff --git a/(.*) b/(.*)$"
_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """(repo, path, status, hunks) of unified diffs (repo, text) without context and renames.

    Each text is taken apart within its row: its files are the sections that its headers begin, so
    diffs of one repo can't mix and nothing is shuffled. Of lines that name /dev/null the last decides."""
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    heads = F.transform(F.filter(numbered, lambda x: x["line"].rlike(_HEADER)), lambda x: x["at"])
    rows = diffs.select("repo", lines.alias("__lines"), heads.alias("__heads"))
    end = lambda i: F.coalesce(F.get("__heads", i + 1), F.size("__lines"))
    rows = rows.select("repo", F.explode(F.transform("__heads", lambda h, i: F.slice("__lines", h + 1, end(i) - h))).alias("section"))
    part = lambda x, i: F.regexp_extract(x, _HUNK, i)
    length = lambda x, i: F.when(part(x, i) == "", F.lit(1)).otherwise(part(x, i).cast("long")).cast("long")
    hunk = lambda x: F.struct(part(x, 1).cast("long").alias("oldStart"), length(x, 2).alias("oldLen"), part(x, 3).cast("long").alias("newStart"), length(x, 4).alias("newLen"))
    states = F.transform("section", lambda x: F.when(F.startswith(x, F.lit("--- /dev/null")), "A").when(F.startswith(x, F.lit("+++ /dev/null")), "D"))
    status = F.coalesce(F.element_at(F.array_compact(F.concat(F.array(F.lit("M")), states)), -1), F.lit("M"))
    hunks = F.transform(F.filter("section", lambda x: x.rlike(_HUNK)), hunk)
    return rows.select("repo", F.regexp_extract(F.col("section")[0], _PATH, 2).alias("path"), status.alias("status"), hunks.alias("hunks"))


_WRAPPERS = ("result", "content", "text", "message")
_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.I)
_STRICT = json.JSONDecoder(parse_constant=lambda name: _refuse(name))


def _refuse(name: str):
    raise ValueError(name)


def _candidates(text: str):
    """Values that may be the JSON, the likeliest first: what is fenced, all, and what ends at the text's last
    bracket of a kind. Such a value can only begin at the bracket that closes it going backwards, so it is decoded once."""
    fenced = _FENCE.search(text)
    if fenced and fenced[1].strip():
        yield from _parsed(fenced[1].strip())
    yield from _parsed(text)
    ends = [end for end in (text.rfind("}") + 1, text.rfind("]") + 1) if end]
    for start, end in sorted((_opening(text[:end]), end) for end in ends):
        if start >= 0:
            yield from _parsed(text[start:end])


#: Strings and brackets of a reversed text; a quote before an odd number of backslashes belongs to its string.
_BACKWARDS = re.compile(r'"(?:[^"]|"(?=\\(?:\\\\)*+(?!\\)))*+(?:"|\Z)|[\[\]{}]')


def _opening(text: str) -> int:
    """Where the bracket is that a text's last character closes; -1 if there is none."""
    depth = 0
    for m in _BACKWARDS.finditer(text[::-1]):
        depth += {"}": 1, "]": 1, "{": -1, "[": -1}.get(m[0], 0)
        if depth == 0:
            return len(text) - m.end()
    return -1


def _parsed(text: str) -> list:
    """The value of a JSON text, as a list of one; none if it isn't one or is nested too deeply."""
    try:
        value, end = _STRICT.raw_decode(text)
        return [value] if end == len(text) else []
    except (ValueError, RecursionError):
        return []


def _inner(value):
    """A value that wraps another JSON text, at most five deep, without its wrappers."""
    for _ in range(5):
        texts = [value.get(k) for k in _WRAPPERS] if isinstance(value, dict) else []
        found = [v for t in texts if isinstance(t, str) and t.strip()[:1] in ("{", "[") for v in _parsed(t.strip())]
        if not found:
            break
        value = found[0]
    return value


def find_json(raw: str | None) -> tuple[str | None, str | None]:
    """(the first JSON in a text, as JSON; why there is none)."""
    text = (raw or "").strip()
    if not text:
        return None, "empty"
    value = next(_candidates(text), _refuse)
    return (None, "parse") if value is _refuse else (json.dumps(_inner(value)), None)


def extract_json(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Adds json and error ('empty', 'parse' or null). Nested scans aren't SQL: an Arrow batch at a time."""

    reach(rows.sparkSession)

    @F.pandas_udf("json string, error string")
    def found(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find_json(x) for x in raw], columns=["json", "error"])

    return rows.withColumn("__x", found(F.col(column))).select("*", "__x.json", "__x.error").drop("__x")


def repo_meta(body: Column) -> Column:
    """struct(description, language, stars, defaultBranch) with defaults where a field has another type."""
    v = F.try_parse_json(body)
    text = lambda f: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.try_variant_get(v, f"$.{f}", "string"))
    kind = F.schema_of_variant(F.try_variant_get(v, "$.stargazers_count", "variant"))
    stars = F.when(kind.rlike("BIGINT|DECIMAL|DOUBLE|INT"), F.try_variant_get(v, "$.stargazers_count", "long"))
    out = F.struct(text("description").alias("description"), text("language").alias("language"), F.coalesce(stars, F.lit(0)).alias("stars"), F.coalesce(text("default_branch"), F.lit("main")).alias("defaultBranch"))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), out)


def discovered_errors(json_text: Column) -> Column:
    """The errors of a discovery answer whose message is a string."""
    kind = "errors array<struct<message:string,type:string,file:string,line:int,code:string,errorClass:string,httpStatus:int>>"
    found = F.from_json(json_text, kind)["errors"]
    return F.coalesce(F.filter(found, lambda e: e["message"].isNotNull()), F.array().cast(kind.removeprefix("errors ")))


def by_number(json_text: Column, part: str, fields: str) -> Column:
    """The items of an answer's list `part` whose errorIndex is a number: array of (errorIndex, fields...)."""
    kind = f"array<struct<errorIndex:double,{fields}>>"
    found = F.from_json(json_text, f"{part} {kind}")[part]
    return F.coalesce(F.filter(found, lambda e: e["errorIndex"].isNotNull()), F.array().cast(kind))
