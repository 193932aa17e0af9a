"""Sites in source text that raise or report errors, by language family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishap.functions.rules import spark_regex
from mishap.operators.rescan import touched

#: Directories that are never looked at (fixed values).
SKIPPED_DIRS = [
    ".git", "node_modules", "vendor", "dist", "build", "out", "target",
    "third_party", "testdata", "__tests__", "__mocks__", "fixtures", "mocks",
    ".github", "docs", "examples", "example", "benchmark", "benchmarks",
    "samples", "sample", "demo", "demos", "playground", "notebooks", "tutorials",
]
#: Test folders and files, and literals (fixed values).
TEST_DIR = r"^tests?$|^spec$"
TEST_FILE = r"(\.test\.|\.spec\.|_test\.(go|py|rb|c|cc|cpp)$|^test_|Test\.(java|kt|cs)$)"
#: Idioms of each family in the order that decides the kind (fixed values).
IDIOMS = {
    "js": [
        ("throw", r"\bthrow\s+new\s+[A-Z][A-Za-z0-9_.]*\s*\("),
        ("throw", r"\bthrow\s+new\s+Error\s*\("),
        ("error_code", r"""\bcode:\s*['"][A-Z][A-Z0-9_]{3,}['"]"""),
        ("http", r"\b(?:status|sendStatus|writeHead)\s*\(\s*[45]\d\d\b"),
    ],
    "py": [
        ("throw", r"\braise\s+[A-Z][A-Za-z0-9_.]*"),
        ("http", r"\babort\s*\(\s*[45]\d\d\b"),
    ],
    "go": [
        ("error_new", r"\berrors\.New\s*\("),
        ("error_new", r"\bfmt\.Errorf\s*\("),
        ("error_new", r"\berrors\.(?:Errorf|Wrapf?)\s*\("),
        ("panic", r"\bpanic\s*\("),
        ("http", r"\bhttp\.Error\s*\("),
    ],
    "rs": [
        ("panic", r"\b(?:panic|unreachable|todo|unimplemented)!\s*\("),
        ("error_new", r"\b(?:bail|anyhow|ensure)!\s*\("),
        ("error_attr", r"#\[error\s*\("),
        ("error_new", r"\bError::new\s*\("),
        ("panic", r"""\.expect\s*\(\s*\""""),
    ],
    "jvm": [
        ("throw", r"\bthrow\s+new\s+[A-Z][A-Za-z0-9_.]*(?:Exception|Error)\s*\("),
        ("throw", r"\bthrow\s+[A-Z][A-Za-z0-9_.]*(?:Exception|Error)\s*\("),
    ],
    "cs": [("throw", r"\bthrow\s+new\s+[A-Z][A-Za-z0-9_.]*(?:Exception|Error)\s*\(")],
    "rb": [
        ("throw", r"\braise\s+[A-Z][A-Za-z0-9_:]*(?:\.new)?"),
        ("throw", r"""\braise\s+["']"""),
    ],
    "php": [("throw", r"\bthrow\s+new\s+[A-Z\\][A-Za-z0-9_\\]*\s*\(")],
    "c": [
        ("error_print", r"\b(?:errx?|warnx?)\s*\("),
        ("error_print", r"\bfprintf\s*\(\s*stderr\b"),
        ("error_print", r"""\bperror\s*\(\s*\""""),
        ("throw", r"\bthrow\s+(?:std::)?[A-Za-z_][A-Za-z0-9_:]*\s*\("),
        ("error_log", r"\b\w*log_error\s*\("),
        ("error_log", r"\b\w*LOG_ERROR\s*\("),
        ("error_log", r"\belog\s*\(\s*(?:ERROR|FATAL|PANIC)\b"),
        ("error_log", r"\bg_(?:error|critical|warning)\s*\("),
    ],
}
#: What every line that holds an idiom of a family contains: lines without any of these meet no pattern.
NEEDED = {
    "js": ["throw", "code:", "tatus", "writeHead"],
    "py": ["raise", "abort"],
    "go": ["errors.", "fmt.Errorf", "panic", "http.Error"],
    "rs": ["panic!", "unreachable!", "todo!", "unimplemented!", "bail!", "anyhow!", "ensure!", "#[error", "Error::new", ".expect"],
    "jvm": ["throw"],
    "cs": ["throw"],
    "rb": ["raise"],
    "php": ["throw"],
    "c": ["err", "warn", "throw", "LOG_ERROR", "elog", "g_critical"],
}
#: Extensions of each family (fixed values).
EXTENSIONS = {
    "js": ["js", "jsx", "ts", "tsx", "mjs", "cjs"],
    "py": ["py"],
    "go": ["go"],
    "rs": ["rs"],
    "jvm": ["java", "kt", "scala"],
    "cs": ["cs"],
    "rb": ["rb"],
    "php": ["php"],
    "c": ["c", "cc", "cpp", "cxx", "h", "hpp", "hh", "hxx"],
}
LITERAL = r"""["'`]((?:[^"'`\\]|\\.){4,200})["'`]"""
#: The name that an assignment at a line's start declares, and kinds of symbols (fixed values).
DECLARED = r"^\s*(?:(?:export|public|static|final|var|const|let|val)\s+)*([A-Za-z_$][A-Za-z0-9_$]*)\s*(?::=|=)[^=]"
ENCLOSING_KINDS = ["function", "method", "class", "struct"]
DECLARATION_KINDS = ["variable", "constant", "field"]


def declared_name(line: Column) -> Column:
    """struct(name, exported) of an assignment; exported names begin with a capital. Null for other lines."""
    name = F.nullif(F.regexp_extract(line, DECLARED, 1), F.lit(""))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), name.rlike("^[A-Z]").alias("exported")))


def family(path: Column) -> Column:
    """The family of a path's extension, null for others."""
    ext = F.regexp_extract(path, r"[^/]\.([A-Za-z]+)$", 1)
    pairs = [(e, f) for f, es in EXTENSIONS.items() for e in es]
    return reduce(lambda w, p: w.when(ext == p[0], p[1]), pairs[1:], F.when(ext == pairs[0][0], pairs[0][1]))


def is_skipped_dir(name: Column) -> Column:
    return name.isin(SKIPPED_DIRS) | name.rlike(TEST_DIR)


def is_excluded(path: Column) -> Column:
    """In a skipped or hidden directory, hidden itself, or a test file. Paths are relative: a name that
    begins with test_ counts at the root only."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(dirs, is_skipped_dir) | F.exists(parts, lambda p: p.startswith(".")) | path.rlike(TEST_FILE)


def is_source(path: Column) -> Column:
    """Of a known family and not excluded."""
    return family(path).isNotNull() & ~is_excluded(path)


def under(path: Column, roots: Column) -> Column:
    return F.exists(roots, lambda r: (path == r) | F.startswith(path, F.concat(r, F.lit("/"))))


def out_of_scope(path: Column, include: Column, exclude: Column) -> Column:
    return ((F.size(include) > 0) & ~under(path, include)) | under(path, exclude)


def scope_tally(files: DataFrame, include: Column, exclude: Column) -> DataFrame:
    """(top, n): source files that the scope alone drops, by top directory."""
    dropped = files.where(is_source(F.col("path")) & out_of_scope(F.col("path"), include, exclude))
    return dropped.groupBy(F.split("path", "/")[0].alias("top")).agg(F.count("*").alias("n"))


def line_kind(fam: Column, line: Column) -> Column:
    """The kind of the first idiom of the line's family that it holds."""

    def first(f: str) -> Column:
        kinds = reduce(lambda w, kp: w.when(line.rlike(spark_regex(kp[1], False)), kp[0]), IDIOMS[f][1:], F.when(line.rlike(spark_regex(IDIOMS[f][0][1], False)), IDIOMS[f][0][0]))
        return F.when(reduce(Column.__or__, (F.contains(line, F.lit(x)) for x in NEEDED[f])), kinds)

    f0, *rest = IDIOMS
    return reduce(lambda w, f: w.when(fam == f, first(f)), rest, F.when(fam == f0, first(f0)))


def _once(value: Column) -> Column:
    """A value as a column of its own: what is computed from it then reads it, where a projection would compute it anew at each use."""
    return F.explode_outer(F.array(value))


def _context(lines: Column, at: Column, around: int, line_max: int, total: int) -> Column:
    """struct(start, lines): lines around, each clipped, whole ones up to a total; null if all are blank."""
    first = F.greatest(F.lit(0), at - around)
    window = F.slice(lines, first + 1, at + around + 1 - first)
    # how many lines there is room for, from their lengths alone; the first is always shown
    size = lambda x: F.least(F.length(x), F.lit(line_max)) + 1
    more = lambda acc, x: F.when(acc["open"] & ((acc["n"] == 0) | (size(x) <= acc["left"])), F.struct((acc["n"] + 1).alias("n"), (acc["left"] - size(x)).alias("left"), F.lit(True).alias("open"))).otherwise(F.struct(acc["n"].alias("n"), acc["left"].alias("left"), F.lit(False).alias("open")))
    shown = F.aggregate(window, F.struct(F.lit(0).alias("n"), F.lit(total).alias("left"), F.lit(True).alias("open")), more, lambda acc: acc["n"])
    kept = F.transform(F.slice(lines, first + 1, shown), lambda x: F.substring(x, 1, line_max))
    return F.when(F.exists(kept, lambda x: F.trim(x) != ""), F.struct((first + 1).alias("start"), kept.alias("lines")))


def extract_sites(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = 400_000, max_line: int = 500, per_file: int = 500, around: int = 8, only: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(path, line, kind, snippet, literal, context) of files (path, content), extra key columns kept.

    A line gives one site, of the first idiom that it holds; a file at most `per_file`, its first.
    Paths decide before contents are looked at. `only` limits it to a diff (`by`..., path, status,
    hunks): files that the diff adds or modifies, and of the latter the lines near an edit."""
    keys = [c for c in files.columns if c != "content"]
    scope = [F.array(*map(F.lit, x or [])).cast("array<string>") for x in (include, exclude)]
    rows = files.withColumn("__f", family(F.col("path"))).where(F.col("__f").isNotNull() & ~is_excluded(F.col("path")) & ~out_of_scope(F.col("path"), *scope))
    looked = lambda i: F.lit(True)
    if only is not None:
        d = only.where("status != 'D'").select(*(by or []), "path", F.col("status").alias("__status"), F.col("hunks").alias("__hunks"))
        rows = rows.join(d, [*(by or []), "path"])
        looked = lambda i: (F.col("__status") == "A") | touched(F.col("__hunks"), (i + 1).cast("long"), "new")
    rows = rows.withColumn("content", _once(F.col("content"))).where(F.octet_length("content") <= max_bytes).withColumn("__lines", _once(F.split("content", "\n"))).drop("content")
    line = lambda x, i: F.when((F.length(x) <= max_line) & looked(i), line_kind(F.col("__f"), x))
    hits = F.filter(F.transform("__lines", lambda x, i: F.struct(i.alias("at"), line(x, i).alias("kind"))), lambda h: h["kind"].isNotNull())
    pick = lambda x: F.nullif(F.regexp_extract(x, LITERAL, 1), F.lit(""))

    def site(h: Column) -> Column:
        text, after = F.get("__lines", h["at"]), F.get("__lines", h["at"] + 1)
        literal = F.substring(F.coalesce(pick(text), pick(after)), 1, 200)
        return F.struct((h["at"] + 1).alias("line"), h["kind"].alias("kind"), F.substring(F.trim(text), 1, 300).alias("snippet"), literal.alias("literal"), _context(F.col("__lines"), h["at"], around, 200, 1200).alias("context"))

    # lines, hits and sites are each made once a file, inside its row: no line becomes a row, and none is repeated a site
    rows = rows.withColumn("__hits", _once(F.slice(hits, 1, per_file))).where(F.size("__hits") > 0)
    rows = rows.select(*keys, _once(F.transform("__hits", site)).alias("__sites"))
    return rows.select(*keys, F.explode("__sites").alias("s")).select(*keys, "s.*")


#: What a grep with context answers: a payload for each family of patterns.
GREP = "results array<struct<path:string,line:int,context:struct<lines:array<string>,matched_lines:array<int>,start_line:int>>>"


def grep_sites(payloads: DataFrame, root: str = "", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, line, kind, snippet, literal, context) of payloads (kind, ordinal, json) of a grep over a tree.

    Paths below `root` become relative; others outside of the tree, excluded and out of scope ones don't
    count. Of several families that meet a line the one with the least ordinal has it. A result's
    own line is found by its number, as windows of neighbours overlap."""
    scope = [F.array(*map(F.lit, x or [])).cast("array<string>") for x in (include, exclude)]
    rows = payloads.select("kind", "ordinal", F.explode(F.from_json("json", GREP)["results"]).alias("r")).select("kind", "ordinal", "r.*")
    base = root.rstrip("/") + "/"
    inside = F.when(F.startswith("path", F.lit(base)), F.substr("path", F.lit(len(base) + 1))).when(~F.startswith("path", F.lit("/")) & ~F.startswith("path", F.lit("..")), F.col("path"))
    rows = rows.withColumn("path", inside).where(F.col("path").isNotNull() & (F.col("line") > 0) & ~is_excluded(F.col("path")) & ~out_of_scope(F.col("path"), *scope))
    rows = first_family_wins(rows.withColumnRenamed("path", "file")).withColumnRenamed("file", "path")
    lines = F.coalesce(F.col("context.lines"), F.array().cast("array<string>"))
    at = F.coalesce(F.col("line") - F.col("context.start_line"), F.get(F.col("context.matched_lines"), F.lit(0)), F.lit(0))
    text = F.coalesce(F.get(lines, at), F.lit(""))
    literal = F.substring(F.nullif(F.regexp_extract(text, LITERAL, 1), F.lit("")), 1, 200)
    clipped = _context(lines, F.lit(0), 1 << 20, 200, 1200)
    context = F.when(clipped.isNotNull(), F.struct(F.coalesce(F.col("context.start_line"), F.col("line")).alias("start"), clipped["lines"].alias("lines")))
    return rows.select("path", "line", "kind", F.substring(F.trim(text), 1, 300).alias("snippet"), literal.alias("literal"), context.alias("context"))


def sites_or_else(files: DataFrame, payloads: DataFrame | None, why: str = "no grep", say=print, **scope) -> tuple[DataFrame, str]:
    """(sites, backend): those of a grep if there is one, else of the built-in scan, whose reason is said."""
    if payloads is not None:
        return grep_sites(payloads, **scope), "grep"
    say(f"grep extraction failed ({why}), using the built-in scan")
    return extract_sites(files, **scope), "builtin"


def scope_log(tally: DataFrame) -> DataFrame:
    """(line): what a scope left out, a line a top directory."""
    return tally.select(F.concat(F.lit("scope: excluded "), F.col("n").cast("string"), F.lit(" candidate location(s) under "), "top", F.lit("/")).alias("line"))


def first_family_wins(hits: DataFrame) -> DataFrame:
    """Hits (file, line, ordinal of the family, ...) with one row for a line, the first family's."""
    order = Window.partitionBy("file", "line").orderBy("ordinal")
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def count_sources(files: DataFrame) -> DataFrame:
    return files.where(is_source(F.col("path"))).agg(F.count("*").alias("n"))


def tree_counts(files: DataFrame, depth: int = 3, most_dirs: int = 400, cap: int = 5000) -> DataFrame:
    """(path, depth, sourceFiles, capped): source files below each directory, the first ones in pre-order."""
    rows = files.where(is_source(F.col("path"))).select(F.split("path", "/").alias("p"))
    levels = F.sequence(F.lit(1), F.least(F.lit(depth), F.size("p") - 1))
    rows = rows.where("size(p) > 1").select(F.explode(levels).alias("depth"), "p").select("depth", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"))
    counts = rows.groupBy("path", "depth").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.split("path", "/")).limit(most_dirs)
    return first.select("path", "depth", F.least("n", F.lit(cap)).alias("sourceFiles"), (F.col("n") > cap).alias("capped"))


def render_tree(counts: DataFrame, suspect: int = 3000) -> DataFrame:
    n = F.concat(F.col("sourceFiles").cast("string"), F.when(F.col("capped"), "+").otherwise(""))
    mark = F.when(F.col("sourceFiles") >= suspect, " [SUSPECT: unusually large, vendored or generated code?]").otherwise("")
    return counts.select("path", F.concat(F.expr("repeat('  ', depth - 1)"), "path", F.lit("/ ("), n, F.lit(" source files)"), mark).alias("line"))


SCOPE = "includeRoots array<string>, excludeDirs array<string>"


def check_scopes(answers: DataFrame, trees: DataFrame) -> DataFrame:
    """Scope answers (repo, json) of many repos against the directories they were shown (repo, path):
    (repo, includeRoots, excludeDirs, error).

    Paths lose a leading ./ and closing slashes. A path that is empty, absolute, climbs, is null or isn't in the
    repo's tree makes the answer an error, which names the first of its bad ones in order as field:path, and has no
    paths then; an answer that isn't such JSON is the error 'json'. Missing lists are empty. Repos must not repeat."""
    parsed = F.from_json("json", SCOPE + ", odd string", {"columnNameOfCorruptRecord": "odd"})
    rows = answers.select("repo", parsed.alias("s"), F.coalesce(F.try_parse_json("json").cast("string").rlike("^[{]"), F.lit(False)).alias("whole"))
    rows = rows.select("repo", (F.col("whole") & F.col("s.odd").isNull()).alias("whole"), *(F.coalesce(f"s.{f}", F.array().cast("array<string>")).alias(f) for f in ("includeRoots", "excludeDirs")))
    said = lambda f: F.transform(f, lambda p, i: F.struct(F.lit(f).alias("field"), i.alias("at"), p.alias("said")))
    named = F.concat(said("includeRoots"), said("excludeDirs"))
    paths = rows.where("whole").select("repo", F.explode(named).alias("p")).select("repo", "p.*", F.regexp_replace(F.regexp_replace("p.said", "/+$", ""), r"^\./", "").alias("path"))
    known = trees.select("repo", "path", F.lit(True).alias("known")).distinct()
    odd = F.coalesce((F.col("path") == "") | F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), ".."), F.lit(True))
    paths = paths.join(known, ["repo", "path"], "left").withColumn("bad", F.when(odd | F.col("known").isNull(), F.concat_ws(":", "field", F.coalesce("said", F.lit("null")))))
    listed = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("at", "path")))), lambda x: x["path"]).alias(f)
    found = paths.groupBy("repo").agg(F.min("bad").alias("bad"), listed("includeRoots"), listed("excludeDirs"))
    joined = rows.select("repo", "whole").join(found, "repo", "left").withColumn("error", F.when(~F.col("whole"), "json").otherwise(F.col("bad")))
    return joined.select("repo", *(F.when(F.col("error").isNull(), F.coalesce(f, F.array().cast("array<string>"))).alias(f) for f in ("includeRoots", "excludeDirs")), "error")


def check_scope(paths: list[str], tree: DataFrame) -> list[str]:
    """Cleaned paths of a scope answer; a path that is malformed or not in the tree is an error."""
    clean = [p.rstrip("/").removeprefix("./") for p in paths]
    bad = [p for p in clean if not p or p.startswith("/") or ".." in p.split("/")]
    known = {r.path for r in tree.where(F.col("path").isin(clean)).select("path").collect()} if clean else set()
    bad += [p for p in clean if p not in known and p not in bad]
    if bad:
        raise ValueError(f"scope: not directories of the tree: {bad}")
    return clean
