"""Messages as columns: code tokens, fuzzy normal form, ids, slugs and search patterns.

Word boundaries are spelled as ASCII look-arounds, since \\b of the JVM knows accented letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary, from either side.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_META = r"[.*+?^${}()|\[\]\\]"
GROUP = "(.+?)"
MARK = "\x01"  # joins the parts of an id, and stands for a placeholder
TOKEN_SHARDS, META_CHUNK, WEIGHT_SCALE, THRESHOLD = 256, 2000, 100, 0.4
#: Family tags that say nothing (fixed values).
EMPTY_TAGS = ["error", "errors", "exception", "exceptions", "failure", "failures", "unknown"]


def code_tokens(text: Column) -> Column:
    """Upper-case tokens that may be error codes, in order of first appearance by form; null text gives none."""
    found = [F.regexp_extract_all(text, F.lit(_L + p + _R), F.lit(0)) for p in ("[A-Z][A-Z0-9_]{2,}", "E[A-Z]+")]
    return F.coalesce(F.array_distinct(F.concat(*found)), F.array().cast("array<string>"))


#: Paths, hex, quoted strings and runs without a-z. Found in one pass from the left, as none but quoted strings hold quotes and a
#: run ends before what may begin one of the others. Numbers hold no a-z, so they need no pattern of their own.
_NO_WORD = r"""/[\w./-]+|0x[0-9a-f]+|'[^']*'|"[^"]*"|[^a-z/0'"]+|[/0'"]"""


def fuzzy_form(text: Column) -> Column:
    """Lower case without paths, hex, numbers and quoted strings; only a-z and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _NO_WORD, " "), " +", " "))


def fuzzy_tokens(text: Column) -> Column:
    """Distinct words of the fuzzy form; null text gives none."""
    words = F.split(F.regexp_replace(F.lower(text), _NO_WORD, " "), " ")
    return F.coalesce(F.array_remove(F.array_distinct(words), ""), F.array().cast("array<string>"))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def token_shard(token: Column) -> Column:
    """32-bit FNV-1a over the characters' codes, mod 256."""
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long")), lambda c: c > 0)
    step = lambda h, c: ((h.bitwiseXOR(c)) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return (F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), step) % TOKEN_SHARDS).cast("int")


def id_shard(id_: Column) -> Column:
    return (F.conv(F.substring(id_, 1, 2), 16, 10).cast("int") % TOKEN_SHARDS).cast("int")


def shard_name(shard: Column) -> Column:
    return F.lower(F.lpad(F.hex(shard.cast("long")), 2, "0"))


def error_id(repo: Column, code: Column, message: Column, path: Column) -> Column:
    """16 hex digits of what identifies a record: repo, code or else message, and path."""
    return F.substring(F.sha2(F.concat(repo, F.lit(MARK), F.coalesce(code, message), F.lit(MARK), path), 256), 1, 16)


def kebab(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _or_else(text: Column, other: str) -> Column:
    return F.when(text == "", F.lit(other)).otherwise(text)


def record_slug(code: Column, message: Column) -> Column:
    """The first 50 characters, then kebab."""
    return _or_else(kebab(F.substring(F.coalesce(code, message), 1, 50)), "error")


def cluster_slug(value: Column) -> Column:
    """Kebab, then the first 60 characters."""
    return _or_else(F.regexp_replace(F.substring(kebab(value), 1, 60), "-+$", ""), "cluster")


def error_type(raw: Column) -> Column:
    t = F.lower(F.coalesce(raw, F.lit("")))
    same = t.isin("panic", "http", "validation", "console")
    return F.when(same, t).when(t.isin("error_code", "error-code", "code"), "error_code").otherwise("exception")


def background_tag(raw: Column) -> Column:
    """A kebab tag, or null if it has none or says nothing. Kebab has single inner hyphens only, so a tag is right if a letter begins it."""
    tag = kebab(raw)
    return F.when(tag.rlike("^[a-z]") & ~tag.isin(EMPTY_TAGS), tag)


def escape_pattern(text: Column) -> Column:
    return F.regexp_replace(text, f"({_META})", r"\\$1")


def mark_placeholders(message: Column, literals: Column | None = None) -> Column:
    """${x}, %(x)s, %s and {x}, in this order, then flagged literals of over one character, become MARK."""
    out = message
    for pattern in (r"\$\{[^}]*\}", r"%\([^)]*\)[sdifge]", "%[sdifjv]", r"\{[^}]*\}"):
        out = F.regexp_replace(out, pattern, MARK)
    if literals is not None:
        useful = F.filter(F.coalesce(literals, F.array().cast("array<string>")), lambda x: F.length(x) > 1)
        out = F.aggregate(useful, out, lambda acc, x: F.replace(acc, x, F.lit(MARK)))
    return out


def literal_weight(pattern: Column) -> Column:
    """Characters of a pattern that stand for themselves."""
    return F.length(F.trim(F.regexp_replace(F.replace(pattern, F.lit(GROUP), F.lit("")), r"\\(.)", "$1")))


def is_linear(pattern: Column) -> Column:
    """At most 500 characters, no back reference, no quantified group with a quantifier inside."""
    return (F.length(pattern) <= 500) & ~pattern.rlike(r"\\[1-9]") & ~pattern.rlike(r"\([^()]*[+*?][^()]*\)[+*?{]")


def message_pattern(message: Column, literals: Column | None = None) -> Column:
    """struct(pattern, source): 'derived' with groups for placeholders, else the escaped 'literal'.

    Escaped literals with groups always compile, so only weight and linearity decide."""
    empty = F.coalesce(message, F.lit("")) == ""

    def chosen(derived: Column) -> Column:
        good = (literal_weight(derived) >= 6) & is_linear(derived)
        pattern = F.when(empty, F.lit("")).when(good, derived).otherwise(escape_pattern(message))
        return F.struct(pattern.alias("pattern"), F.when(~empty & good, "derived").otherwise("literal").alias("source"))

    # the derived pattern is made once and then read by each of its uses
    derived = F.replace(escape_pattern(mark_placeholders(message, literals)), F.lit(MARK), F.lit(GROUP))
    return F.get(F.transform(F.array(derived), chosen), F.lit(0))


def source_link(repo: Column, sha: Column, path: Column, start: Column, end: Column, host: str = "https://github.com") -> Column:
    """Permalink with #L3-L9, #L3 or no anchor."""
    base = F.concat(F.lit(host + "/"), repo, F.lit("/blob/"), sha, F.lit("/"), path)
    span = F.concat(base, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    return F.when(start.isNotNull() & end.isNotNull() & (end != start), span).when(start.isNotNull(), F.concat(base, F.lit("#L"), start.cast("string"))).otherwise(base)


def record_url(repo: Column, slug: Column, site: str = "https://example.org") -> Column:
    return F.concat(F.lit(site + "/"), repo, F.lit("/"), slug, F.lit("/"))


def repo_parts(repo: Column) -> Column:
    """struct(owner, name) of owner/name."""
    parts = F.split(repo, "/")
    return F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name"))


def repo_card(repo: Column) -> Column:
    """The picture of a project (fixed form)."""
    p = repo_parts(repo)
    return F.concat(F.lit("/og/repo-"), p["owner"], F.lit("-"), p["name"], F.lit(".png"))


def post_card(slug: Column) -> Column:
    return F.concat(F.lit("/og/blog-"), slug, F.lit(".png"))


def page_path(folder: str, slug: Column) -> Column:
    """/folder/slug/, for guides, blog and info pages."""
    return F.concat(F.lit(f"/{folder}/"), slug, F.lit("/"))


def page_title(code: Column, message: Column, repo: Column, site: str) -> Column:
    lead = F.when(F.coalesce(code, F.lit("")) != "", F.concat(code, F.lit(": "), message)).otherwise(message)
    return F.concat(lead, F.lit(" — "), repo, F.lit(f" | {site}"))


def page_description(documentation: Column) -> Column:
    return F.substring(documentation, 1, 155)


def page_data(site: str = "https://example.org", name: str = "Errors") -> Column:
    """A record (columns as in schema.ERROR) as linked data: the trail to it, the article, its question and answer."""
    repo_url = F.concat(F.lit(site + "/"), "repo", F.lit("/"))
    url = record_url(F.col("repo"), F.col("slug"), site)
    crumb = lambda n, label, at: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), label.alias("name"), at.alias("item"))
    lead = lambda n: F.coalesce("errorCode", F.substring("errorMessage", 1, n))
    trail = F.array(crumb(1, F.lit(name), F.lit(site + "/")), crumb(2, F.col("repo"), repo_url), crumb(3, lead(60), url))
    words = F.array_join(F.concat("tags", F.array_compact(F.array("backgroundTag"))), ", ")
    answer = F.struct(F.lit("Answer").alias("@type"), F.coalesce(F.get("solutions", F.lit(0)), F.col("documentation")).alias("text"))
    asked = F.concat(F.lit('What causes "'), "errorMessage", F.lit('" in '), "repo", F.lit("?"))
    question = F.struct(F.lit("Question").alias("@type"), asked.alias("name"), answer.alias("acceptedAnswer"))
    article = {"@type": F.lit("TechArticle"), "headline": lead(80), "description": F.col("documentation"), "about": F.concat("repo", F.lit(" — "), "errorMessage"), "url": url, "proficiencyLevel": F.lit("Expert"), "keywords": words}
    parts = [
        F.struct(F.lit("BreadcrumbList").alias("@type"), trail.alias("itemListElement")),
        F.struct(*(v.alias(k) for k, v in article.items())),
        F.struct(F.lit("FAQPage").alias("@type"), F.array(question).alias("mainEntity")),
    ]
    return F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.concat_ws(",", *map(F.to_json, parts)), F.lit("]}"))


def escape_xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rfc822(day: Column) -> Column:
    return F.date_format(F.to_timestamp(day), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def json_strings(text: Column) -> Column:
    """A JSON list of strings; anything else is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def content_key(*parts: Column) -> Column:
    """sha1 of the parts, nulls as empty, for batches keyed by content."""
    return F.sha1(F.concat_ws(MARK, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
