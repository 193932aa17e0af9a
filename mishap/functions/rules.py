"""Predicates and small decisions: guides, host faults, requests, scan rules, peak hours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mishap.functions.text import EDGE

#: Guides to kinds of failure: slug, codes, message (fixed values).
GUIDES = [
    ("connection-failures", r"^(ECONNREFUSED|ECONNRESET|ECONNABORTED|EPIPE|EHOSTUNREACH|ENETUNREACH)$", r"connection (refused|reset|aborted|closed)|socket hang up|broken pipe"),
    ("dns-resolution", r"^(ENOTFOUND|EAI_AGAIN|ESERVFAIL)$", r"getaddrinfo|name resolution|name or service not known|could not resolve host|dns (lookup|resolution|query)"),
    ("ssl-tls-certificates", r"CERT|PKIX|SSL|TLS", r"certificat|\bssl\b|\btls\b|handshake"),
    ("timeouts", r"^(ETIMEDOUT|ESOCKETTIMEDOUT|ERR_SOCKET_CONNECTION_TIMEOUT)$", r"timed? ?out|timeout|deadline exceeded"),
    ("http-status-errors", r"^ERR_BAD_(REQUEST|RESPONSE)$", r"status code \d|http \d{3}|bad gateway|service unavailable|too many requests|gateway timeout|internal server error"),
    ("authentication-failures", None, r"unauthori[sz]ed|forbidden|authenticat|invalid (token|credentials|api ?key)|token (is )?(expired|invalid)|expired token|access denied"),
    ("parsing-and-encoding", None, r"unexpected token|unexpected end of (json|input)|invalid json|parse error|malformed|invalid utf|(failed|unable) to (parse|decode)|invalid character"),
]
#: Families too general for a page of their own; codes are never (fixed values).
GENERIC_FAMILIES = ["error", "errors", "exception", "exceptions", "baseexception", "throwable", "runtimeerror", "runtimeexception", "failure", "failures", "unknown"]
#: Visitors' classes, the first that matches (fixed values).
AGENTS = [
    ("googlebot", "Googlebot"),
    ("google-other", "GoogleOther"),
    ("bingbot", "bingbot"),
    ("ai-bot", "GPTBot|OAI-SearchBot|ChatGPT-User|ClaudeBot|Claude-Web|anthropic|PerplexityBot|Amazonbot|CCBot|Bytespider|meta-externalagent|cohere|Applebot"),
    ("other-bot", "bot|crawler|spider|slurp|crawl"),
]
#: Messages of a sick host, and of a provider that asks for patience (fixed values).
HOST_FAULT = r"Resource temporarily unavailable|unable to create thread|cannot fork|getaddrinfo\(\) thread failed|\bEAGAIN\b|\bENOMEM\b|\bEMFILE\b|\bENFILE\b|\bENOSPC\b|no space left on device|\[spawn\]"
RATE_LIMIT = r"rate.?limit|too many requests|\b429\b"


def spark_regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern for the JVM, with ASCII word boundaries."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", EDGE)


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(text.rlike(spark_regex(pattern, ignore_case)), F.lit(False))


def guides_for(code: Column, message: Column) -> Column:
    """Slugs of the guides whose codes or message patterns match."""
    tests = []
    for slug, codes, words in GUIDES:
        hit = matches(message, words)
        if codes:
            hit = matches(code, codes, ignore_case=False) | hit
        tests.append(F.when(hit, F.lit(slug)))
    return F.array_compact(F.array(*tests))


def is_generic(value: Column) -> Column:
    return F.lower(value).isin(GENERIC_FAMILIES)


def is_host_fault(message: Column) -> Column:
    return matches(message, HOST_FAULT)


def is_rate_limit(message: Column) -> Column:
    return matches(message, RATE_LIMIT)


def agent_class(agent: Column) -> Column:
    start = F.when(F.coalesce(agent, F.lit("")) == "", "unknown")
    return reduce(lambda w, x: w.when(matches(agent, x[1]), x[0]), AGENTS, start).otherwise("human")


def is_record_path(path: Column) -> Column:
    """At least three segments and a closing slash."""
    return path.like("/%/%/%/")


def traffic_point(url: Column, agent: Column, status: Column, cache: Column) -> Column:
    path, host = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit(""))
    return F.struct(F.substring(path, 1, 256).alias("path"), agent_class(agent).alias("agent"), cache.alias("cache"), F.substring(host, 1, 256).alias("host"), status.cast("double").alias("status"), F.substring(path, 1, 96).alias("sampling_key"))


def needs_large_slot(size_mb: Column, files: Column) -> Column:
    return (size_mb > 500) | (files > 3000)


def too_large_to_patch(changed: Column, total: Column) -> Column:
    """A rescan costs less than it saves unless over 20 files and a quarter of all changed."""
    return (total > 0) & (changed > F.greatest(F.lit(20.0), total * 0.25))


def is_peak(at: Column, start: int = 6, end: int = 10) -> Column:
    """Weekdays from start to end o'clock UTC (the session's time zone must be UTC)."""
    return F.dayofweek(at).between(2, 6) & (F.hour(at) >= start) & (F.hour(at) < end)


def ms_to_off_peak(at: Column, start: int = 6, end: int = 10) -> Column:
    at = at.cast("timestamp")
    until = F.date_trunc("day", at) + F.make_dt_interval(hours=F.lit(end))
    return F.when(is_peak(at, start, end), F.unix_millis(until) - F.unix_millis(at)).otherwise(F.lit(0).cast("long"))


def review_target(target: Column) -> Column:
    """struct(repo, slug) of a page's address or owner/name/slug; null unless there are three segments."""
    path = F.when(target.rlike("^https?://"), F.regexp_extract(target, r"^https?://[^/?#]*([^?#]*)", 1)).otherwise(target)
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    good = (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "")
    return F.when(good, F.struct(F.concat_ws("/", parts[0], parts[1]).alias("repo"), parts[2].alias("slug")))


def cache_seconds(status: Column, cache_control: Column, sets_cookie: Column) -> Column:
    cc = F.coalesce(cache_control, F.lit(""))
    shared, own = F.regexp_extract(cc, spark_regex(r"\bs-maxage=(\d+)", False), 1), F.regexp_extract(cc, spark_regex(r"\bmax-age=(\d+)", False), 1)
    age = F.coalesce(F.nullif(shared, F.lit("")), F.nullif(own, F.lit("")), F.lit("0")).cast("long")
    none = (status != 200) | sets_cookie | matches(cc, r"\bno-(store|cache)\b", False)
    return F.when(none, F.lit(0).cast("long")).otherwise(age)


def rescan_due(analyzed_sha: Column, status: Column, errors: Column, analyzed_at: Column, head: Column, now: Column, days: int = 14) -> Column:
    """'dampened' (found nothing lately), 'unchanged' (same head) or 'due'."""
    published = analyzed_sha.isNotNull() & status.isin("analyzed", "exported")
    young = F.unix_millis(now) - F.unix_millis(analyzed_at.cast("timestamp")) < days * 86_400_000
    return F.when(published & (errors == 0) & young, "dampened").when(published & (head == analyzed_sha), "unchanged").otherwise("due")


def discovery_mode(candidates: Column, is_delta: Column, source_files: Column, least: int = 5) -> Column:
    return F.when(candidates > 0, "candidates").when(is_delta, "delta-no-candidates").when(source_files < least, "skipped-low-source").otherwise("agentic")


def claim_kind(fresh: int, rescan: int, share: float) -> str:
    """What the next claim reaches for, given the starts so far and the share of rescans."""
    if share <= 0 or share >= 1:
        return "rescan" if share >= 1 else "fresh"
    return "rescan" if rescan + 1 <= share * (fresh + rescan + 1) else "fresh"
