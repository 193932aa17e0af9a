"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from mishap.functions import rules, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Cannot open /usr/lib/x.so: 0xdeadbeef", "cannot open"),
        ("Got 42 of 'three' \"four\" items", "got of items"),
        ("É123 a", "a"),
        ("", ""),
        ("ABC_12 x9", "abc x"),
    ],
)
def test_fuzzy_form(spark, raw, want):
    assert one(spark, text.fuzzy_form(F.col("m")), m=raw) == want


def test_number_next_to_an_accented_letter_is_a_number(spark):
    # an ASCII boundary lies between É and 1, so that the number goes before the letters do
    assert one(spark, F.regexp_replace("m", text._L + r"\d+" + text._R, "#"), m="É123 a") == "É# a"


def test_code_tokens(spark):
    assert one(spark, text.code_tokens(F.col("m")), m="connect ECONNREFUSED ERR_X EX a ENOENT ENOENT") == ["ECONNREFUSED", "ERR_X", "ENOENT", "EX"]
    assert one(spark, text.code_tokens(F.lit(None).cast("string")), m="x") == []


def fnv(token):
    h = 0x811C9DC5
    for c in token:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return h % 256


@pytest.mark.parametrize("token", ["a", "connection", "refused", "zzzz", "timeout"])
def test_token_shard(spark, token):
    assert one(spark, text.token_shard(F.col("t")), t=token) == fnv(token)


def test_ids_and_slugs(spark):
    import hashlib

    want = hashlib.sha256("o/n\x01E1\x01f.py".encode()).hexdigest()[:16]
    assert one(spark, text.error_id(F.lit("o/n"), F.col("c"), F.lit("msg"), F.lit("f.py")), c="E1") == want
    want = hashlib.sha256("o/n\x01msg\x01f.py".encode()).hexdigest()[:16]
    assert one(spark, text.error_id(F.lit("o/n"), F.lit(None).cast("string"), F.col("m"), F.lit("f.py")), m="msg") == want
    assert one(spark, text.record_slug(F.lit(None).cast("string"), F.col("m")), m="Cannot read: 'x'!") == "cannot-read-x"
    assert one(spark, text.record_slug(F.lit(None).cast("string"), F.col("m")), m="!!!") == "error"
    long = "a" * 49 + "-bcd"
    assert one(spark, text.record_slug(F.col("m"), F.lit("")), m=long) == "a" * 49
    assert one(spark, text.cluster_slug(F.col("m")), m="-" * 5 + "b" * 70) == "b" * 60


@pytest.mark.parametrize("raw,want", [("Panic", "panic"), ("error-code", "error_code"), ("odd", "exception"), ("http", "http")])
def test_error_type(spark, raw, want):
    assert one(spark, text.error_type(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [("Connection Refused", "connection-refused"), ("Errors", None), ("9x", None), ("", None)])
def test_background_tag(spark, raw, want):
    assert one(spark, text.background_tag(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    "message,pattern,source",
    [
        ("Cannot open ${path} now", r"Cannot open (.+?) now", "derived"),
        ("failed %s with %d", r"failed (.+?) with (.+?)", "derived"),
        ("value %(name)s is bad", r"value (.+?) is bad", "derived"),
        ("index {0} of {}", r"index (.+?) of (.+?)", "derived"),
        ("a.b*c is wrong", r"a\.b\*c is wrong", "derived"),
        ("{x} ok", r"\{x\} ok", "literal"),
        ("", "", "literal"),
        ("100%%s done now", r"100%(.+?) done now", "derived"),
        ("x" * 501, "x" * 501, "literal"),
    ],
)
def test_message_pattern(spark, message, pattern, source):
    got = one(spark, text.message_pattern(F.col("m")), m=message)
    assert (got.pattern, got.source) == (pattern, source)


def test_flagged_literals(spark):
    got = one(spark, text.message_pattern(F.col("m"), F.array(F.lit("localhost:80"), F.lit("x"))), m="cannot reach localhost:80 x")
    assert got.pattern == "cannot reach (.+?) x"


def test_linear_patterns(spark):
    bad = [r"(a+)+", r"(x)\1", "y" * 501]
    assert [one(spark, text.is_linear(F.col("p")), p=p) for p in [*bad, r"a(.+?)b"]] == [False, False, False, True]


def test_links(spark):
    link = lambda a, b: one(spark, text.source_link(F.lit("o/n"), F.lit("s"), F.lit("f"), F.lit(a).cast("int"), F.lit(b).cast("int")), x="")
    assert link(3, 9).endswith("/o/n/blob/s/f#L3-L9")
    assert link(3, 3).endswith("f#L3")
    assert link(None, None).endswith("/f")


def test_small_texts(spark):
    assert one(spark, text.escape_xml(F.col("t")), t='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, text.rfc822(F.col("t")), t="2026-07-14") == "Tue, 14 Jul 2026 00:00:00 GMT"
    assert one(spark, text.json_strings(F.col("t")), t='["a","b"]') == ["a", "b"]
    assert one(spark, text.json_strings(F.col("t")), t="no") == []
    assert one(spark, text.paragraphs(F.col("t")), t="a\nb\n\n c\n\n\n") == ["a\nb", "c"]


@pytest.mark.parametrize(
    "agent,want",
    [("Googlebot/2.1", "googlebot"), ("GoogleOther", "google-other"), ("bingbot", "bingbot"), ("x GPTBot y", "ai-bot"), ("some crawler", "other-bot"), ("Mozilla/5.0", "human"), ("", "unknown")],
)
def test_agents(spark, agent, want):
    assert one(spark, rules.agent_class(F.col("a")), a=agent) == want


def test_guides(spark):
    assert one(spark, rules.guides_for(F.lit("ETIMEDOUT"), F.col("m")), m="broken pipe") == ["connection-failures", "timeouts"]
    assert one(spark, rules.guides_for(F.lit(None).cast("string"), F.col("m")), m="SSL éssl failed") == ["ssl-tls-certificates"]
    assert one(spark, rules.guides_for(F.lit(None).cast("string"), F.col("m")), m="nothing") == []


def test_messages_of_hosts_and_providers(spark):
    assert one(spark, rules.is_host_fault(F.col("m")), m="fork: Resource temporarily unavailable")
    assert not one(spark, rules.is_host_fault(F.col("m")), m="EAGAINST")
    assert one(spark, rules.is_rate_limit(F.col("m")), m="HTTP 429")
    assert not one(spark, rules.is_rate_limit(F.lit(None).cast("string")), m="")


@pytest.mark.parametrize("target,want", [("https://x.org/o/n/s/", ("o/n", "s")), ("o/n/s", ("o/n", "s")), ("o/n", None), ("o//s", None), ("https://x.org/a/b/c/d", None)])
def test_review_target(spark, target, want):
    got = one(spark, rules.review_target(F.col("t")), t=target)
    assert (got and (got.repo, got.slug)) == want


def test_cache_seconds(spark):
    age = lambda cc, status=200, cookie=False: one(spark, rules.cache_seconds(F.lit(status), F.col("c"), F.lit(cookie)), c=cc)
    assert [age("max-age=60, s-maxage=300"), age("public, max-age=60"), age("no-store, max-age=9"), age("", 200), age("max-age=5", 404), age("max-age=5", 200, True)] == [300, 60, 0, 0, 0, 0]


def test_peak(spark):
    at = lambda t: one(spark, F.struct(rules.is_peak(F.col("t").cast("timestamp")), rules.ms_to_off_peak(F.col("t").cast("timestamp"))), t=t)
    assert tuple(at("2026-07-14 09:59:59")) == (True, 1000)
    assert tuple(at("2026-07-14 10:00:00")) == (False, 0)
    assert tuple(at("2026-07-12 07:00:00")) == (False, 0)


def test_rules_of_scans(spark):
    assert [rules.claim_kind(3, 0, 0.25), rules.claim_kind(2, 0, 0.25), rules.claim_kind(0, 0, 0), rules.claim_kind(0, 0, 1)] == ["rescan", "fresh", "fresh", "rescan"]
    large = lambda a, b: one(spark, rules.too_large_to_patch(F.lit(a), F.lit(b)), x="")
    assert [large(20, 10), large(21, 10), large(26, 100), large(25, 100), large(30, 0)] == [False, True, True, False, False]
    mode = lambda *a: one(spark, rules.discovery_mode(*map(F.lit, a)), x="")
    assert [mode(1, True, 9), mode(0, True, 9), mode(0, False, 4), mode(0, False, 5)] == ["candidates", "delta-no-candidates", "skipped-low-source", "agentic"]


def test_fixed_tables_against_values_written_out(spark):
    """What the queries' SQL borrows from the engine's tables is right in itself."""
    from mishap.operators.extract import is_source

    seen = ["src/a.py", "lib/x.mjs", "a/b.kt", "x.hxx", "my_tests/a.go", "contest/a.go", "src/test_a.py", "outer/a.rb", "distance/a.c", "latest.ts"]
    skipped = [f"{d}/a.py" for d in ("node_modules", "vendor", "dist", "build", "out", "target", "third_party", "testdata", "__tests__", "__mocks__", "fixtures", "mocks", "docs", "examples", "example", "benchmark", "benchmarks", "samples", "sample", "demo", "demos", "playground", "notebooks", "tutorials", "test", "tests", "spec", ".git", ".github", ".hid")]
    skipped += ["a.test.js", "a.spec.ts", "a_test.go", "a_test.py", "a_test.rb", "a_test.c", "a_test.cc", "a_test.cpp", "test_a.py", "ATest.java", "ATest.kt", "ATest.cs", ".a.py", "src/node_modules/x/a.js", "a.txt", "README", "a.pyc"]
    rows = spark.createDataFrame([(p,) for p in seen + skipped], "path string").select("path", F.coalesce(is_source(F.col("path")), F.lit(False)).alias("s")).collect()
    assert {r.path for r in rows if r.s} == set(seen)
    assert [g[0] for g in rules.GUIDES] == ["connection-failures", "dns-resolution", "ssl-tls-certificates", "timeouts", "http-status-errors", "authentication-failures", "parsing-and-encoding"] and [a[0] for a in rules.AGENTS] == ["googlebot", "google-other", "bingbot", "ai-bot", "other-bot"]
