"""The model's tables as views of the driver's tables, so that every operator has rows to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.functions.text import code_tokens, error_id, message_pattern, record_slug
from mishap.operators.index import dense_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _first_code(text) -> F.Column:
    return F.get(code_tokens(text), F.lit(0))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: (idx, doc_id, id, repo, slug, code, msg, cls, tag, tags). They are numbered first: what is made of a text is made once, and only where a query reads it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("repo"), F.col("text").alias("msg"), F.col("source").alias("cls"), F.col("lang").alias("tag"), "n_chars")
    d = dense_index(d, "doc_id").withColumn("code", _first_code(F.col("msg")))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return d.withColumn("id", error_id(F.col("repo"), F.col("code"), F.col("msg"), path)).withColumn("slug", record_slug(F.col("code"), F.col("msg")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as working records with the names of families."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat_ws("/", "lang", "source").alias("repo"),
        _first_code(F.col("text")).alias("errorCode"),
        F.col("source").alias("errorClass"),
        F.col("lang").alias("backgroundTag"),
        F.col("text").alias("errorMessage"),
        F.col("text").alias("documentation"),
        F.lit("").alias("triggerScenarios"),
        F.lit("[]").alias("solutions"),
        F.lit("[]").alias("preventionTips"),
    )


def _sentences(text) -> F.Column:
    return F.transform(F.split(text, r"[.\n]"), lambda x: F.trim(x))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of documents as records, in the order of first appearance; numbered first, as entries()."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.concat_ws("/", "lang", "source").alias("repo"), F.posexplode(_sentences(F.col("text"))).alias("pos", "msg")).where("msg != ''")
    first = rows.groupBy("msg").agg(F.min(F.struct((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("ord"), "repo")).alias("f"))
    rows = dense_index(first.select(F.col("f.ord").alias("ord"), F.col("f.repo").alias("repo"), "msg"), "ord")
    rows = rows.withColumn("code", _first_code(F.col("msg"))).withColumn("id", error_id(F.col("repo"), F.lit(None).cast("string"), F.col("msg"), F.lit("doc")))
    return rows.withColumn("slug", record_slug(F.lit(None).cast("string"), F.col("msg"))).withColumn("pattern", message_pattern(F.col("msg"))["pattern"])


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of benchmark items as search texts (qid, text), each followed by its first word in capitals, if it is of a-z: a code of some records."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(_sentences(F.col("text"))).alias("pos", "text")).where("text != ''")
    return b.select((F.col("item_id") * 1_000_000 + F.col("pos")).alias("qid"), F.concat_ws(" ", "text", F.when(F.col("text").rlike("^[A-Za-z]+ "), F.upper(F.split("text", " ")[0]))).alias("text"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of phase runs; a third of them failed."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("repo"),
        F.col("event_type").alias("phase"),
        F.when(F.col("event_id") % 3 == 0, "failed").otherwise("success").alias("status"),
        F.unix_millis(F.date_trunc("hour", "ts")).alias("started_at"),
        (F.col("event_id") % 1000).alias("duration_ms"),
    )


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as requests for the page of that number."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), F.concat(F.lit("/"), F.parse_url("url", F.lit("HOST")), F.parse_url("url", F.lit("PATH")), F.lit("/")).alias("path"))
    e = table(spark, sf_dir, "events").join(p, "user_id")
    return e.select("path", F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "bot").otherwise("")).alias("ua"), (F.col("event_id") % 7 + 1).alias("weight"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as records on lines of files."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit("r").alias("repo"), F.col("l_orderkey").cast("string").alias("filePath"), (F.col("l_linenumber") * 10).cast("int").alias("lineNumber"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hunk for each returned line; every seventh order is deleted."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    start, q = (F.col("l_linenumber") * 10 + 2).cast("long"), F.col("l_quantity").cast("long")
    hunk = F.struct(start.alias("oldStart"), (q % 3).alias("oldLen"), start.alias("newStart"), (q % 5).alias("newLen"))
    rows = li.groupBy("l_orderkey").agg(F.collect_list(hunk).alias("hunks"))
    return rows.select(F.lit("r").alias("repo"), F.col("l_orderkey").cast("string").alias("path"), F.when(F.col("l_orderkey") % 7 == 0, "D").otherwise("M").alias("status"), "hunks")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a work queue."""
    c = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "done", "failed", "skipped"])), (c % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        c.cast("string").alias("repo"), F.col("c_nationkey").cast("int").alias("priority"), status.alias("status"), (c % 4).cast("int").alias("attempts"), (c % 3).cast("int").alias("solo"),
        F.when(status == "failed", "cannot fork").alias("last_error"), (c * 3_600_000 % 172_800_000).cast("long").alias("updated_at"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders as published projects."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("d"))
    return o.select(F.col("o_custkey").cast("string").alias("repo"), F.when(F.col("n") > 5, F.sha1(F.col("o_custkey").cast("string"))).alias("analyzed_sha"), F.col("n").alias("error_count"), F.col("d").alias("analyzed_at"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as paths of source files."""
    path = F.concat(F.parse_url("url", F.lit("HOST")), F.parse_url("url", F.lit("PATH")), F.lit(".py"))
    return table(spark, sf_dir, "pages").select(path.alias("path")).where("path is not null")


#: A line of each language family that raises what it says: extension, before, after.
RAISING = [
    ("py", '    raise ValueError("', '")'),
    ("ts", '  throw new Error("', '")'),
    ("go", '    return fmt.Errorf("', '", x)'),
    ("rs", '    panic!("', '");'),
    ("java", '    throw new IllegalStateException("', '");'),
    ("cs", '    throw new ArgumentException("', '");'),
    ("rb", '  raise "', '"'),
    ("php", '    throw new \\Oops("', '");'),
    ("c", '    perror("', '");'),
]


def source_path() -> F.Column:
    ext = F.element_at(F.array(*(F.lit(x) for x, _, _ in RAISING)), (F.col("doc_id") % len(RAISING) + 1).cast("int"))
    return F.concat(F.lit("src/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files of nine families whose lines raise what they say."""
    of = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in RAISING)), (F.col("doc_id") % len(RAISING) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", of(1).alias("pre"), of(2).alias("post"))
    lines = F.regexp_replace("text", "[^A-Za-z \n]+", "")
    body = F.concat("pre", F.replace(lines, F.lit("\n"), F.concat("post", F.lit("\n"), "pre")), "post")
    return docs.select(source_path().alias("path"), body.alias("content"))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in the wrappings that models use."""
    t = F.to_json(F.struct(F.col("text").alias("said")))
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), t, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here it is "), t, F.lit(" done"))).otherwise(F.to_json(F.struct(t.alias("result"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", wrapped.alias("raw"))
