"""A training corpus from the documents table, in five stages.

Each stage takes what its predecessor kept and hands on rows with the columns of documents, extra
ones too; the last returns the mix. Stages write nothing of their own but scratch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm import decontaminate, minhash, mixing, substrings, toxicity
from mishap.llm.shared import Tables, table


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and the whole row, so that no column of docs clashes with those of an operator."""
    return docs.select("doc_id", "text", "source", F.struct("*").alias("__row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer doesn't reject (predicted 0)."""
    scored = toxicity.score(_packed(docs), table(spark, sf_dir, "labels"), keep=["__row"])
    return scored.where("predicted = 0").select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, null ids last.

    Every row is a node by a number of its own, so that rows with null or repeated ids are copies, too;
    of those with one id the hash of the text and then the number decide. The numbers are written
    first, as they must not change between reads."""
    rows = Tables(spark, "near_copies").keep(docs.withColumn("__at", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows.select(F.col("__at").alias("doc_id"), "text")).select(F.col("doc_id").alias("__at"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text").alias("hash"), "__at")
    first = found.join(rows.select("__at", order.alias("__order")), "__at").groupBy("component_id").agg(F.min("__order").alias("first"))
    return rows.join(first.select(F.col("first.__at").alias("__at")), "__at", "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes covered by repeated strings; n_chars follows, if there. Null texts stay null."""
    found = substrings.dedup_substrings(_packed(docs), keep=["__row"], as_text=True)
    text = F.when(F.col("__row.text").isNotNull(), F.col("kept"))
    out = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*(out.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    found = decontaminate.contamination(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["__row"])
    return found.where("not contaminated").select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, whole, with size, source_size, target and taken (words, repeats counted).

    Columns of docs with these names give way to them."""
    mixed = mixing.mix(_packed(docs), keep=["__row"]).where("taken > 0")
    return mixed.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in _MIXED), *_MIXED)


#: What mixing adds.
_MIXED = ["size", "source_size", "target", "taken"]

STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the learned scorer of the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return docs
