"""Source trees, corpus lists and published files as DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mishap.operators.extract import is_source


def read_tree(spark: SparkSession, root: str, max_bytes: int = 400_000) -> DataFrame:
    """(path, content) of a tree's source files in any file system; path and size decide before contents are read.

    Paths are relative to the root: only folders below it can exclude a file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.where(F.col("length") <= max_bytes).withColumn("path", F.substr("path", F.lit(len(base) + 2)))
    rows = rows.where(is_source(F.col("path")))
    return rows.select("path", F.col("content").cast("string").alias("content"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(repo): one owner/name a line, without comments and blanks."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("repo")).where("repo != ''").distinct()


def new_candidates(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Found repos (repo, fork) that are no forks and not in the corpus."""
    return found.where("not fork").join(corpus.select("repo"), "repo", "left_anti")


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines or arrays (gzip by ending); a path that isn't there has none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


@dataclass
class Provider:
    """How a model is asked; fields of a command are for programs, others for all."""

    command: str = ""
    args: list[str] = field(default_factory=list)
    timeout_ms: int = 600_000
    prompt_mode: str = "stdin"  # or arg
    type: str = "spawn"  # or acp
    model: str | None = None


@dataclass
class Config:
    """Settings of a run; unknown names in a file are errors."""

    min_errors: int = 5
    min_repos: int = 2
    candidate_batch: int = 40
    analysis_batch: int = 20
    verify_batch: int = 200
    failed_cooloff_hours: int = 24
    zero_yield_days: int = 14
    rescan_share: float = 0.25
    phases: list[str] = field(default_factory=lambda: ["scope", "discovery", "enrichment", "defense", "verify"])
    providers: dict[str, Provider] = field(default_factory=dict)
    phase_providers: dict[str, str] = field(default_factory=dict)
    primary: str = ""
    fallback: str | None = None
    max_concurrent: int = 1
    batch_concurrency: int = 1
    provider_max_concurrent: int = 0  # 0: no gate
    source_window: int = 12
    max_runtime_minutes: int = 240  # 0: no end
    call_facts: bool = False
    skip_peak: bool = False
    delay_between_phases_ms: int = 5_000

    def __post_init__(self):
        """Counts are whole and at least 1 (a gate at least 0), the share lies from 0 to 1, providers get their types."""
        for name in ("max_concurrent", "batch_concurrency", "analysis_batch", "source_window"):
            setattr(self, name, max(1, int(getattr(self, name))))
        self.provider_max_concurrent = max(0, int(self.provider_max_concurrent))
        self.rescan_share = min(1.0, max(0.0, float(self.rescan_share)))
        self.providers = {k: v if isinstance(v, Provider) else Provider(**{"command": k, **v}) for k, v in self.providers.items()}
        if odd := set(self.phase_providers) - {"scope", "discovery", "enrichment", "defense", "verify", "review"}:
            raise ValueError(f"unknown phases: {sorted(odd)}")

    def provider_of(self, phase: str) -> str:
        return self.phase_providers.get(phase, self.primary)


def load_config(path: str | None = None) -> Config:
    """Defaults, or a JSON file laid over them; a path that is given must be there."""
    if path is None:
        return Config()
    given = json.loads(Path(path).read_text())
    if odd := set(given) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return Config(**given)
