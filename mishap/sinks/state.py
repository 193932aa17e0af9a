"""Working state as Parquet tables: merges, patches, and tables of commits for records and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mishap.schema import BATCH
from mishap.sinks.commits import Keyed
from mishap.storage import exists, names

BATCH_KEYS = ["repo", "sha", "phase", "batch_key"]


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changes merged in by key; nulls and missing columns of changes leave values as they are."""
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys))
    rows = table.join(new, keys, "full")
    return rows.select(*(F.coalesce(f"__{c}", c).alias(c) if c not in keys and c in changes.columns else F.col(c) for c in table.columns))


def patch(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with changes to rows that it has; new keys add nothing."""
    known = changes.join(table.select(key), key, "left_semi")
    return upsert(table, known, [key])


def put_batch(table: DataFrame, batch: DataFrame, sha: str | None = None) -> DataFrame:
    """Checkpoints with a batch put in by (repo, sha, phase, batch_key); other commits' rows of its repos go."""
    kept = table
    if sha:
        repos = batch.select("repo").distinct().withColumn("__r", F.lit(True))
        kept = table.join(repos, "repo", "left").where(F.col("__r").isNull() | (F.col("sha") == sha)).select(*table.columns)
    rest = kept.join(batch, BATCH_KEYS, "left_anti").select(*table.columns)
    return rest.unionByName(batch.select(*table.columns))


def clear_batches(table: DataFrame, repo: str) -> DataFrame:
    return table.where(F.col("repo") != repo)


def batches(spark: SparkSession, root: str) -> Keyed:
    """Checkpoints of phases, one row a (repo, sha, phase, batch_key), as a table of commits."""
    return Keyed(spark, root, BATCH_KEYS, BATCH)


def open_batches(table: Keyed, repo: str, sha: str) -> DataFrame:
    """What is done of a repo's commit; those of its other commits go."""
    stale = lambda rows: rows.where((F.col("repo") == repo) & (F.col("sha") != sha)).select(*table.keys)
    table.commit(lambda rows: (rows.limit(0), stale(rows)))
    return lookup(table.read(), repo=repo, sha=sha)


def replace_repo_records(spark: SparkSession, root: str, records: DataFrame, repos: DataFrame | None = None) -> None:
    """Makes records the only ones of their repos, in one commit.

    repos: repos that it is about (default: those of records); those without records have none from
    then on. Readers see the records before or after. Of several writers none undoes another's repos."""
    keys = (records if repos is None else repos.unionByName(records.select("repo"), allowMissingColumns=True)).select("repo")
    _records(spark, root, records.schema).commit((records.repartition("repo"), keys))


def read_records(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame | None:
    """The current records, of one repo or all; None if there never were any."""
    if not exists(spark, f"{root}/records/log"):
        return None
    folder = next(n for n in names(spark, f"{root}/records/rows") if n.startswith("__v="))
    rows = _records(spark, root, spark.read.parquet(f"{root}/records/rows/{folder}").schema).read()
    return rows if repo is None else rows.where(F.col("repo") == repo)


def _records(spark: SparkSession, root: str, schema: StructType) -> Keyed:
    return Keyed(spark, f"{root}/records", ["repo"], schema)


def append_traffic(points: DataFrame, root: str) -> bool:
    """Adds data points by day of `at`, if it can; whether it did. Counting visits must not break what it counts."""
    try:
        points.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(f"{root}/traffic")
    except Exception:  # best effort by definition
        return False
    return True


def lookup(table: DataFrame, **keys: object) -> DataFrame:
    """Rows with these values, such as repo, slug or status; tables that are partitioned by a key are read in its folder only."""
    for name, value in keys.items():
        table = table.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return table
