"""What the training-data operators share: session settings, tables in the shared folder, word patterns."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.workers import reach

#: Words as mixing, near-duplicates and language models count them: runs without ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset one machine gets a folder of its own (tests), a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="mishap-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded in rows and bytes, so that very long texts don't fill a Python worker."""
    reach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables of one operator call, written as Parquet in the shared folder.

    A written table cuts the lineage and outlives any executor. drop() and only() remove those that
    nothing reads any more; what the result reads goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names, self.swept = spark, set(), 0.0
        self.root = f"{shared_dir(spark)}/mishap/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        if time.monotonic() - self.swept > 2:  # now and then: lets Spark's cleaner drop the shuffle files of steps that are over
            self.spark.sparkContext._jvm.System.gc()
            self.swept = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, self.path(name))
        self.names -= set(names)

    def only(self, *names: str) -> None:
        """Removes all tables but those that the result reads."""
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the JVM may be gone at exit; then the folder's owner cleans up
            pass


def local_root(uri: str):
    """(pyarrow file system, path) for a folder that Python on the executors reads and writes."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def parts_of(uri: str) -> list[str]:
    """The Parquet files of a written table, in a fixed order; for Python on the executors."""
    from pyarrow import fs

    files, base = local_root(uri)
    found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string (or binary) column; nulls stay None."""
    import pyarrow as pa

    if pa.types.is_binary(column.type):
        return column.to_pylist()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def held_out(doc_id) -> F.Column:
    """True for rows whose labels are never learned from: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))
