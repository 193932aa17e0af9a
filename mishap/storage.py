"""Files in whatever file system a folder's address names, from the driver and from tasks."""

from __future__ import annotations

import atexit
import codecs
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, a: str, b: str) -> None:
    fs, p = _hadoop(spark, a)
    if not fs.rename(p, _hadoop(spark, b)[1]):
        raise OSError(f"can't rename {a} to {b}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    return spark.read.text(path, wholetext=True).first()[0]


def _beside(spark: SparkSession, path: str, text: str) -> str:
    """A small file written whole under a name of its own in the folder of path."""
    at = f"{path}.{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, at)
    if fs.getScheme() == "file":  # without a check sum beside it, which would not follow a rename
        os.makedirs(os.path.dirname(_plain(at)), exist_ok=True)
        with open(_plain(at), "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        return at
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()
    return at


def _is_local(spark: SparkSession, path: str) -> bool:
    return _hadoop(spark, path)[0].getScheme() == "file"


def _plain(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _renamed(spark: SparkSession, a: str, b: str, option: str) -> None:
    """A rename as the file system's own single step; option: NONE fails if b is there, OVERWRITE replaces it."""
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), option)
    source, target = _hadoop(spark, a)[1], _hadoop(spark, b)[1]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: under another name first, which then takes its place in one step. Readers see the old or the new one."""
    at = _beside(spark, path, text)
    if _is_local(spark, path):
        os.replace(_plain(at), _plain(path))
    else:
        _renamed(spark, at, path, "OVERWRITE")


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole if none is there; whether it did. Of several writers one succeeds."""
    at = _beside(spark, path, text)
    try:
        if _is_local(spark, path):
            os.link(_plain(at), _plain(path))  # fails if the name is taken, unlike a rename
        else:
            _renamed(spark, at, path, "NONE")
            return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        if exists(spark, at):
            remove(spark, at)
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def open_root(uri: str):
    """(pyarrow file system, path) of a folder, for Python in tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def read_texts(paths: DataFrame, root: str, keep: str | None = None) -> DataFrame:
    """(path, value) of the files of a column of paths below a root, each read whole by a task; those that aren't there have no row.

    keep: a column that goes with the path, of which there is one row then. Paths are dealt out to a fixed number of tasks, by a
    hash, as the exchange of a distinct would do for one by path: they are so few bytes that all files would be read in one."""
    from mishap.workers import reach

    reach(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with files.open_input_file(f"{base}/{path}") as f:
                        text = f.read().decode()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.large_string()).cast(pa.string()), *(c.slice(i, 1) for c in batch.columns[1:])], names=["path", "value", *([keep] if keep else [])])

    there = paths.select("path", *([keep] if keep else [])).where("path is not null")
    there = (there if keep else there.distinct()).repartition(dealt(paths.sparkSession), F.xxhash64("path"))
    return there.mapInArrow(run, "path string, value string" + (f", {keep} {paths.schema[keep].dataType.simpleString()}" if keep else ""))


#: Bytes of a file of items that are read at once.
PART = 1 << 20


def items(read: Callable[[int], bytes]) -> Iterator[str]:
    """The texts of a JSON list's objects one after the other, with no more of them in memory than one and a part."""
    decode, scan = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder().raw_decode
    text, at, step, more = "", 0, PART, True
    while True:
        while at < len(text) and text[at] in " \t\r\n,[":
            at += 1
        try:
            if at < len(text) and text[at] == "{":
                end = scan(text, at)[1]
                yield text[at:end]
                at, step = end, PART
                continue
            if at < len(text):  # the list's end
                return
        except json.JSONDecodeError:
            if not more:
                raise
        part = read(step)
        more, step = bool(part), step * 2  # a long object isn't begun anew for each part
        if not more and at >= len(text):
            return
        text, at = text[at:] + decode.decode(part, not more), 0


def read_items(paths: DataFrame, root: str) -> DataFrame:
    """(path, value) of the objects of the files of paths below a root, which are JSON lists; as read_texts, but never a whole file at once."""
    from mishap.workers import reach

    reach(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            if files.get_file_info(f"{base}/{path}").type.name == "NotFound":
                continue
            with files.open_input_stream(f"{base}/{path}", compression=None) as f:
                found, size = [], 0
                for x in items(f.read):
                    found.append(x)
                    size += len(x)
                    if size > PART:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(found)], names=["path", "value"])
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(found)], names=["path", "value"])

    there = paths.select("path").where("path is not null").distinct().repartition(dealt(paths.sparkSession), F.xxhash64("path"))
    return there.mapInArrow(run, "path string, value string")


def dealt(spark: SparkSession) -> int:
    """Tasks to deal out names of files to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the one that all executors share; what is written there goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mishap-")
        spark.sparkContext.setCheckpointDir(base)
    at = f"{base.rstrip('/')}/mishap-{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, at)
        except Exception:  # the JVM may be gone at exit; then the folder's owner cleans up
            pass

    atexit.register(clean)
    return at
