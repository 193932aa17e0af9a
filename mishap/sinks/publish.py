"""A published data set: validated records, index files and a manifest with a tree of check sums; versions behind a pointer."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishap.functions.text import META_CHUNK, THRESHOLD, TOKEN_SHARDS, WEIGHT_SCALE, shard_name, token_shard
from mishap.operators import index as ix
from mishap.operators.reports import dataset_counts
from mishap.schema import ERROR, INFO_PAGE, REPO, VERSION, struct_of, validate_errors, validate_info_pages, validate_repos
from mishap.sources.files import read_json
from mishap.storage import exists, names, open_root, read_text, read_texts, remove, scratch, write_text
from mishap.workers import reach

ENTRY = struct_of("idx long, id string, repo string, slug string, code string, msg string, pattern string, type string, cls string, tags array<string>, sev string")


def analyzed(repos: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repos with a published analysis, and their records."""
    done = repos.where("status = 'analyzed' and analyzedSha is not null").select(*REPO.fieldNames())
    return done, records.join(done.select("repo"), "repo", "left_semi").select(*ERROR.fieldNames())


def with_defaults(rows: DataFrame) -> DataFrame:
    """Working rows as records: null texts that must be filled become '' and null lists empty."""
    texts, lists = ["documentation", "triggerScenarios", "commonSituations", "messagePattern"], ["solutions", "preventionTips", "tags"]
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) if c in texts else F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in lists else F.col(c) for c in rows.columns))


def compact(records: DataFrame) -> DataFrame:
    """Records as search entries (without idx)."""
    names = {"id": "id", "repo": "repo", "slug": "slug", "errorCode": "code", "errorMessage": "msg", "messagePattern": "pattern", "errorType": "type", "errorClass": "cls", "tags": "tags", "severity": "sev"}
    return records.select(*(F.col(a).alias(b) for a, b in names.items()))


def hub(pages: DataFrame) -> DataFrame:
    return pages.select("slug", "title", "summary", "errorCount", "repoCount", "generatedAt").orderBy(F.desc("errorCount"), "slug")


def _quoted(c: str) -> Column:
    text = F.to_json(F.array(c))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _pieces(rows: DataFrame, path: Column, piece: Column, order: list, around: str = "[]", before: Column | str = ",", skip: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(path, piece, before, open, close, skip, order..., keep...): what a file is put together from; `before` parts a piece from the one before it."""
    ordered = [F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)]
    return rows.select(path.alias("path"), piece.alias("piece"), (F.lit(before) if isinstance(before, str) else before).alias("before"), F.lit(around[0]).alias("open"), F.lit(around[1:]).alias("close"), (F.lit(0) if skip is None else skip).alias("skip"), *ordered, *(keep or []))


def write_files(pieces: DataFrame, root: str, ranges: list[str] | None = None, at: str | None = None, by: str | None = None) -> None:
    """Writes the files of pieces under `root` by tasks, a file after the other and piece by piece, so that no row or
    task holds a whole file. A task that is run again writes the same files anew.

    With `ranges`, columns of pieces that name a piece, a directory is written to `at`: those columns,
    path, offset and length in bytes of the piece without its first `skip` bytes; with `by`, in a folder a value of that column."""
    reach(pieces.sparkSession)
    kept = ranges or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        last, out, close, end = None, None, "", 0
        for batch in (b for b in batches if b.num_rows):
            coded = batch.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            same = np.append(names[codes[0]] == last, codes[1:] == codes[:-1])  # as the row before: in a file that is open
            start = pc.if_else(pa.array(same), batch.column(2), batch.column(3)).cast(pa.large_binary())
            whole = pc.binary_join_element_wise(start, batch.column(1).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            ends, body = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1], whole.buffers()[2]
            skip = pc.binary_length(start).to_numpy() + batch.column(5).to_numpy()
            offsets, cuts = np.empty(len(whole), np.int64), np.flatnonzero(~same)
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(whole))):
                if b == a:
                    continue
                if not same[a]:
                    if out is not None:
                        out.write(close.encode())
                        out.close()
                    last, close, end = names[codes[a]], batch.column(4)[int(a)].as_py(), 0
                    files.create_dir(f"{base}/{last}".rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(f"{base}/{last}", compression=None)
                out.write(body.slice(int(ends[a]), int(ends[b] - ends[a])))
                offsets[a:b] = end + ends[a:b] - ends[a] + skip[a:b]
                end += int(ends[b] - ends[a])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column(0), pa.array(offsets), pa.array(np.diff(ends) - skip, pa.int64())], names=[*kept, "path", "offset", "length"])
        if out is not None:
            out.write(close.encode())
            out.close()

    order = [c for c in pieces.columns if c.startswith("o") and c != "open"]
    dealt = pieces.repartition("path").sortWithinPartitions("path", *order)
    schema = ", ".join([*(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept), "path string, offset long, length long"])
    written = dealt.mapInArrow(run, schema)
    if at is None:
        written.write.format("noop").mode("overwrite").save()
    else:
        written.write.partitionBy(*([by] if by else [])).parquet(at)


def _numbers(rows: DataFrame, key: str, path: Column, weight: Column | None, keep: list[str] | None = None, start: Column | None = None) -> DataFrame:
    """Pieces of objects from keys to lists of numbers, or to [weight, list]; rows are blocks (key, block, entries) of the lists.
    A list's first block is found by a window, if it isn't given as `start`."""
    first = (F.min("block").over(Window.partitionBy(key)) if start is None else start) == F.col("block")
    values = F.array_join(F.col("entries").cast("array<string>"), ",")
    head = F.when(F.col("__first"), F.concat(_quoted(key), F.lit(":["), *([] if weight is None else [weight.cast("string"), F.lit(",[")]))).otherwise("")
    end = "]" if weight is None else "]]"
    return _pieces(rows.withColumn("__first", first), path, F.concat(head, values), [key, "block"], "{" + end + "}", F.when(F.col("__first"), end + ",").otherwise(","), F.octet_length(head), keep)


def write_index(entries: DataFrame, root: str) -> dict:
    """Writes the search files of entries (idx, id, repo, ...) under `root`; the summary.

    search/summary.json, codes/<shard>.json, norms/<chunk>.json, tokens/<shard>.json, ids/<shard>.json,
    meta/<chunk>.json, and blocks, a directory of the posting lists: of each token and chunk where its
    entries stand in tokens/<shard>.json, and the least norm among them."""
    spark, n = entries.sparkSession, ix.entry_count(entries)
    kept = scratch(spark, "weights")

    def once(rows: DataFrame, name: str) -> DataFrame:
        """Rows that several files are made of, written so that they are made once."""
        rows.write.parquet(f"{kept}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{kept}/{name}")

    posted = once(ix.measured_blocks(once(ix.words(entries), "words"), n, f"{kept}/tokens"), "lists")
    name = lambda folder, shard: F.concat(F.lit(f"search/{folder}/"), shard, F.lit(".json"))
    number = F.col("idx").cast("string")
    coded = entries.where("code is not null and code != ''").select("code", "idx")
    codes = coded.groupBy("code", F.floor(F.col("idx") / META_CHUNK).cast("long").alias("block")).agg(F.sort_array(F.collect_list("idx")).alias("entries"))
    norms = posted.where("token is null").select("block", F.array_join(F.col("entries").cast("array<string>"), ",").alias("norms"))
    fields = [c for c in ENTRY.fieldNames() if c != "idx" and c in entries.columns]
    meta = ix.meta_chunks(entries).select("chunk", "idx", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))
    for pieces in (
        _numbers(codes, "code", name("codes", shard_name(token_shard(F.col("code")))), None),
        _pieces(norms, name("norms", F.col("block").cast("string")), F.col("norms"), ["block"]),
        _pieces(ix.id_shards(entries), name("ids", shard_name(F.col("shard"))), F.concat(_quoted("id"), F.lit(":"), number), ["id"], "{}"),
        _pieces(meta, name("meta", F.col("chunk").cast("string")), F.col("body"), ["idx"]),
    ):
        write_files(pieces, root)
    lists = posted.where("token is not null").withColumn("name", shard_name(F.col("shard")))
    write_files(_numbers(lists, "token", name("tokens", F.col("name")), F.col("weight"), ["token", "weight", "block", "least", "name"], F.col("first")), root, ["token", "weight", "block", "least", "name"], f"{root}/search/blocks", "name")
    remove(spark, kept)
    summary = {"entryCount": n.first().n, "tokenShards": TOKEN_SHARDS, "metaChunk": META_CHUNK, "weightScale": WEIGHT_SCALE, "threshold": THRESHOLD}
    write_text(spark, f"{root}/search/summary.json", json.dumps(summary))
    return summary


#: Check sums of a chunk of the packed index.
SUMS = "chunk long, bytes long, sha256 string, rawBytes long, rawSha256 string"
#: Chunks under a node of the tree of check sums.
FAN = 256


def _chunks(entries: DataFrame) -> DataFrame:
    """(chunk, body): of each chunk of entries its JSON items. All but the first begin with a comma."""
    fields = [c for c in ENTRY.fieldNames() if c != "idx"]
    rows = ix.meta_chunks(entries).select("chunk", "idx", F.to_json(F.struct(*fields)).alias("body"))
    lists = rows.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("l"))  # at most META_CHUNK rows
    return lists.select("chunk", F.concat(F.when(F.col("chunk") > 0, ",").otherwise(""), F.array_join(F.transform("l", lambda x: x["body"]), ",")).alias("body"))


def _sum_row(chunks: list[int], packed: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(list(map(len, packed)), pa.int64()), pa.array(list(map(sha, packed)), pa.string()), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(sha, raw)), pa.string())], names=["chunk", "bytes", "sha256", "rawBytes", "rawSha256"])


def tree_root(sums: DataFrame) -> str:
    """One check sum for all chunks: nodes hash the sums of up to FAN below them, level by level."""
    level = sums.select(F.col("chunk").alias("n"), "sha256")
    for _ in range(8):  # FAN ** 8 chunks
        node = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sha256"))), lambda x: x["sha256"]), ",")
        level = level.groupBy(F.floor(F.col("n") / FAN).cast("long").alias("n")).agg(F.sha2(node, 256).alias("sha256"))
        if level.where("n > 0").isEmpty():
            break
    row = level.first()
    return row.sha256 if row else hashlib.sha256(b"").hexdigest()


def _write_packed(entries: DataFrame, root: str, head: str, tail: str) -> dict:
    """index/<chunk>.gz, a gzip member a chunk with its check sums, by tasks; and index.json.gz, the members strung together.

    One file has one writer: a task copies the members in order and holds one at a time."""
    spark = entries.sparkSession
    reach(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(f"{root}/index")
        files.create_dir(base, recursive=True)
        for batch in batches:
            chunks, raw = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
            packed = [gzip.compress(t, mtime=0) for t in raw]
            for chunk, member in zip(chunks, packed):
                with files.open_output_stream(f"{base}/{chunk}.gz", compression=None) as out:
                    out.write(member)
            yield _sum_row(chunks, packed, raw)

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        total, raw_total, size, raw_size = hashlib.sha256(), hashlib.sha256(), 0, 0

        def members(n: int) -> Iterator[bytes]:
            yield gzip.compress(head.encode(), mtime=0)
            for k in range(n):
                with files.open_input_stream(f"{base}/index/{k}.gz", compression=None) as f:
                    yield f.read()
            yield gzip.compress(tail.encode(), mtime=0)

        for batch in batches:
            for n in batch.column(0).to_pylist():
                with files.open_output_stream(f"{base}/index.json.gz", compression=None) as out:
                    for member in members(n):
                        text = gzip.decompress(member)
                        total.update(member)
                        raw_total.update(text)
                        size, raw_size = size + len(member), raw_size + len(text)
                        out.write(member)
                yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([total.hexdigest()]), pa.array([raw_size]), pa.array([raw_total.hexdigest()])], names=["bytes", "sha256", "rawBytes", "rawSha256"])

    _chunks(entries).mapInArrow(pack, SUMS).write.parquet(f"{root}/index/sums")
    sums = spark.read.schema(SUMS).parquet(f"{root}/index/sums")
    n = sums.count()
    whole = spark.createDataFrame([(n,)], "n long").mapInArrow(string, "bytes long, sha256 string, rawBytes long, rawSha256 string").collect()[0]
    return {"path": "/index.json.gz", "bytes": whole.bytes, "sha256": whole.sha256, "encoding": "gzip", "rawBytes": whole.rawBytes, "rawSha256": whole.rawSha256, "chunks": n, "tree": tree_root(sums)}


def publish(spark: SparkSession, repos: DataFrame, records: DataFrame, pages: DataFrame, out: str, version: str) -> dict:
    """Builds the data set as a version of its own under `out` and names it in current.json last; returns the manifest.

    Readers see the version before or after: the pointer is replaced in one step. The version before
    stays for those that read it, older ones go. Invalid rows are left out and counted. Files are
    written by tasks, piece by piece; the driver writes the manifest, the summary and the pointer. Any
    file system that tasks reach will do."""
    done, mine = analyzed(repos, records)
    repos_v, pages_v = validate_repos(done), validate_info_pages(pages.select(*INFO_PAGE.fieldNames()))
    good_repos = repos_v.where("valid").select(*REPO.fieldNames())
    before = _current(spark, out)
    folder = f"v{uuid.uuid4().hex}"
    stage = f"{out}/versions/{folder}"
    checked = validate_errors(with_defaults(mine.join(good_repos.select("repo"), "repo", "left_semi").select(*ERROR.fieldNames())))
    checked.write.parquet(f"{stage}/_records")  # records are made and checked once, whatever is published of them
    records_v = spark.read.schema(checked.schema).parquet(f"{stage}/_records")
    good = records_v.where("valid").select(*ERROR.fieldNames())
    counts = dataset_counts(repos_v, records_v, pages_v).first().asDict()

    numbered = ix.dense_index(compact(good).withColumn("__h", F.conv(F.substring("id", 1, 15), 16, 10).cast("long")), "__h").drop("__h")
    numbered.write.parquet(f"{stage}/_entries")
    entries = spark.read.parquet(f"{stage}/_entries")
    write_index(entries, stage)
    body = F.to_json(F.struct(*ERROR.fieldNames()))
    write_files(_pieces(good.withColumn("__body", body), F.concat(F.lit("repos/"), "repo", F.lit(".json")), F.col("__body"), ["id"]), stage)
    valid_pages = pages_v.where("valid").select(*INFO_PAGE.fieldNames())
    whole = F.to_json(F.struct("*"))
    write_files(_pieces(valid_pages.select("slug", whole.alias("body")), F.concat(F.lit("info/"), "slug", F.lit(".json")), F.substr("body", F.lit(2), F.length("body") - 2), ["slug"], "{}"), stage)
    write_files(_pieces(hub(valid_pages).select("errorCount", "slug", whole.alias("body")), F.lit("info/index.json"), F.col("body"), [-F.col("errorCount"), F.col("slug")]), stage)
    write_files(_pieces(good_repos.select("errorCount", "repo", whole.alias("body")), F.lit("repos.json"), F.col("body"), [-F.col("errorCount"), F.col("repo")]), stage)
    for path in ("repos.json", "info/index.json"):
        if not exists(spark, f"{stage}/{path}"):
            write_text(spark, f"{stage}/{path}", "[]")
    head = json.dumps({"schemaVersion": VERSION, "datasetVersion": version, "errors": []})[:-2]
    index = _write_packed(entries, stage, head, "]}")
    manifest = {
        "schemaVersion": VERSION, "datasetVersion": version, "counts": {k: counts[k] for k in ("repos", "errors", "infoPages")}, "rejected": counts["rejected"],
        "files": {"index": index, "repos": _checksum(f"{stage}/repos.json"), "searchSummary": _checksum(f"{stage}/search/summary.json", "/search/summary.json")},
    }
    for made in ("_entries", "_records"):
        remove(spark, f"{stage}/{made}")
    write_text(spark, f"{stage}/manifest.json", json.dumps(manifest))
    write_text(spark, f"{out}/current.json", json.dumps({"folder": folder, "datasetVersion": version}))
    for name in names(spark, f"{out}/versions"):
        if name not in (folder, before):
            remove(spark, f"{out}/versions/{name}")
    return manifest


def _current(spark: SparkSession, root: str) -> str | None:
    return json.loads(read_text(spark, f"{root}/current.json"))["folder"] if exists(spark, f"{root}/current.json") else None


def home(spark: SparkSession, root: str) -> str:
    """The folder of the current version; root itself where nothing names one."""
    folder = _current(spark, root)
    return root if folder is None else f"{root}/versions/{folder}"


def _checksum(path: str, name: str | None = None) -> dict:
    """Length and sha256 of a file, read piece by piece."""
    files, base = open_root(path)
    total, size = hashlib.sha256(), 0
    with files.open_input_stream(base, compression=None) as f:
        while part := f.read(1 << 20):
            total.update(part)
            size += len(part)
    return {"path": name or f"/{path.rpartition('/')[2]}", "bytes": size, "sha256": total.hexdigest()}


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(read_text(spark, f"{home(spark, root)}/manifest.json"))


class Tampered(ValueError):
    """Chunks that don't match their check sums."""


def _unpacked(sums: DataFrame, folder: str, name: str) -> DataFrame:
    """(chunk, sha256, body) of the chunks of sums, read by tasks from folder/<chunk or sha256>.gz; body is null where the check sum doesn't hold."""
    reach(sums.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(folder)
        for batch in batches:
            for chunk, sha in zip(batch.column("chunk").to_pylist(), batch.column("sha256").to_pylist()):
                body, at = None, f"{base}/{chunk if name == 'chunk' else sha}.gz"
                if files.get_file_info(at).type != fs.FileType.NotFound:
                    with files.open_input_stream(at, compression=None) as f:
                        packed = f.read()
                    body = gzip.decompress(packed).decode() if hashlib.sha256(packed).hexdigest() == sha else None
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sha]), pa.array([body], pa.string())], names=["chunk", "sha256", "body"])

    return sums.select("chunk", "sha256").mapInArrow(run, "chunk long, sha256 string, body string")


def _entries(chunks: DataFrame, size: int) -> DataFrame:
    """Entries of (chunk, body). A chunk that didn't hold its check sum is an error that names it."""
    items = f"array<{ENTRY.simpleString().replace('idx:bigint,', '')}>"
    body = F.when(F.col("body").isNull(), F.raise_error(F.concat(F.lit("chunk doesn't match its check sum: "), F.col("chunk").cast("string")))).otherwise(F.concat(F.lit("["), F.regexp_replace("body", "^,", ""), F.lit("]")))
    rows = chunks.select("chunk", F.posexplode(F.from_json(body, items)).alias("at", "e"))
    return rows.select((F.col("chunk") * size + F.col("at")).alias("idx"), "e.*")


def _check(sums: DataFrame, tree: str) -> DataFrame:
    if tree_root(sums) != tree:
        raise Tampered("check sums of chunks don't match the manifest")
    return sums


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The published entries with idx. Chunks are verified by the tasks that read them; one that was changed is named in an error."""
    at = home(spark, root)
    sums = _check(spark.read.schema(SUMS).parquet(f"{at}/index/sums"), read_manifest(spark, root)["files"]["index"]["tree"])
    bad = [r.chunk for r in _unpacked(sums, f"{at}/index", "chunk").where("body is null").select("chunk").limit(20).collect()]
    if bad:
        raise Tampered(f"chunks that don't match their check sums: {sorted(bad)}")
    return _entries(_unpacked(sums, f"{at}/index", "chunk"), META_CHUNK)


def sync(spark: SparkSession, root: str, cache: str) -> dict:
    """Brings a cache up to the published version: (version, chunks, fetched). Only chunks that the cache lacks are read.

    Chunks are kept under their check sums and verified by the tasks that copy them; if one doesn't
    match, Tampered names it and the cache stays at the version that it has. The pointer is moved last."""
    reach(spark)
    at, manifest = home(spark, root), read_manifest(spark, root)
    sums = _check(spark.read.schema(SUMS).parquet(f"{at}/index/sums"), manifest["files"]["index"]["tree"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(f"{at}/index")
        own, mine = open_root(f"{cache}/chunks")
        own.create_dir(mine, recursive=True)
        for batch in batches:
            for chunk, sha in zip(batch.column("chunk").to_pylist(), batch.column("sha256").to_pylist()):
                there, good = own.get_file_info(f"{mine}/{sha}.gz").type != fs.FileType.NotFound, True
                if not there:
                    with files.open_input_stream(f"{base}/{chunk}.gz", compression=None) as f:
                        packed = f.read()
                    good = hashlib.sha256(packed).hexdigest() == sha
                    if good:
                        part = f"{mine}/{sha}.{uuid.uuid4().hex}"
                        with own.open_output_stream(part, compression=None) as out:
                            out.write(packed)
                        own.move(part, f"{mine}/{sha}.gz")
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([not there]), pa.array([good])], names=["chunk", "fetched", "good"])

    folder = f"sums/{uuid.uuid4().hex}"
    sums.select("chunk", "sha256").mapInArrow(fetch, "chunk long, fetched boolean, good boolean").write.parquet(f"{cache}/{folder}.done")
    done = spark.read.parquet(f"{cache}/{folder}.done")
    bad = [r.chunk for r in done.where("not good").select("chunk").limit(20).collect()]
    if bad:
        raise Tampered(f"chunks that don't match their check sums: {sorted(bad)}")
    sums.write.parquet(f"{cache}/{folder}")
    write_text(spark, f"{cache}/current.json", json.dumps({"datasetVersion": manifest["datasetVersion"], "sums": folder}))
    counts = done.agg(F.count("*").alias("chunks"), F.count_if("fetched").alias("fetched")).first()
    return {"version": manifest["datasetVersion"], **counts.asDict()}


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """Entries of a cache as sync left it."""
    folder = json.loads(read_text(spark, f"{cache}/current.json"))["sums"]
    return _entries(_unpacked(spark.read.schema(SUMS).parquet(f"{cache}/{folder}"), f"{cache}/chunks", "sha256"), META_CHUNK)


#: The list of pages, and a page (null for one that isn't there).
HUB = struct_of("slug string, title string, summary string, errorCount int, repoCount int, generatedAt string")


def read_hub(spark: SparkSession, root: str) -> DataFrame:
    return read_json(spark, f"{home(spark, root)}/info/index.json", HUB)


def read_pages(spark: SparkSession, root: str, slug: str | None = None) -> DataFrame:
    """Published pages, one or all; no rows for one that isn't there."""
    at = f"{home(spark, root)}/info"
    if slug is not None:
        return read_json(spark, f"{at}/{slug}.json", INFO_PAGE)
    return spark.read.schema(INFO_PAGE).option("multiLine", "true").option("pathGlobFilter", "*.json").json(at).where("clusterKey is not null")


def read_named_pages(spark: SparkSession, root: str, slugs: DataFrame) -> DataFrame:
    """The published pages of many slugs (slug), each from its own file; no rows for those that aren't there."""
    texts = read_texts(slugs.select(F.concat(F.lit("info/"), "slug", F.lit(".json")).alias("path")), home(spark, root))
    return texts.select(F.from_json("value", INFO_PAGE).alias("p")).select("p.*")


def is_stale(spark: SparkSession, root: str, known_version: str | None) -> bool:
    """Whether the published version is another than the one that is known; so it is where the manifest can't be read."""
    try:
        return read_manifest(spark, root)["datasetVersion"] != known_version
    except (AnalysisException, ValueError, KeyError):
        return True


def json_schemas() -> dict[str, dict]:
    return {"error": ERROR.jsonValue(), "repo": REPO.jsonValue(), "info-page": INFO_PAGE.jsonValue(), "index": ENTRY.jsonValue()}
