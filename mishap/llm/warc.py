"""WARC: write captures as WARC records, index them in sorted runs, merge the runs by URL key and time.

Each writer task appends records to archive files, a gzip member a record, and sorts the index
entries of a file into a run. The runs are cut into ranges of (URL key, timestamp, id) with about
equal numbers of entries. A range's slices of the runs are spooled to one file in the shared folder
and merged by a loser tree over a reader a slice, each of which holds one small batch at a time, so
that capture histories come out in one global order whatever their number. The archives are read
back by the entries of the merged index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm.shared import Tables, local_root, prepare, table, text_bytes

#: A file ends, and with it a run, after so many records or compressed bytes.
RUN_RECORDS, FILE_BYTES = 50_000, 256 << 20
#: Index entries in a range of the merge, about, in a batch of a run's reader, and in a batch of what is merged.
RANGE_ENTRIES, READ_ENTRIES, OUT_ENTRIES = 1_000_000, 256, 4096
DATE = "2024-01-01T00:00:00Z"
_INDEX = "file string, run string, seq long, urlkey string, timestamp string, page_id {id}, offset long, length long, record_type string"
_INDEX_COLUMNS = ["file", "run", "seq", "urlkey", "timestamp", "page_id", "offset", "length", "record_type"]


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then ")" and path and query, lower case: com,example)/a?b."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").strip().lower()
    labels = re.sub(r"^www\d*\.", "", host).split(".")[::-1]
    return f"{','.join(labels)}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(x) -> str:
    return re.sub(r"[\r\n]+", " ", str(x))


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP headers of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"Page-ID: {_one_line(page_id)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {_one_line(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, and of the HTTP block its headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(out["Content-Length"])].partition(b"\r\n\r\n")
    out["http"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    out["payload"] = payload
    return out


class LoserTree:
    """k-way merge: inner nodes keep the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [0] * max(1, self.k)
        if self.k:
            winners = [0] * self.k + list(range(self.k))
            for node in range(self.k - 1, 0, -1):
                a, b = winners[2 * node], winners[2 * node + 1]
                winners[node], self.tree[node] = (a, b) if self._first(a, b) else (b, a)
            self.tree[0] = winners[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.k) // 2
            while node:
                if self._first(self.tree[node], winner):
                    winner, self.tree[node] = self.tree[node], winner
                node //= 2
            self.tree[0] = winner


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null as empty), timestamp (as it is, or null), digest (hex) and refers_to: null for responses,
    else the page_id whose payload equals it.

    Of rows with equal payloads of at least least_bytes the largest page_id is the response. Null
    page_ids count as smallest; if all are null, and for rows that repeat the response's page_id,
    each is a response of its own."""
    tables = Tables(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    time = F.col("timestamp").cast("string") if "timestamp" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", "url", html.alias("html"), time.alias("timestamp"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), (F.octet_length(html) >= least_bytes).alias("counts"))
    # only payloads that occur more than once go into the join, so that it stays small
    groups = tables.keep(rows.where("counts").groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1"), "groups")
    # a payload may be that of a third of all pages: at most 1000 such go by broadcast, so that no key of the join is hot
    least = (groups.agg(F.sum("n")).first()[0] or 0) / 1000
    hot, rest = groups.where(F.col("n") >= least).drop("n"), groups.where(F.col("n") < least).drop("n")
    marked = rows.join(F.broadcast(hot.withColumnRenamed("latest", "hot")), "digest", "left")
    cold = marked.where("hot is null").drop("hot").join(rest, "digest", "left")
    out = marked.where("hot is not null").withColumnRenamed("hot", "latest").unionByName(cold)
    revisit = F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", "timestamp", "digest", F.when(revisit, F.col("latest")).alias("refers_to"))


def write_archives(decided: DataFrame, root: str, date: str = DATE) -> DataFrame:
    """Writes the archives under `root` and returns their index, in runs sorted by (urlkey, timestamp, page_id).

    Rows without a timestamp take `date`. Timestamps are kept as the digits of their text, 14 at most.

    A task that is run again writes files of other names; the index only names files of the attempt
    whose rows Spark kept. The files are complete before their rows are handed out."""
    kind = decided.schema["page_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_root(root)
        files.create_dir(base, recursive=True)
        out, entries, at, name = None, [], 0, ""

        def finish() -> pa.RecordBatch:
            out.close()
            rows = sorted(entries, key=lambda e: _key(*e[:3]))
            cols = [[name] * len(rows), [name] * len(rows), list(range(len(rows))), *([e[i] for e in rows] for i in range(6))]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=_INDEX_COLUMNS)

        for batch in batches:
            s, n = pa.string(), pa.int64()
            kinds = [s, s, n, s, s, batch.schema.field(0).type, n, n, s]
            ids, urls, times, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for page_id, url, payload, time, digest, refers_to in zip(ids, urls, text_bytes(batch.column(2)), times, digests, refers):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, entries, at = files.open_output_stream(f"{base}/{name}", compression=None), [], 0
                revisit = refers_to is not None
                bare = base64.b32encode(bytes.fromhex(digest)).decode()
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = packer.compress(record(page_id, url, payload, bare, refers_to, revisit, _one_line(time or date))) + packer.flush()
                out.write(raw)
                entries.append((url_key(url), re.sub(r"\D", "", time or date)[:14], page_id, at, len(raw), "revisit" if revisit else "response"))
                at += len(raw)
                if len(entries) >= RUN_RECORDS or at >= FILE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return decided.select("page_id", "url", "html", "timestamp", "digest", "refers_to").mapInArrow(run, _INDEX.format(id=kind.simpleString()))


def _key(urlkey: str, timestamp: str, page_id) -> tuple:
    """Entries' order, as Spark has it: text by its bytes, null ids first."""
    return urlkey.encode(), timestamp, page_id is not None, page_id if page_id is not None else 0


def _slices(spool: pa.RecordBatchFileReader, batches: range) -> Iterator[tuple]:
    """The entries of a slice of a run, (key, place in the range, entry), a batch in memory at a time."""
    for i in batches:
        for j, entry in enumerate(zip(*(c.to_pylist() for c in spool.get_batch(i).columns))):
            yield _key(*entry[3:6]), (i, j), entry


def merge_runs(index: DataFrame, root: str) -> DataFrame:
    """The runs merged: partitions are ranges of (urlkey, timestamp, page_id), in global order within and across.

    Adds `part` (the range) and `nth` (place in it). A hot URL's captures spread over ranges, as the
    timestamp, the id and at last the run are part of the range key. Slices arrive sorted by run, are
    spooled under `root`, and merged; a task that is run again spools to a file of another name."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, base = local_root(root)
        name, out, runs, last, count = f"{base}/{uuid.uuid4().hex}.arrow", None, [], None, 0
        for batch in batches:
            owner = batch.column("run").to_pylist()
            edges = [i for i in range(len(owner)) if i and owner[i] != owner[i - 1]]
            for a, b in zip([0, *edges], [*edges, len(owner)]):
                for at in range(a, b, READ_ENTRIES):
                    if out is None:
                        files.create_dir(base, recursive=True)
                        sink = files.open_output_stream(name, compression=None)
                        out = pa.ipc.new_file(sink, batch.schema)
                    if owner[a] != last:
                        runs.append([])
                        last = owner[a]
                    out.write_batch(batch.slice(at, min(READ_ENTRIES, b - at)))
                    runs[-1].append(count)
                    count += 1
        if out is None:
            return
        out.close()
        sink.close()
        with files.open_input_file(name) as f:
            spool = pa.ipc.open_file(f)
            merged, done = iter(LoserTree([_slices(spool, r) for r in runs])), 0
            while rows := [entry for _, _, entry in islice(merged, OUT_ENTRIES)]:
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), spool.schema.types)]
                columns += [pa.array([part] * len(rows), pa.int32()), pa.array(range(done, done + len(rows)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*_INDEX_COLUMNS, "part", "nth"])
                done += len(rows)
        files.delete_file(name)

    ranges = max(1, -(-index.count() // RANGE_ENTRIES), index.sparkSession.sparkContext.defaultParallelism)
    kind = index.schema["page_id"].dataType.simpleString()
    ranged = index.select(_INDEX_COLUMNS).repartitionByRange(ranges, "urlkey", "timestamp", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(merge, _INDEX.format(id=kind) + ", part int, nth long")


def read_archives(index: DataFrame, root: str) -> DataFrame:
    """Reads each indexed record back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, part, nth.

    Payloads of responses are measured and digested anew and must match their headers; a revisit's
    come from the HTTP and digest headers of the full payload."""
    kind = index.schema["page_id"].dataType
    number = kind.simpleString() != "string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = local_root(root)
        for batch in batches:
            out = []
            for name, own in batch.sort_values(["file", "offset"]).groupby("file", sort=False):
                with files.open_input_file(f"{base}/{name}") as f:
                    for at, length, part, nth in zip(own["offset"], own["length"], own["part"], own["nth"]):
                        f.seek(int(at))
                        r = parse(zlib.decompress(f.read(int(length)), 31))
                        digest, size = r["WARC-Payload-Digest"].removeprefix("sha1:"), int(r["http"]["Content-Length"])
                        if r["WARC-Type"] == "response" and (bare_digest(r["payload"]) != digest or len(r["payload"]) != size):
                            raise ValueError(f"{name} at {at}: the payload doesn't match its digest")
                        ids = [r.get("Page-ID"), r.get("Refers-To-Page-ID")]
                        out.append((*((int(x) if number and x is not None else x) for x in ids), r.get("WARC-Target-URI"), size, digest, r["WARC-Type"], part, nth))
            frame = pd.DataFrame(out, columns=["page_id", "refers_to", "url", "payload_bytes", "payload_digest", "record_type", "part", "nth"])
            if number:
                frame = frame.astype({"page_id": "Int64", "refers_to": "Int64"})
            yield frame[["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "part", "nth"]]

    k = kind.simpleString()
    near = index.repartition(F.col("file"))
    return near.mapInPandas(run, f"page_id {k}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {k}, part int, nth long")


def archive(pages: DataFrame, least_bytes: int = 0, date: str = DATE) -> tuple[DataFrame, DataFrame, str]:
    """(merged index, records read back, folder of the archives). See decide() for ties and nulls; a null
    html is an empty payload, a null url an empty key. Pages may have a `timestamp`; others are of
    `date`. No pages give empty results."""
    spark = prepare(pages.sparkSession)
    tables = Tables(spark, "archives")
    root = tables.path("warc")
    runs = tables.keep(write_archives(decide(pages, least_bytes), root, date), "runs")
    merged = tables.keep(merge_runs(runs, tables.path("spool")), "index")
    return merged, read_archives(merged, root), root


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records, _ = archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS latest FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = latest OR latest IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = latest OR latest IS NULL THEN NULL ELSE latest END AS refers_to
FROM g
"""
