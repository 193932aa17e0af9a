"""The inverted index: document frequencies, idf weights, norms, postings, shards and dense numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishap.functions.text import META_CHUNK, WEIGHT_SCALE, fuzzy_tokens, id_shard, round_half_up, token_shard
from mishap.storage import scratch
from mishap.workers import reach


def dense_index(rows: DataFrame, order: str | list[Column], name: str = "idx") -> DataFrame:
    """Numbers rows from 0 in the order of a column or several, without a sort in one task.

    Rows are sorted in ranges and written once to the shared folder with their range and their place
    in it: a range's rows start after the sizes of the ranges before, which are one row a range."""
    spark, order = rows.sparkSession, [order] if isinstance(order, str) else order
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its upper bits are the range's
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__own", own)
    at = scratch(spark, "numbered")
    ranged.write.parquet(at)
    numbered = spark.read.schema(ranged.schema).parquet(at)
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = numbered.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", before.alias("__before"))
    return numbered.join(F.broadcast(sizes), "__p").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__p", "__own", "__before")


def postings(entries: DataFrame, key: str = "idx", message: str = "msg") -> DataFrame:
    """A row for each distinct token of an entry: (key, token)."""
    # outer, as of a plain explode's list the planner wants to know first whether it is empty, and makes it twice
    return entries.select(key, F.explode_outer(fuzzy_tokens(F.col(message))).alias("token")).where("token is not null")


def words(entries: DataFrame, key: str = "idx", message: str = "msg") -> DataFrame:
    """(key, words): an entry's distinct tokens as one text, parted by blanks. A row an entry, so that it is kept and moved at about the text's size."""
    return entries.select(key, F.array_join(fuzzy_tokens(F.col(message)), " ").alias("words"))


def split_words(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., token): a row for each token of rows of words()."""
    return rows.where("words != ''").select(*keep, F.explode(F.split("words", " ")).alias("token"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def _scaled(x: Column) -> Column:
    return round_half_up(x * WEIGHT_SCALE).cast("long")


def weights(tokens: DataFrame, n: DataFrame) -> DataFrame:
    """(token, df, idf, weight): weight is the idf scaled to a whole number. n: one row with n, the number of entries."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return counts.select("token", "df", idf(F.col("df"), F.greatest("n", F.lit(1))).alias("idf")).withColumn("weight", _scaled(F.col("idf")))


def entry_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n"))


def norms(tokens: DataFrame, weighted: DataFrame, key: str = "idx") -> DataFrame:
    """(key, norm): the length of an entry's idf vector, scaled to a whole number."""
    length = F.sqrt(F.sum(F.col("idf") * F.col("idf")))
    return tokens.join(weighted, "token").groupBy(key).agg(round_half_up(length * WEIGHT_SCALE).cast("long").alias("norm"))


def posting_lists(tokens: DataFrame, n: DataFrame, key: str = "idx") -> DataFrame:
    """(shard, token, weight, entries in order). A list belongs in one place as the published form holds it; joins use postings().

    n: one row with n, the number of entries. A token's list is as long as its document frequency, so its weight follows from it."""
    lists = tokens.groupBy("token").agg(F.sort_array(F.collect_list(key)).alias("entries")).crossJoin(F.broadcast(n))
    return lists.select(token_shard(F.col("token")).alias("shard"), "token", _scaled(idf(F.size("entries"), F.greatest("n", F.lit(1)))).alias("weight"), "entries")


def posting_blocks(tokens: DataFrame, weighted: DataFrame, size: int = META_CHUNK, key: str = "idx", least: bool | DataFrame = False) -> DataFrame:
    """(shard, token, weight, block, entries): posting lists in blocks of `size` numbers each, so that no row holds a common token's whole list.

    least: adds the least norm over 0 of a block's entries, from which a search knows how well any of them can score;
    norms that are known can be given."""
    block = F.floor(F.col(key) / size).cast("long")
    rows, more = tokens, []
    if least is not False:
        lengths = norms(tokens, weighted, key) if least is True else least
        rows, more = tokens.join(lengths, key), [F.min(F.when(F.col("norm") > 0, F.col("norm"))).alias("least")]
    lists = rows.groupBy("token", block.alias("block")).agg(F.sort_array(F.collect_list(key)).alias("entries"), *more)
    return lists.join(weighted, "token").select(token_shard(F.col("token")).alias("shard"), "token", "weight", "block", "entries", *(["least"] if more else []))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The number of tokens of each row's words, and the tokens."""
    lists = pc.split_pattern(batch.column("words"), " ")
    return np.where(pc.equal(batch.column("words"), "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)), pc.filter(lists.flatten(), pc.not_equal(lists.flatten(), ""))


def _by_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, token, entries) from rows (block, idx, words) sorted by block and idx: the lists of a block are made in arrays."""
    at, idx, tokens = None, [], []

    def lists() -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array(tokens, pa.string()).combine_chunks().dictionary_encode()
        codes, numbers = coded.indices.to_numpy(), np.concatenate(idx)
        order, sizes = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=len(coded.dictionary))
        entries = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(numbers[order]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entries), at)), coded.dictionary, entries], names=["block", "token", "entries"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
            if b == a:
                continue
            if blocks[a] != at:
                if tokens:
                    yield from lists()
                at, idx, tokens = blocks[a], [], []
            part = batch.slice(a, b - a)
            counts, flat = _flat(part)
            if len(flat):
                idx.append(np.repeat(part.column("idx").to_numpy(), counts))
                tokens.append(flat)
    if tokens:
        yield from lists()


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with the least norm over 0 of their entries, and a row (no token) a block with its entries' norms in order, from the
    lists of a block with their idf, and its entries (no token)."""
    at, kept = None, []

    def block() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(kept).combine_chunks()
        alone = pc.is_null(rows.column("token"))
        there = np.sort(rows.filter(alone).column("entries").combine_chunks().flatten().to_numpy())
        rows = rows.filter(pc.invert(alone)).combine_chunks()
        lists = rows.column("entries").combine_chunks()
        norms = np.zeros(len(there), np.int64)
        least = pa.nulls(0, pa.int64())
        if rows.num_rows:
            sizes, place = pc.list_value_length(lists).to_numpy(), np.searchsorted(there, lists.flatten().to_numpy())
            idf = rows.column("idf").to_numpy()
            norms = np.floor(np.sqrt(np.bincount(place, np.repeat(idf * idf, sizes), len(there))) * WEIGHT_SCALE + 0.5).astype(np.int64)
            best = np.minimum.reduceat(np.where(norms > 0, norms, np.iinfo(np.int64).max)[place], np.cumsum(sizes) - sizes)
            least = pa.array(best, mask=best == np.iinfo(np.int64).max)
        names = ["block", "token", "shard", "weight", "first", "least", "entries"]
        if rows.num_rows:
            out = pa.Table.from_arrays([rows.column("block"), rows.column("token"), rows.column("shard"), rows.column("weight"), rows.column("first"), least, lists], names=names)
            yield from out.to_batches(max_chunksize=1000)
        own = [pa.array([at], pa.int64()), pa.nulls(1, pa.string()), *(pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())), pa.array([norms], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(own, names=names)

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
            if b == a:
                continue
            if blocks[a] != at:
                if kept:
                    yield from block()
                at, kept = int(blocks[a]), []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield from block()


def measured_blocks(rows: DataFrame, n: DataFrame, at: str, size: int = META_CHUNK) -> DataFrame:
    """(block, token, shard, weight, first, least, entries): posting lists in blocks of `size` numbers with the least norm over 0 of
    their entries; first is the token's first block. A row without token a block holds the norms of its entries in order. rows: of words().

    Lists are made a block at a time and meet their weights as lists, so that no posting is a row to shuffle; weights are kept
    under `at` and merged, as a vocabulary has no bound."""
    reach(rows.sparkSession)
    block = F.floor(F.col("idx") / size).cast("long").alias("block")
    counts = split_words(rows.select(block, "words"), "block").groupBy("token").agg(F.count("*").alias("df"), F.min("block").alias("first")).crossJoin(F.broadcast(n))
    known = counts.select("token", "first", idf(F.col("df"), F.greatest("n", F.lit(1))).alias("idf"), token_shard(F.col("token")).alias("shard")).withColumn("weight", _scaled(F.col("idf")))
    known.write.parquet(at)
    known = rows.sparkSession.read.schema(known.schema).parquet(at)
    dealt = rows.select(block, "idx", "words").repartition("block").sortWithinPartitions("block", "idx")
    lists = dealt.mapInArrow(_by_token, "block long, token string, entries array<long>").join(known.hint("merge"), "token")
    alone = rows.groupBy(block).agg(F.collect_list("idx").alias("entries"))  # at most `size`
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    met = lists.select("block", "token", "shard", "weight", "first", "idf", "entries").union(alone.select("block", none("token", "string"), none("shard", "int"), none("weight", "long"), none("first", "long"), none("idf", "double"), "entries"))
    return met.repartition("block").sortWithinPartitions("block").mapInArrow(_measured, "block long, token string, shard int, weight long, first long, least long, entries array<long>")


def code_lists(entries: DataFrame) -> DataFrame:
    return entries.where("code is not null and code != ''").groupBy("code").agg(F.sort_array(F.collect_list("idx")).alias("entries"))


def id_shards(entries: DataFrame) -> DataFrame:
    return entries.select(id_shard(F.col("id")).alias("shard"), "id", "idx")


def meta_chunks(entries: DataFrame) -> DataFrame:
    return entries.withColumn("chunk", F.floor(F.col("idx") / META_CHUNK).cast("long"))


@dataclass
class Prepared:
    """What searches read of an index. Kept in memory or on disk; a lost part is made again from its inputs.

    Entries are kept by the searches that read most of their columns alone."""

    entries: DataFrame
    tokens: DataFrame
    weighted: DataFrame
    sizes: DataFrame
    n: DataFrame

    def release(self) -> None:
        """Lets go of what is kept."""
        for kept in (self.sizes, self.weighted, self.tokens, self.entries):
            kept.unpersist()


def prepare(entries: DataFrame | Prepared) -> Prepared:
    """The parts of the index that searches share, computed once for all of them."""
    if isinstance(entries, Prepared):
        return entries
    tokens, n = postings(entries).persist(), entry_count(entries)
    weighted = weights(tokens, n).persist()
    square = F.sum(F.col("idf") * F.col("idf"))
    sizes = tokens.join(weighted, "token").groupBy("idx").agg(F.sum("idf").alias("we"), round_half_up(F.sqrt(square) * WEIGHT_SCALE).cast("long").alias("norm"))
    return Prepared(entries, tokens, weighted, sizes.persist(), n)


def build(entries: DataFrame) -> dict[str, DataFrame]:
    """All parts of the index of entries (idx, id, repo, code, msg, ...), by name."""
    tokens, n = postings(entries), entry_count(entries)
    weighted = weights(tokens, n)
    return {"tokens": posting_lists(tokens, n), "norms": norms(tokens, weighted), "codes": code_lists(entries), "ids": id_shards(entries), "meta": meta_chunks(entries), "summary": n}
