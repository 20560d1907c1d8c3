"""Shared pieces of the corpus operators: settled tables, texts as byte arrays, hashes, components.

Texts reach Python as Arrow batches. A batch is cut into blocks of whole rows with a bounded
number of text bytes, and a block is handled as one numpy array, not row by row.
"""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20
LAST_ID = (1 << 63) - 1          # the order of a row without an id: after every id

# ---------------------------------------------------------------- settled tables


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='corpus-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends, lost executors cost a re-read.

    The shuffle files behind it are of no more use, so Spark is told to drop them with the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    for kept in _recording:
        kept.append(out)
    return out


_recording: list[list[DataFrame]] = []


@contextmanager
def settled_tables() -> Iterator[list[DataFrame]]:
    """Lists the tables settled inside the block and not discarded there."""
    kept: list[DataFrame] = []
    _recording.append(kept)
    try:
        yield kept
    finally:
        _recording[:] = [k for k in _recording if k is not kept]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*settled: DataFrame) -> None:
    """Deletes settled tables. Only what was settled from them afterwards may be used further."""
    for df in settled:
        _delete(df.sparkSession, df.settled_at)
        for kept in _recording:
            kept[:] = [k for k in kept if k is not df]


def clear_shared(spark: SparkSession) -> None:
    """Deletes what this application has settled. Call it when its results have been written."""
    _delete(spark, shared_dir(spark))


# ---------------------------------------------------------------- distinct texts

def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One settled row for each different text: tid, key, text, n (rows), first (smallest doc_id).

    Copies meet in a partial aggregation before the shuffle. A null text counts as empty, a null
    doc_id as larger than every other. tid is fixed by the write, so later reads agree on it.
    """
    rows = docs.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("doc_id", F.lit(LAST_ID)).cast("long").alias("doc_id"))
    return settle(rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"),
                                          F.min("doc_id").alias("first"))
                  .withColumn("tid", F.monotonically_increasing_id()))


def packed(docs: DataFrame) -> DataFrame:
    """All columns of docs in one struct, row, next to text: no name of theirs can clash."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("text"))


def with_row(docs: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of packed rows with further fields in place of text."""
    return T.StructType([packed(docs).schema["row"], *(T.StructField(name, kind) for name, kind in fields)])


# ---------------------------------------------------------------- texts as arrays

def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; nulls are empty."""
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offs


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes in column text, or with one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = as_bytes(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            i = j


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


WHITE = byte_set((0x09, 0x0D), (0x20, 0x20))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))   # before lower-casing
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a block, and for each row the index of its first word."""
    gap = separators[data]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offs] = True
    opens, closes = ~gap, ~gap
    opens[1:] &= gap[:-1] | row_start[1:-1]
    closes[:-1] &= gap[1:] | row_start[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashes

BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same for equal bytes in any place."""
    sums = prefix_sums(table[data])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    return mix((sums[width:] - sums[:-width]) * powers(n)[1])


def cover_runs(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places are covered by a run of `width` places from one of the starts."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps)[:n] > 0


# ---------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node and the smallest node it can reach, as label.

    Alternates two steps that keep each node next to smaller ones: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones. Ends when nothing changes; all that
    reaches the driver is a count and a sum for each round. A hub's list is never collected: the
    smallest neighbour comes from a combined aggregation and goes back by a join. Tables of earlier
    rounds are deleted. No links give no rows.
    """
    pairs = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct())
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before = pairs
        pairs = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before, large)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(20,0)")),
                        F.sum(F.col("v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    ends = pairs.groupBy("u").agg(F.min("v").alias("label"))
    return (ends.select(F.col("u").alias("node"), "label")
            .union(ends.select(F.col("label").alias("node"), "label").distinct()))
