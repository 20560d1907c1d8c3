"""Near-duplicates by the similarity of their word shingles: one-wildcard variants of a wide SimHash, then the sets.

At a similarity of 0.8 two SimHashes differ in some 15 % of their bits, so 64 bits are too few. 1,550 bits of the shingle
set are cut into 50 segments of 31. Each segment is a key as it is and with each of its set bits cleared: segments with at
most one bit set in one only, and at most one in the other only, share a key. Of pairs at 0.8 about one in a hundred or
fewer shares no key. Unrelated sets share one by chance, pairs times segments times 16.5 squared over 2 to the 31st,
which is what the width of a segment holds down. Sets too small to be alike to any other have no keys. Keys are made
for a few segments at a time, which bounds the shuffle. Pairs further apart than a quarter of all bits are dropped, and the rest is
compared shingle by shingle. A bucket is linked to its smallest member first. While members of a bucket are in different
components, four more of them, of its rarest components, meet all members of other components and leave it. A group
of near copies is then one component, whichever member came first. What is still in different components really is
apart, yet shares a bucket: those sets meet each other, and sizes and SimHashes decide within the join.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (LOWER, WHITE, blocks, byte_table, components, discard, mix, packed, settle, settled_tables,
                     span_hashes, window_hashes, with_row, words)

WIDTH = 5
SIMILARITY = 0.8
SEGMENTS, BITS = 50, 31               # of the SimHash
AT_ONCE = 2                           # segments whose keys are shuffled together
LANES = -(-SEGMENTS * BITS // 64)
FAR = SEGMENTS * BITS // 4            # 15 % are expected at a similarity of 0.8, 19 % for sets of four and five shingles
FEW = 4
CHUNK = 4096
WORD = byte_table(21)
_lane = mix(np.arange(101, 101 + LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text shorter than a shingle is one, no words none."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offs, WHITE)
    values = span_hashes(low, starts, ends, WORD)
    hashes = window_hashes(values, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(hashes[a:b - width + 1]) if b - a >= width else window_hashes(values[a:b], max(1, b - a))


def sketch(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, one number for each segment."""
    counts = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(found), CHUNK):
        bits = np.unpackbits(mix(found[k:k + CHUNK, None] ^ _lane).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return (2 * counts > len(found))[:SEGMENTS * BITS].reshape(SEGMENTS, BITS) @ (1 << np.arange(BITS))


def _lists(values: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)).cast(kind))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            names, sizes, prints = [], [], []
            for found in shingle_sets(data, offs, width):
                names.append(blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                prints.append(sketch(found))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()),
                                              _lists(prints, pa.int32())], ["row", "set", "size", "print"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(list(shingle_sets(data, offs, width)))], ["id", "found"])
    return run


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Settled: uid, row (all columns of docs), set (128-bit name of its shingle set), size of the set and print."""
    return settle(packed(docs).mapInArrow(_sketches(width), with_row(
        docs, ("set", T.BinaryType()), ("size", T.LongType()), ("print", T.ArrayType(T.IntegerType()))))
        .withColumn("uid", F.monotonically_increasing_id()))


def _apart(a: str, b: str) -> Column:
    """Differing bits of two prints."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SEGMENTS)), F.lit(0))


def _sizes(a: str, b: str, percent: int) -> Column:
    """Whether sets of two sizes can have the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _alike(texts: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct pairs a, b whose sets have a similarity of `percent` or more, settled.

    Sets go to the pairs' second members, which are many, and then meet those of the first, which are few."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("id").alias(name), F.col("size").alias(f"size_{name}"), F.col("print").alias(f"print_{name}"))

    close = settle(pairs.join(side("a"), "a").join(side("b"), "b")
                   .filter(_sizes("size_a", "size_b", percent) & (_apart("print_a", "print_b") <= FAR)).select("a", "b"))
    ends = settle(close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()
                  .join(classes.select("id", "uid"), "id"))
    sets = settle(texts.join(ends, "uid").select("id", "text").mapInArrow(_sets(width), "id long, found array<long>"))
    both = F.size(F.array_intersect("found_a", "found_b")).cast("long")
    total = F.size("found_a") + F.size("found_b")
    links = settle(sets.select(F.col("id").alias("b"), F.col("found").alias("found_b")).join(close, "b")
                   .join(sets.select(F.col("id").alias("a"), F.col("found").alias("found_a")), "a")
                   .filter(100 * both >= percent * (total - both)).select("a", "b"))
    discard(close, ends, sets)
    return links


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label; ids that are missing are their own) after links a, b, settled."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(joined).toDF("id", "now")
    old = labels.join(moved.select(F.col("id").alias("label"), "now"), "label", "left").select("id", F.coalesce("now", "label").alias("label"))
    out = settle(old.union(moved.join(labels, "id", "left_anti").select("id", "now")))
    discard(labels)
    return out


def buckets(classes: DataFrame) -> list[DataFrame]:
    """Settled: of classes (id, print), key, id and lead, the smallest id of the key, of all ids but the leads that share
    a key with another. A key is a variant of a segment, so each pair within one bit in some segment shares one."""
    out, one = [], F.lit(1).cast("long")
    for first in range(0, SEGMENTS, AT_ONCE):
        cut = classes.select("id", F.posexplode(F.slice("print", first + 1, AT_ONCE)).alias("k", "bits"))
        tried = cut.select("id", "k", F.col("bits").cast("long").alias("bits"), F.explode(F.lit(list(range(-1, BITS)))).alias("i"))
        variant = F.when(F.col("i") < 0, F.col("bits")).when(
            F.getbit("bits", F.greatest("i", F.lit(0))) == 1, F.col("bits") - F.call_function("shiftleft", one, F.col("i")))
        held = tried.select(((F.col("k") + first).cast("long") * (1 << BITS) + variant).alias("key"), "id").filter("key IS NOT NULL")
        leads = settle(held.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "lead"))
        out.append(settle(held.join(leads, "key").filter("id <> lead").select("key", "id", "lead")))
        discard(leads)
    return out


def similar_groups(rows: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """As `_groups`; of the tables settled on the way only the result stays."""
    with settled_tables() as used:
        out = _groups(rows, width, similarity)
    discard(*(t for t in list(used) if t is not out))
    return out


def _different(marked: DataFrame) -> DataFrame:
    """The keys with members of several labels, one key for all that have the same members."""
    name = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in range(2)]
    found = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), *name)
    return found.filter("low < high").groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key")


def _groups(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of sketched rows: uid and label, the same for all sets that links of the similarity or more reach, settled.

    A set is compared by the text of one row that has it. Equal sets are one node; an empty table gives no labels."""
    percent = round(100 * similarity)
    texts = rows.select("uid", F.col("row.text").alias("text"))
    named = F.first(F.struct("uid", "size", "print")).alias("c")
    classes = settle(rows.groupBy("set").agg(named).select("set", "c.*").withColumn("id", F.monotonically_increasing_id()))
    tables = buckets(classes.filter(F.col("size") * 100 >= percent * (F.col("size") + 1)))    # n of n + 1 shingles is the most
    members = functools.reduce(DataFrame.union, tables)
    star = _alike(texts, classes, members.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), width, percent)
    labels = settle(components(star).toDF("id", "label"))
    left = settle(members.select("key", "id"))
    discard(star, *tables)
    for few in (FEW, None):
        marked = left.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        parted = _different(marked)
        open_ = settle(marked.join(parted, "key", "left_semi").join(classes.select("id", "size", "print"), "id"))
        discard(left)
        if open_.isEmpty():
            break
        turn = open_
        if few:
            often = open_.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
            rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "id"))
            turn = settle(open_.join(often, ["key", "label"]).withColumn("rank", rank).filter(F.col("rank") <= few).drop("n", "rank"))
        other = turn.select("key", *(F.col(c).alias(f"{c}_b") for c in ("id", "size", "print", "label")))
        near = ((F.col("label") != F.col("label_b")) & _sizes("size", "size_b", percent) & (_apart("print", "print_b") <= FAR)
                & (F.lit(True) if few else F.col("id") < F.col("id_b")))
        pairs = (open_.join(other.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & near)
                 .select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct())
        links = _alike(texts, classes, pairs, width, percent)
        if not links.isEmpty():
            labels = _relabelled(labels, links)
        left = settle(open_.join(turn.select("key", "id"), ["key", "id"], "left_anti").select("key", "id"))
        discard(open_, links)
    known = classes.select("set", "id").join(labels, "id", "left").select("set", F.coalesce("label", "id").alias("label"))
    return settle(rows.select("uid", "set").join(known, "set").select("uid", "label"))
