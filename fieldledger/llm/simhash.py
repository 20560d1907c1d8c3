"""Near-duplicates by SimHash: 64-bit fingerprints, found by one-wildcard variants of two segments.

Two fingerprints with three or fewer differing bits have a segment, of two, with at most one. So each
half is indexed as it is, and looked up as it is and with each of its set bits cleared: halves that
differ in one bit meet when the one with the bit set drops it. Equal keys are joined, then the whole
fingerprints are compared.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, as_bytes, components, discard, settle
from .similar import SIMILARITY, WIDTH, similar_groups, sketched

SEED = 42
DISTANCE = 3
HALF = 32
PIECE = 1 << 20
_LOWER = LOWER.tobytes()


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece, so that only one piece is split at a time."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end:end + 1].strip():
            end += 1
        yield text[at:end].translate(_LOWER).split()
        at = end


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit by bit majority of the hashes of all word shingles; 0 for a text without words."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for found in pieces(text):
        found = tail + found
        hashes = np.fromiter((xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(found[k:] for k in range(width)))),
                             np.uint64)
        counts += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"),
                                axis=0, dtype=np.int64)
        total += len(hashes)
        tail = found[max(0, len(found) - width + 1):]
    if not total:
        return xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = as_bytes(batch.column("text"))
        raw = memoryview(data)
        prints = np.array([fingerprint(bytes(raw[a:b])) for a, b in zip(offs[:-1], offs[1:])], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (64 bits as a long) of each row; null and empty texts have print 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, print long")


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links a, b of different prints (column print, each once) at most `distance` (0 to 3) bits apart."""
    def half(k: int):
        return F.shiftrightunsigned(F.col("print"), HALF * k).bitwiseAND(F.lit((1 << HALF) - 1))

    def keyed(values):
        return F.array(*(F.struct(F.lit(k).alias("half"), values(half(k)).alias("bits")) for k in range(2)))

    def variants(bits):
        cleared = F.transform(F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)),
                                       lambda i: F.getbit(bits, i) == 1),
                              lambda i: bits - F.call_function("shiftleft", F.lit(1).cast("long"), i))
        return F.concat(F.array(bits), cleared)

    index = prints.select(F.col("print").alias("b"), F.explode(keyed(lambda bits: bits)).alias("k")) \
        .select("b", "k.half", "k.bits")
    look = prints.select(F.col("print").alias("a"), F.explode(keyed(variants)).alias("k")) \
        .select("a", "k.half", F.posexplode("k.bits").alias("variant", "bits"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = (F.col("variant") > 0) | (F.col("a") < F.col("b"))
    # merged, never broadcast: Spark sizes the variants, some thirty rows a print, like the prints themselves
    return look.join(index.hint("merge"), ["half", "bits"]).filter(near & once & (F.col("a") != F.col("b"))).select("a", "b")


def groups(rows: DataFrame) -> DataFrame:
    """Of settled rows (doc_id, print): print, its first doc_id and rows n_same, label (the same for all prints
    of a group), component_id and n_links."""
    classes = settle(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")))
    links = settle(near_links(classes.select("print")))
    degree = (links.select("a", "b").union(links.select("b", "a")).toDF("print", "other")
              .groupBy("print").agg(F.countDistinct("other").alias("n_links")))
    known = (classes.join(components(links).withColumnRenamed("node", "print"), "print", "left")
             .withColumn("label", F.coalesce("label", "print")).join(degree, "print", "left")
             .withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))))
    return known.join(known.groupBy("label").agg(F.min("first").alias("component_id")), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits), component_id, n_same and n_links for each row of docs.

    component_id is the smallest doc_id that links of three or fewer bits reach, its own included.
    n_same counts the rows with the same print, n_links the different prints next to it. Texts that are
    null, empty or blank share print 0. Rows with a null doc_id take part and never name a component,
    unless all its rows have none (then it is null). Repeated rows are kept. Other columns are ignored.
    Equal prints are one node, so a group of copies costs one row; each link of different prints is a row.
    """
    rows = settle(fingerprints(docs))
    return (rows.join(groups(rows), "print")
            .select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id",
                    "n_same", "n_links"))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of `similarity` or more between their sets of
    `width`-word shingles, with the columns of docs: that of the smallest doc_id (nulls last), of equal ids that of
    the smallest text hash. Texts without words are one group. Groups are settled on numbers; whole rows meet only the
    list of rows to drop. An empty table gives an empty one."""
    rows = sketched(docs, width)
    labels = similar_groups(rows, width, similarity)
    doc = F.col("row.doc_id").cast("long")
    order = F.struct(doc.isNull().alias("none"), doc.alias("doc"), F.xxhash64("row.text").alias("text"), "uid")
    first = (rows.select("uid", order.alias("o")).join(labels, "uid").groupBy("label").agg(F.min("o").alias("o"))
             .select(F.col("o.uid").alias("uid")))
    gone = settle(labels.select("uid").join(first, "uid", "left_anti"))
    discard(labels)
    return rows.join(gone, "uid", "left_anti").select("row.*")
