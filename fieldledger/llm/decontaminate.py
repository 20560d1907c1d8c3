"""Benchmark passages in documents, by winnowing.

Of every run of GUARANTEE - GRAM + 1 word n-grams the one with the smallest hash (the first of equals) is
kept. Texts that share GUARANTEE words share such a run, hence its fingerprint. Fingerprints of documents
and items are joined; hits are extended to the windows around them, whose 128-bit hashes are joined again.
Items shorter than the guarantee are looked up by the hash of all runs of their length.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (LOWER, NOT_ALNUM, blocks, byte_table, discard, packed, settle, settled_tables, span_hashes,
                     text_key, window_hashes, words)

WIDTH = 13
GRAM = 5
FIRST, SECOND, PRINT = byte_table(61), byte_table(62), byte_table(63)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    n, span = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span:width - span + n])


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash, the first of equals, of each run of `width`."""
    low = sliding_min(hashes, width)
    if not len(low):
        return np.zeros(0, np.int64)
    places, at = [], np.arange(len(low))
    left = np.full(len(low), True)
    for k in range(width):
        now = left & (hashes[at + k] == low)
        places.append(at[now] + k)
        left &= ~now
    return np.unique(np.concatenate(places))


def _fits(bounds: np.ndarray, width: int) -> np.ndarray:
    n = max(0, int(bounds[-1]) - width + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    return np.arange(n) + width <= bounds[1:][row]


def _block(data: np.ndarray, offs: np.ndarray):
    data = LOWER[data]
    starts, ends, bounds = words(data, offs, NOT_ALNUM)
    return (lambda table: span_hashes(data, starts, ends, table)), bounds


def _prints(values: np.ndarray, bounds: np.ndarray, short: list[int], width: int, gram: int) -> list[np.ndarray]:
    """The distinct fingerprints of each row: winnowed n-grams, and all runs of the short lengths."""
    grams = window_hashes(values, gram)
    runs = {m: window_hashes(values, m) + np.uint64(m) for m in short}
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = grams[a:max(a, b - gram + 1)]
        found = [own[winnow(own, width - gram + 1)]]
        found += [runs[m][a:max(a, b - m + 1)] for m in short]
        out.append(np.unique(np.concatenate(found)).view(np.int64))
    return out


def _emit_prints(short: list[int], width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            hashed, bounds = _block(data, offs)
            found = _prints(hashed(PRINT), bounds, short, width, gram)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            prints = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(bounds).astype(np.int64)), prints],
                ["doc_id", "key", "n_words", "prints"])
    return run


def _emit_items(width: int, gram: int):
    """Of each item: its name, the hashes of its windows with their width, and its fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            hashed, bounds = _block(data, offs)
            first, second, one = hashed(FIRST), hashed(SECOND), hashed(PRINT)
            out = []
            for name, a, b in zip(batch.column("name").to_pylist(), bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                n = int(min(width, b - a))
                local = np.array([0, b - a])
                prints = _prints(one[a:b], local, [n] if n < width else [], width, gram)[0]
                out.append((name, n, window_hashes(first[a:b], n).view(np.int64),
                            window_hashes(second[a:b], n).view(np.int64), prints))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1], pa.int64())]
                    + [pa.array(c, pa.list_(pa.int64())) for c in cols[2:]], ["name", "width", "h1", "h2", "prints"])
    return run


def _extend(short: list[int], width: int, gram: int):
    """The windows of a document that hold one of its matched fingerprints: hashes, width and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            hashed, bounds = _block(data, offs)
            first, second, one = hashed(FIRST), hashed(SECOND), hashed(PRINT)
            seen = batch.column("prints").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at, wide = [], []
            grams = np.flatnonzero(np.isin(window_hashes(one, gram), seen))
            if len(grams):
                fits = _fits(bounds, width)
                own = np.unique(np.concatenate([grams - k for k in range(width - gram + 1)]))
                own = own[(own >= 0) & (own < len(fits))]
                own = own[fits[own]]
                at.append(own)
                wide.append(np.full(len(own), width))
            for m in short:
                own = np.flatnonzero(_fits(bounds, m) & np.isin(window_hashes(one, m) + np.uint64(m), seen))
                at.append(own)
                wide.append(np.full(len(own), m))
            if not at or not sum(map(len, at)):
                continue
            hashes = [np.concatenate([window_hashes(values, int(w[0]) if len(w) else 1)[p] for p, w in zip(at, wide)])
                      for values in (first, second)]
            at, wide = np.concatenate(at), np.concatenate(wide)
            row = np.searchsorted(bounds, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), *(pa.array(h.view(np.int64)) for h in hashes),
                 pa.array(wide.astype(np.int64)), pa.array((at - bounds[:-1][row]).astype(np.int64))],
                ["key", "h1", "h2", "width", "place"])
    return run


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM, part: int = 20) -> DataFrame:
    """Columns doc_id, n_words, n_hit, items (names in order), n_items and contaminated for each row of docs.

    A word is hit if it lies in a place where the words of an item's window occur: any `width` consecutive
    words of the item, or all of them if it has fewer. `contaminated` is true if a hit exists and hits make
    up at least one word in `part`. Texts without words, null ones too, hit nothing and are hit by nothing.
    An item is named by its item_id as text, a null one by the empty string; equal names count once.
    Repeated documents are repeated in the result; other columns are ignored; without items nothing is hit.
    """
    bench = settle(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
                   .mapInArrow(_emit_items(width, gram), "name string, width long, h1 array<long>, h2 array<long>, "
                                                         "prints array<long>"))
    short = sorted(r["width"] for r in bench.select("width").filter(F.col("width") < width).distinct().collect())
    keyed = docs.select("doc_id", F.substring(text_key(F.col("text")), 1, 16).alias("key"), "text")
    base = settle(keyed.mapInArrow(_emit_prints(short, width, gram),
                                   f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, key binary, "
                                   "n_words long, prints array<long>"))
    known = settle(bench.select(F.explode("prints").alias("print")).distinct())
    marked = settle(base.select("key", F.explode("prints").alias("print")).join(known, "print", "left_semi")
                    .groupBy("key").agg(F.collect_set("print").alias("prints")))
    found = settle(keyed.select("key", "text").join(marked, "key").dropDuplicates(["key"])
                   .mapInArrow(_extend(short, width, gram), "key binary, h1 long, h2 long, width long, place long"))
    discard(known, marked)
    windows = bench.select("name", "width", F.explode(F.arrays_zip("h1", "h2")).alias("h")) \
        .select("name", "width", "h.h1", "h.h2").distinct()
    on = ["h1", "h2", "width"]
    covered = (found.join(windows.select(*on).distinct(), on, "left_semi").groupBy("key")
               .agg(F.collect_set(F.struct("place", "width")).alias("runs"))
               .select("key", F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(
                   r["place"], r["place"] + r["width"] - 1))))).cast("long").alias("n_hit")))
    named = (found.select("key", *on).distinct().join(windows, on).groupBy("key")
             .agg(F.array_sort(F.collect_set("name")).alias("items")))
    hits = settle(covered.join(named, "key"))
    discard(bench, found)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (base.select("doc_id", "key", "n_words").join(hits, "key", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    ((n_hit > 0) & (n_hit * part >= F.col("n_words"))).alias("contaminated")))


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose text is not contaminated, with their columns unchanged.

    The keys of contaminated texts are settled first, so that Spark knows their size: where they are few, the rows
    stay where they are. Null texts have no words and stay; an empty table gives an empty one."""
    rows = packed(docs)
    key = F.substring(text_key(F.col("text")), 1, 16)
    with settled_tables() as used:
        bad = settle(contamination(rows.select(key.alias("doc_id"), "text"), items)
                     .filter("contaminated").select(F.col("doc_id").alias("key")).distinct())
    discard(*(t for t in list(used) if t is not bad))
    return rows.join(bad, key == F.col("key"), "left_anti").select("row.*")
