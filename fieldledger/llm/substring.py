"""Repeated word passages, found by anchors at the positions of a difference cover.

Positions of a text are counted modulo a period, and only those in a difference cover are hashed. For any
two places of a repeated passage some offset below the period brings both onto the cover, so a passage of
period + anchor - 1 words shares an aligned anchor wherever it stands. Anchors seen twice mark the windows
worth extending to the full width; these are hashed whole and counted.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WHITE, blocks, byte_table, cover_runs, discard, distinct_texts, settle, span_hashes, text_key,
                     window_hashes, words)

# Period -> a difference cover of it: every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
FIRST, SECOND, ANCHOR = byte_table(11), byte_table(12), byte_table(13)


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The largest listed period that leaves an anchor of at least two fifths of the window."""
    period = max((p for p in COVERS if 5 * (width - p + 1) >= 2 * width), default=0)
    return (period, COVERS[period]) if period else (1, (0,))


def _word_hashes(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    starts, ends, bounds = words(data, offs, WHITE)
    return span_hashes(data, starts, ends, table), starts, ends, bounds


def _fits(bounds: np.ndarray, width: int) -> np.ndarray:
    """For each window start whether the window stays within its text."""
    n = max(0, int(bounds[-1]) - width + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    return np.arange(n) + width <= bounds[1:][row]


def _anchors(data, offs, width: int):
    """Index of the first word and hash of every anchor of a block."""
    period, cover = cover_for(width)
    size = width - period + 1
    values, _, _, bounds = _word_hashes(data, offs, ANCHOR)
    fits = _fits(bounds, size)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(fits)]
    at = (np.arange(len(fits)) - bounds[:-1][row]) % period
    chosen = np.flatnonzero(fits & np.isin(at, cover))
    return chosen, window_hashes(values, size)[chosen], bounds


def _emit_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            chosen, hashes, bounds = _anchors(data, offs, width)
            row = np.searchsorted(bounds, chosen, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch.column("tid").take(pa.array(row))], ["anchor", "tid"])
    return run


def _emit_windows(width: int):
    """Full-width windows that hold a repeated anchor: two hashes, tid and the window's place in its text."""
    period, _ = cover_for(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            chosen, hashes, bounds = _anchors(data, offs, width)
            seen = batch.column("anchors").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.zeros(int(bounds[-1]) + period + 1, np.int64)
            hit[chosen[np.isin(hashes, seen)] + 1] = 1
            sums = np.cumsum(hit)
            fits = _fits(bounds, width)
            at = np.arange(len(fits))
            at = at[fits & (sums[at + period] > sums[at])]
            if not len(at):
                continue
            row = np.searchsorted(bounds, at, "right") - 1
            cols = [window_hashes(_word_hashes(data, offs, t)[0], width)[at].view(np.int64) for t in (FIRST, SECOND)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, cols), batch.column("tid").take(pa.array(row)),
                 pa.array((at - bounds[:-1][row]).astype(np.int64))], ["h1", "h2", "tid", "place"])
    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            starts, ends, bounds = words(data, offs, WHITE)
            raw, out = memoryview(data), []
            for k, (n, places) in enumerate(zip(batch.column("n").to_pylist(), batch.column("places"))):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if n > 1 and b - a >= width:
                    gone = np.ones(b - a, bool)
                else:
                    at = places.values.to_numpy() if places.is_valid else np.zeros(0, np.int64)
                    gone = cover_runs(at, width, b - a)
                kept = " ".join(str(raw[s:e], "utf-8") for s, e in
                                zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out.append((b - a, int(gone.sum()), kept, edge[::2].tolist(), edge[1::2].tolist()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int64())),
                 pa.array(cols[4], pa.list_(pa.int64()))],
                ["key", "n_words", "n_removed", "kept_text", "span_start", "span_end"])
    return run


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that occur at least twice, settled. Counts are combined before the shuffle, so hot keys stay
    small; and both sides of a later join are then plain shuffles, of which Spark can split a hot partition."""
    return settle(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*key))


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """Cuts every word that lies in a window of `width` words which also starts anywhere else in docs.

    Returns for each row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by a space) and
    the removed runs as span_start, span_end (word positions, end exclusive). All places of a repeated
    passage go, and windows are judged on the input. Null, empty and blank texts have no words; texts
    shorter than the window lose nothing; equal rows repeat each other; a null doc_id is kept as it is.
    Other columns of docs are ignored. An empty table gives an empty one.
    """
    texts = distinct_texts(docs)
    anchors = texts.select("tid", "text").mapInArrow(_emit_anchors(width), "anchor long, tid long")
    shared = repeated(anchors, ["anchor"])
    twice = settle(anchors.join(shared, "anchor", "left_semi")
                   .groupBy("tid").agg(F.collect_set("anchor").alias("anchors")))
    discard(shared)
    windows = (texts.select("tid", "text").join(twice, "tid")
               .mapInArrow(_emit_windows(width), "h1 long, h2 long, tid long, place long"))
    shared = repeated(windows, ["h1", "h2"])
    places = settle(windows.join(shared, ["h1", "h2"], "left_semi")
                    .groupBy("tid").agg(F.array_sort(F.collect_list("place")).alias("places")))
    discard(shared, twice)
    kept = (texts.join(places, "tid", "left").select("key", "text", "n", "places")
            .mapInArrow(_cut(width), "key binary, n_words long, n_removed long, kept_text string, "
                                     "span_start array<long>, span_end array<long>"))
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(kept, "key").drop("key")


