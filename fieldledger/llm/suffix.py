"""Repeated byte passages by longest-previous-factor arrays over suffix order.

Equal passages must meet before their suffixes can be sorted side by side. Each window of `width` bytes
picks the n-gram with the smallest hash, so equal windows pick equal n-grams (anchors). Neighbouring windows
with one anchor form a segment. Anchors of a single text are dropped at once; of equal segments the one of the
smallest document stands for all. The different segments of an anchor are sorted as suffixes in one block,
and previous and next smaller documents in suffix order give each place its longest earlier match.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, as_bytes, blocks, byte_table, cover_runs, discard, distinct_texts, mix, powers, prefix_sums, settle, text_key
from .decontaminate import sliding_min

WIDTH = 50
GRAM = 24
PLACE_BITS = 30
BLOCK = 2 << 20               # segment bytes sorted at once
SMALL = 1 << 17                # text bytes hashed at once
PARTS = 1 << 12               # parts that anchors are dealt into, by their low bits
MEET = 1 << 20                # anchors of whole parts compared at once
MANY = 10_000                 # segments of one anchor beyond which its windows are compared one by one
GRAMS, FIRST, SECOND = byte_table(101), byte_table(102), byte_table(103)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    sums = prefix_sums(table[data])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """spans_hash of the `gram` bytes at every place, without gathers."""
    sums = prefix_sums(GRAMS[data])
    n = len(data) - gram + 1
    return mix((sums[gram:] - sums[:n]) * powers(n)[1] + np.uint64(gram))


def segments(data: np.ndarray, offs: np.ndarray, width: int, gram: int):
    """Of a block: row, first window, number of windows and anchor hash of every segment."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    low = sliding_min((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), width - gram + 1)
    last = offs[1:] - width                                        # last window of each row, if it has any
    row = np.flatnonzero(last >= offs[:-1])
    begins = np.zeros(len(low), bool)
    begins[1:] = low[1:] != low[:-1]
    begins[offs[:-1][row]] = True
    start = np.flatnonzero(begins)
    own = np.searchsorted(offs, start, "right") - 1
    fits = start <= last[own]
    end = np.minimum(np.append(start[1:], len(low)), last[own] + 1)[fits]
    own, start = own[fits], start[fits]
    return own, start, end - start, hashes[(low[start] & mask).astype(np.int64)]


def _emit_anchors(width: int, gram: int):
    """The anchors of the texts of a batch, each once for a text, with the texts: packed by the low bits of the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for batch, data, offs in blocks(iter([whole]), SMALL):
                row, _, _, anchor = segments(data, offs, width, gram)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                found.append((anchor[new], batch.column("tid").to_numpy()[row[new]]))
            anchor, tid = map(np.concatenate, zip(*found))
            part = (anchor & np.uint64(PARTS - 1)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            part = part[order]
            new = np.flatnonzero(np.diff(part, prepend=-1))
            offsets = pa.py_buffer((np.append(new, len(part)) * 8).astype(np.int32))
            lists = [pa.Array.from_buffers(pa.binary(), len(new), [None, offsets, pa.py_buffer(x[order])]) for x in (anchor, tid)]
            yield pa.RecordBatch.from_arrays([pa.array(part[new].astype(np.int32)), *lists], ["part", "anchors", "tids"])
    return run


def _meet(limit: int):
    """Of whole parts, in order: the anchors that two texts have or more, with each of these texts."""
    def solve(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        anchor, tid = map(np.concatenate, zip(*held))
        order = np.argsort(anchor)
        anchor = anchor[order]
        same = anchor[1:] == anchor[:-1]
        twice = np.append(same, False)
        twice[1:] |= same
        return pa.RecordBatch.from_arrays([pa.array(anchor[twice]), pa.array(tid[order[twice]])], ["anchor", "tid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            part = batch.column("part").to_numpy()
            lists = [as_bytes(batch.column(c)) for c in ("anchors", "tids")]
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if size >= limit and part[i] != at:
                    yield solve(held)
                    held, size = [], 0
                held.append(tuple(np.frombuffer(data[offs[i]:offs[j]].tobytes(), np.int64) for data, offs in lists))
                size, at = size + len(held[-1][0]), part[i]
        if held:
            yield solve(held)
    return run


def _emit_segments(width: int, gram: int):
    """The segments whose anchor other texts have too: anchor, content hashes, place and number of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, SMALL):
            row, start, windows, anchor = segments(data, offs, width, gram)
            seen = batch.column("anchors").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            k = np.flatnonzero(np.isin(anchor, seen))
            row, start, windows = row[k], start[k], windows[k]
            cols = [spans_hash(data, start, start + windows + width - 1, t).view(np.int64) for t in (FIRST, SECOND)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[k].view(np.int64)), *map(pa.array, cols),
                 batch.column("first").take(pa.array(row)), batch.column("tid").take(pa.array(row)),
                 pa.array((start - offs[:-1][row]).astype(np.int64)), pa.array(windows.astype(np.int64))],
                ["anchor", "s1", "s2", "ord", "tid", "place", "windows"])
    return run


def _slice(width: int):
    """The bytes of chosen segments of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            raw, out = memoryview(data), []
            for k, parts in enumerate(batch.column("parts").to_pylist()):
                a = int(offs[k])
                out += [(p["anchor"], p["s1"], p["s2"], p["ord"], p["n"],
                         bytes(raw[a + p["place"]:a + p["place"] + p["windows"] + width - 1])) for p in parts]
            for i in range(0, len(out), 20_000):
                cols = list(zip(*out[i:i + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:5]]
                                                 + [pa.array(cols[5], pa.binary())], ["anchor", "s1", "s2", "ord", "n", "bytes"])
    return run


def suffix_order(data: np.ndarray, places: np.ndarray, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The places sorted by their next `depth` bytes (a multiple of eight; earlier places first among
    equals), and the common prefix of each with the one before it, up to `depth`. Bytes are compared
    eight at a time, as numbers; zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
    eight = padded[:len(data) + depth]
    for k in range(1, 8):
        eight = (eight << np.uint64(8)) | padded[k:k + len(eight)]
    columns = [eight[places + k] for k in range(0, depth, 8)]
    order = np.lexsort(columns[::-1])
    lcp, on = np.zeros(max(0, len(order) - 1), np.int64), np.arange(max(0, len(order) - 1))
    for column in columns:
        apart = column[order[on]] ^ column[order[on + 1]]
        same = apart == 0
        lcp[on[same]] += 8
        for k in range(1, 8):
            lcp[on[~same]] += apart[~same] < np.uint64(1 << (64 - 8 * k))
        on = on[same]
    return places[order], np.concatenate([[0], lcp])[:len(order)]


def nearest_smaller(values: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Length shared with the nearest earlier entry that has a smaller value; 0 if there is none.

    lcp[i] is what entries i-1 and i share. Pointers jump over entries that are not smaller, and carry the
    least length on the way. An entry that has arrived is not looked at again.
    """
    to = np.arange(-1, len(values) - 1)
    shared = lcp.copy()
    on = np.arange(len(values))
    while True:
        on = on[(to[on] >= 0) & (shared[on] > 0)]
        on = on[values[to[on]] >= values[on]]
        if not len(on):
            break
        at = to[on]
        shared[on] = np.minimum(shared[on], shared[at])
        to[on] = to[at]
    return np.where(to >= 0, shared, 0)


def longest_earlier(order_of: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each entry in suffix order: the better of previous and next smaller."""
    back = nearest_smaller(order_of[::-1], np.concatenate([[0], lcp[1:][::-1]]))[::-1]
    return np.maximum(nearest_smaller(order_of, lcp), back)


def earlier_windows(texts: list[bytes], order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a text with a smaller order has too: text, first window, number of windows."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    places = np.flatnonzero(np.arange(len(data)) + width <= ends[owner])
    sa, lcp = suffix_order(data, places, -(-width // 8) * 8)
    found = np.sort(sa[longest_earlier(order[owner[sa]], lcp) >= width])
    own = owner[found]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(found) > 1) | (np.diff(own) > 0)]))[:len(found)]
    return own[new], (found - (ends - sizes)[own])[new], np.diff(np.append(new, len(found)))


def _match(width: int, block: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        text, at, windows = earlier_windows([r[4] for r in rows], np.array([r[3] for r in rows], np.int64), width)
        ends = [np.array([r[k] for r in rows], np.int64)[text] for k in (1, 2)]
        return pa.RecordBatch.from_arrays([*map(pa.array, (*ends, at, windows))], ["s1", "s2", "at", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "s1", "s2", "ord", "bytes"))):
                if held >= block and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield solve(rows)
    return run


def _windows(width: int):
    """Every window of every segment by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                part = batch.slice(row, 1000)
                sizes = np.array([len(b.as_py()) for b in part.column("bytes")])
                data = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.cumsum(sizes) - sizes
                at = np.flatnonzero(np.arange(len(data)) + width <= (starts + sizes)[owner])
                take = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(spans_hash(data, at, at + width, t).view(np.int64)) for t in (FIRST, SECOND)),
                     *(part.column(c).take(take) for c in ("ord", "s1", "s2")), pa.array(at - starts[owner[at]])],
                    ["w1", "w2", "ord", "s1", "s2", "at"])
    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            out = []
            for k, places in enumerate(batch.column("places")):
                text = data[offs[k]:offs[k + 1]]
                at, windows = ((x.to_numpy() for x in places.values.flatten()) if places.is_valid
                               else np.zeros((2, 0), np.int64))
                gone = cover_runs(at, windows + width - 1, len(text))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out.append((len(text), int(gone.sum()), text[~gone].tobytes(), edge[::2].tolist(), edge[1::2].tolist()))
            cols = list(zip(*out))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("first"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.binary()), pa.array(cols[3], longs), pa.array(cols[4], longs)],
                ["key", "first", "n_bytes", "n_removed", "kept", "span_start", "span_end"])
    return run


def remove_later_copies(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK,
                        many: int = MANY, meet: int = MEET) -> DataFrame:
    """Cuts every byte of a text covered by a `width`-byte string that also starts in a document of smaller doc_id.

    Returns for each row of docs: doc_id, n_bytes, n_removed, kept (the remaining bytes) and the removed runs
    as span_start, span_end. Strings are judged on the input; the document with the smallest id keeps its
    copy, and so do rows tied on it. Null texts are empty; texts shorter than `width` lose nothing; a null
    doc_id is larger than every other, and such rows keep what only they share. Other columns are ignored.

    An anchor with more than `many` different segments is not sorted in one block: the windows of its
    segments are counted one by one over the cluster, with the same result.
    """
    texts = distinct_texts(docs)
    anchors = texts.select("tid", "text").mapInArrow(_emit_anchors(width, gram), "part int, anchors binary, tids binary")
    shared = (anchors.repartition("part").sortWithinPartitions("part")
              .mapInArrow(_meet(meet), "anchor long, tid long"))
    twice = settle(shared.groupBy("tid").agg(F.collect_list("anchor").alias("anchors")))
    found = settle(texts.select("tid", "text", "first").join(twice, "tid").mapInArrow(
        _emit_segments(width, gram), "anchor long, s1 long, s2 long, ord long, tid long, place long, windows long"))
    discard(twice)
    leads = settle(found.groupBy("s1", "s2").agg(F.min(F.struct("ord", "tid", "place", "windows", "anchor")).alias("f"),
                                                 F.count(F.lit(1)).alias("times")).select("s1", "s2", "times", "f.*"))
    sizes = leads.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chosen = leads.join(sizes, "anchor").select("tid", F.struct("anchor", "s1", "s2", "ord", "place", "windows", "n").alias("p"))
    listed = settle(chosen.groupBy("tid").agg(F.collect_list("p").alias("parts")))
    pieces = settle(texts.select("tid", "text").join(listed, "tid").mapInArrow(
        _slice(width), "anchor long, s1 long, s2 long, ord long, n long, bytes binary"))
    sorted_ = (pieces.filter(F.col("n") <= many).repartition("anchor").sortWithinPartitions("anchor", "ord")
               .mapInArrow(_match(width, block), "s1 long, s2 long, at long, windows long"))
    single = pieces.filter(F.col("n") > many).mapInArrow(
        _windows(width), "w1 long, w2 long, ord long, s1 long, s2 long, at long")
    low = single.groupBy("w1", "w2").agg(F.min("ord").alias("low"))
    counted = single.join(low, ["w1", "w2"]).filter("ord > low").select("s1", "s2", "at", F.lit(1).cast("long"))
    gone = settle(sorted_.union(counted))
    discard(listed, pieces)
    runs = gone.groupBy("s1", "s2").agg(F.collect_list(F.struct("at", "windows")).alias("runs"))
    known = settle(leads.select("s1", "s2", "times", F.col("ord").alias("lead")).join(runs, ["s1", "s2"], "left")
                   .filter("times > 1 OR runs IS NOT NULL").drop("times"))
    discard(leads, gone)
    # a later copy of a segment goes whole; its first text loses what earlier texts have in other segments
    cut = F.when(F.col("ord") > F.col("lead"), F.array(F.struct("place", "windows"))).otherwise(F.transform(
        "runs", lambda r: F.struct((F.col("place") + r["at"]).alias("place"), r["windows"].alias("windows"))))
    places = settle(found.join(known, ["s1", "s2"]).select("tid", F.explode(cut).alias("c")).groupBy("tid")
                    .agg(F.collect_list("c").alias("places")))
    discard(found, known)
    kept = (texts.select("tid", "key", "first", "text").join(places, "tid", "left").select("key", "first", "text", "places")
            .mapInArrow(_cut(width), "key binary, first long, n_bytes long, n_removed long, kept binary, "
                                     "span_start array<long>, span_end array<long>"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(kept, "key")
    copy = (F.coalesce("doc_id", F.lit(LAST_ID)) > F.col("first")) & (F.col("n_bytes") >= width)
    return rows.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
                       F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
                       F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.col("span_start")).alias("span_start"),
                       F.when(copy, F.array("n_bytes")).otherwise(F.col("span_end")).alias("span_end"))
