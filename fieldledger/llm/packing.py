"""Token sequences of one length, packed best-fit decreasing.

Texts are encoded once; a document longer than a sequence is first cut into full windows, and what is left over is at
most a window long. So there are no more different lengths than tokens in a window, and the packing is decided on their
histogram: lengths go in from the longest, and a segment tree over the remaining capacities finds the tightest open
windows. Windows that hold the same lengths are handled together as one run, which makes the plan as small for 10^12
pieces as for 10^6: a length splits or opens three runs at most, and a run takes in fewer than 64 different lengths,
so it has under 400,000 entries. A piece finds its place from its length and its rank among the pieces of that length;
ranks are counted within each task and offset by the counts of the tasks before.
"""
from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, settle

WINDOW = 2048
CACHED_WORDS = 1_000_000         # words remembered by a Python worker

# ---------------------------------------------------------------- encoding


class WordEncoder:
    """Ids of texts by a tokenizer that never joins words across white space.

    A word's ids do not depend on its neighbours, so each different word is encoded once and remembered. Words new to a
    block are encoded as long texts: words of letters are cut where a piece closes a word, the others at a mark between
    them that they do not contain. Where the number of cuts is not that of words, each word is encoded by itself."""

    MARK = "0"

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"            # the cores belong to Spark's tasks
        from tokenizers import Tokenizer
        self.tokenizer, self.end = Tokenizer.from_file(path), end
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last, self.mark = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        if suffix:
            self.last[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark[mark] = len(mark) == 1
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.size, self.ids = [np.ones(1, np.int64)], [np.array([self.end], np.uint32)]
        self.slots = 1                                            # slot 0 is the end of a text

    def _encode(self, words: list[str], between: str, closes: np.ndarray, keep: bool) -> bool:
        """Encodes words as long texts and cuts the ids after those that close a word; False if the counts differ."""
        parts = [between.join([*words[k:k + 1000], ""]) for k in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.uint32)
                              for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        ends = np.flatnonzero(closes[ids])
        if len(ends) != len(words):
            return False
        self._remember(words, np.diff(ends, prepend=-1) - (not keep), ids if keep else ids[~closes[ids]])
        return True

    def _remember(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.slot.update(zip(words, range(self.slots, self.slots + len(words))))
        self.size, self.ids, self.slots = [*self.size, size], [*self.ids, ids], self.slots + len(words)

    def _slots(self, words: list[str]) -> np.ndarray:
        if self.slots > CACHED_WORDS:
            self._forget()
        new = [w for w in words if w not in self.slot]
        plain = [w for w in new if w.isalpha()]
        other = [w for w in new if not w.isalpha()]
        marked = [w for w in other if self.MARK not in w]
        if plain and not (self.last.any() and self._encode(plain, " ", self.last, True)):
            marked += plain
        if marked and not (self.mark.any() and self._encode(marked, f" {self.MARK} ", self.mark, False)):
            other += [w for w in plain if w not in self.slot]
        single = [w for w in other if w not in self.slot]
        if single:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)]
            self._remember(single, np.fromiter(map(len, lists), np.int64, len(lists)),
                           np.fromiter(itertools.chain.from_iterable(lists), np.uint32))
        self.size, self.ids = [np.concatenate(self.size)], [np.concatenate(self.ids)]
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by the end id, and the offsets of the texts."""
        lists = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
        flat, offs = lists.flatten(), lists.offsets.to_numpy()
        coded = pc.dictionary_encode(flat)
        slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        word = np.insert(slots, offs[1:] - offs[0], 0)
        size, values = self.size[0], self.ids[0]
        ends = np.cumsum(size[word])
        total = int(ends[-1]) if len(ends) else 0
        first = np.cumsum(size) - size
        out = values[np.repeat(first[word] - (ends - size[word]), size[word]) + np.arange(total)]
        last = offs[1:] - offs[0] + np.arange(len(offs) - 1)      # where each text's end stands among the words
        return out, np.concatenate([[0], ends[last]])


@functools.lru_cache(maxsize=1)
def encoder(path: str, end: int) -> WordEncoder:
    """Kept by a Python worker for its next tasks."""
    return WordEncoder(path, end)


def _cut(path: str, end: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, end), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)                     # pieces of each length so far in this task
        for batch, _, _ in blocks(batches, BLOCK_BYTES * 4):
            ids, offs = encode(batch.column("text"))
            tokens = np.diff(offs)
            pieces = -(-tokens // window)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * window
            length = np.minimum(tokens[doc] - start, window)
            order = np.argsort(length, kind="stable")
            same = np.searchsorted(length[order], length[order])  # the first of each length
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - same + seen[length[order]]
            seen += np.bincount(length, minlength=window + 1)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (offs[doc] + start) * 4
            cut = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length),
                 pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(tokens[doc]),
                 pa.array([bytes(c) for c in cut], pa.binary()), pa.array(np.full(len(doc), part)), pa.array(rank)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "rank"])
    return run


# ---------------------------------------------------------------- best fit

class OpenWindows:
    """Runs of open windows by remaining capacity, and a segment tree that finds the smallest sufficient one."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        k = self.leaves + capacity
        self.any[k] = bool(self.runs[capacity])
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        """`count` windows from number `first` on."""
        if capacity and count:
            self.runs[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least `size` with an open window."""
        k = self.leaves + size
        while not self.any[k]:
            while k & 1:                       # a right child: go up past its parent
                k //= 2
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:               # beyond the last leaf of the level
                return None
        while k < self.leaves:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """The plan of best-fit decreasing for `histogram` (length: pieces), and the number of windows used.

    A row of the plan, sorted by length and rank: length, first rank, first window, pieces of this length that each
    window takes, offset of the first of them."""
    opened, used, plan = OpenWindows(window), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = opened.tightest(length)
            if capacity is None:
                capacity, each = window, window // length
                first, count = used, -(-left // each)
                used += count
            else:
                each = capacity // length
                first, count = opened.take(capacity)
            full = min(count, left // each)                   # windows that take as many as fit
            rest = min(left - full * each, each - 1) if full < count else 0
            plan.append((length, rank, first, each, window - capacity))
            opened.add(capacity - each * length, first, full)
            if rest:
                opened.add(capacity - rest * length, first + full, 1)
            opened.add(capacity, first + full + bool(rest), count - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return np.array(sorted(plan), np.int64).reshape(-1, 5), used


def _placed(plan: np.ndarray) -> Callable[[Column, Column], Column]:
    """Column function (length, rank) -> sequence_id and offset."""
    wide = int(plan[:, 1].max(initial=0)).bit_length() + 1
    keys = (plan[:, 0] << wide) + plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, k = length.to_numpy(), rank.to_numpy()
        # a rank above every first rank of its length belongs to the last entry of the length
        row = plan[np.searchsorted(keys, (size << wide) + np.minimum(k, (1 << wide) - 1), "right") - 1]
        k = k - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + k // row[:, 3], "offset": row[:, 4] + k % row[:, 3] * size})
    return place


# ---------------------------------------------------------------- operators

def packed_sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = 1) -> DataFrame:
    """Every document's ids, closed by id `end`, cut into pieces and packed into sequences of at most `window` ids.

    Returns for each piece doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, ids (unsigned
    32-bit little-endian), sequence_id and offset (gapless from 0 within its sequence). `tokenizer` is a file that the
    `tokenizers` library reads, and executors find; its words must not cross white space. A document longer than the
    window gives full windows and one remainder; a piece is otherwise never cut.

    Null, empty and blank texts are the end id alone. Documents are rows: repeated ids and texts are packed each for
    itself; a null doc_id stays null. Other columns are ignored. An empty table gives an empty one.
    """
    pieces = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut(tokenizer, end, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                      "ids binary, part long, rank long"))
    counts = settle(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())          # `window` rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = _placed(best_fit(histogram, window)[0])
    return (pieces.join(bases, ["length", "part"])
            .withColumn("at", place(F.col("length"), F.col("base") + F.col("rank")))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "at.sequence_id", "at.offset"))


def padded_sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The sequences of `packed_sequences`, one row each: sequence_id, n_tokens, padded_length and ids (unsigned 32-bit
    little-endian). They are padded to the window, but for those whose length is a power of two, which stay.

    A sequence holds at most `window` pieces, so its list is bounded. An empty table gives an empty one."""
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    used = F.col("n_tokens")
    length = F.when(F.bit_count(used) == 1, used).otherwise(F.lit(window)).cast("int")
    return (pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"),
                                              F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", "n_tokens", length.cast("long").alias("padded_length"),
                    F.rpad(joined, length * 4, F.lit(pad.to_bytes(4, "little"))).alias("ids")))
