"""Periodic runs of words, found by string synchronising sets.

At the scale t = 4, 8, 16, ... a text's t-word windows get exact names (two names of the half width make one),
and a position is synchronising if the smallest hashed name of the windows at x .. x + t stands at x or at x + t.
Whether it is depends on the 2t words from x only, so equal contexts agree on it. Windows whose own period is a
third of t or less are left out of the minimum; what remains leaves no stretch of t positions empty, and equal
contexts are more than t / 3 apart, so a position has few partners. A run of period q with 3t <= q < 6t either
holds two equal contexts q words apart, which propose q, or its first q words are highly periodic; then it lies
across two touching regions of one smaller period, and their phases give q. Periods below 12 are found directly,
by comparing the words q apart. Every equality is one of words or of exact names; hashes only select.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cover_runs, mix, window_hashes

SCALE = 4                       # the first scale; shorter periods than 3 * SCALE are compared directly
FAR = 9                         # a region this many periods long can hide the synchronising positions of a run
NONE = np.iinfo(np.uint64).max
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]          # start, end, period


def word_ids(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the texts, equal for equal words, and for each text the index of its first word."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    flat, offs = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(real)])[offs - offs[0]]
    ids = pc.dictionary_encode(flat.filter(pa.array(real))).indices
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of consecutive numbers in a sorted array."""
    cut = np.flatnonzero(np.diff(true) != 1)
    return (true[np.concatenate([[0], cut + 1])], true[np.concatenate([cut, [len(true) - 1]])] + 1) if len(true) \
        else (true, true)


def short_periods(salted: np.ndarray, below: int) -> Runs:
    """Every maximal stretch with a period under `below`, at least two periods and four words long."""
    found = []
    for q in range(1, min(below, len(salted))):
        a, b = stretches(np.flatnonzero(salted[q:] == salted[:-q]))
        long = b - a + q >= max(2 * q, SCALE)
        found.append((a[long], b[long] + q, np.full(int(long.sum()), q)))
    return smallest([np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ()))])


def smallest(runs) -> Runs:
    """One run for each stretch: that with the smallest period. Larger ones are its multiples."""
    a, b, q = (np.asarray(c, np.int64) for c in runs)
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], q[first]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values that fits."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class _Names:
    """Exact names of the windows of 1, 2, 4, ... words. A window across the end of a text equals no other."""

    def __init__(self, salted: np.ndarray):
        self.levels = [np.unique(salted, return_inverse=True)[1].astype(np.int64)]

    def grow(self) -> np.ndarray:
        last, half = self.levels[-1], 1 << (len(self.levels) - 1)
        if len(last) <= half:
            self.levels.append(last[:0])
        else:
            pair = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        return self.levels[-1]

    def ahead(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on, `room` at most."""
        return self._extend(x, y, room, 1)

    def back(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The same for the words before x and before y."""
        return self._extend(x, y, room, -1)

    def _extend(self, x, y, room, way):
        got = np.zeros(len(x), np.int64)
        top = len(self.levels) - 1
        for level in range(top, -1, -1):
            names, size = self.levels[level], 1 << level
            live = np.arange(len(x))
            while len(live):                       # once or twice a level below the top
                live = live[got[live] + size <= room[live]]
                step = got[live] if way > 0 else -got[live] - size
                live = live[names[x[live] + step] == names[y[live] + step]]
                got[live] += size
        return got


def _proposals(names: _Names, level: int, bounds: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, period) of equal synchronising contexts between 3 and 6 scales apart."""
    t = 1 << level
    own, context = names.levels[level], names.levels[level + 1]
    hashes = mix(own.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    a, b, q = runs
    hidden = (3 * q <= t) & (b - a >= t)
    if hidden.any():
        steps = np.zeros(len(own) + 1, np.int64)
        np.add.at(steps, a[hidden], 1)
        np.add.at(steps, np.minimum(b[hidden] - t + 1, len(own)), -1)
        hashes[np.cumsum(steps)[:-1] > 0] = NONE
    low = window_min(hashes, t + 1)[:len(context)]
    chosen = np.flatnonzero((low != NONE) & ((hashes[:len(low)] == low) | (hashes[t:t + len(low)] == low)))
    row = np.searchsorted(bounds, chosen, "right") - 1
    chosen = chosen[chosen + 2 * t <= bounds[row + 1]]
    chosen = chosen[np.argsort(context[chosen], kind="stable")]
    label, at, periods = context[chosen], [], []
    for k in range(1, len(chosen)):
        gap = chosen[k:] - chosen[:-k]
        near = (label[k:] == label[:-k]) & (gap < 6 * t)
        if not near.any():
            break
        fits = near & (gap >= 3 * t)
        at.append(chosen[:-k][fits])
        periods.append(gap[fits])
    return (np.concatenate(at), np.concatenate(periods)) if at else (chosen[:0], chosen[:0])


def _grown(names: _Names, at: np.ndarray, q: np.ndarray, width: int, bounds: np.ndarray) -> Runs:
    """The maximal stretches around proposed pairs whose `width` words are equal q apart.

    Pairs of one period are linked from left to right first, so that a long run is walked once."""
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    row = np.searchsorted(bounds, at, "right") - 1
    last = bounds[row + 1] - q                              # an equal stretch ends here at the latest
    follow = np.full(len(at), np.iinfo(np.int64).max)
    same = (q[1:] == q[:-1]) & (row[1:] == row[:-1])
    follow[:-1][same] = at[1:][same]
    end = at + width
    end = end + names.ahead(end, end + q, np.maximum(np.minimum(last, follow) - end, 0))
    linked = end >= follow
    head = np.flatnonzero(np.concatenate([[True], ~linked[:-1]]))
    tail = np.flatnonzero(~linked)
    start = at[head] - names.back(at[head], at[head] + q[head], at[head] - bounds[row[head]])
    end = np.maximum.reduceat(end, head)
    return start, end + q[tail], q[tail]


def _across(salted: np.ndarray, runs: Runs) -> Runs:
    """Runs across two touching regions of one period p, for periods of at least FAR * p.

    The regions share fewer than p words. A period q fits if it carries the phase of the one to the other; the run
    is then as long as both regions, shifted by q, allow."""
    a, b, p = runs
    long = b - a >= FAR * p
    a, b, p = a[long], b[long], p[long]
    order = np.lexsort((a, p))
    a, b, p = a[order], b[order], p[order]
    found = [np.zeros((3, 0), np.int64)]
    touch = np.flatnonzero((p[1:] == p[:-1]) & (a[1:] <= b[:-1]) & (b[:-1] < a[1:] + p[1:]) & (p[1:] > 1))
    for k in touch.tolist():
        size, root = int(p[k]), salted[b[k] - p[k]:b[k]]
        start, top = int(a[k + 1]), int(min(b[k] - a[k], b[k + 1] - a[k + 1], (b[k + 1] - a[k]) // 2))
        where = np.flatnonzero(salted[start:start + size] == root[0])
        shift = next((int(w) for w in where if (salted[start + w:start + w + size] == root).all()), None)
        if shift is None:
            continue
        q = np.arange((start + shift - int(b[k])) % size, top + 1, size)
        q = q[q >= FAR * size]
        i, j = np.maximum(a[k], a[k + 1] - q), np.minimum(b[k] + q, b[k + 1])
        whole = j - i >= 2 * q
        i, j, q = i[whole], j[whole], q[whole]
        # Where both regions end q apart the next words may agree too: such a run has its own equal contexts.
        left = (i > 0) & (salted[i - 1] == salted[i + q - 1])
        right = (j < len(salted)) & (salted[np.minimum(j, len(salted) - 1)] == salted[j - q])
        found.append(np.stack([i, j, q])[:, ~left & ~right])
    return tuple(np.concatenate(found, axis=1))


def _join(*parts) -> Runs:
    return smallest([np.concatenate(c) for c in zip(*parts)])


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = 12) -> Runs:
    """All maximal runs of the texts: start, end and smallest period q; end - start >= max(least, 2q)."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    width = int(ids.max()) + 1 if len(ids) else 1
    salted = row * width + ids
    runs = short_periods(salted, 3 * SCALE)
    # A run of a longer period repeats its first 2 * SCALE words: texts without any such repeat are done.
    windows = window_hashes(mix(salted.astype(np.uint64)), 2 * SCALE)
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    more = np.zeros(len(n), bool)
    more[row[order[1:][same]]] = True
    more &= n >= 6 * SCALE
    if more.any():
        keep = more[row]
        shift = (np.cumsum(keep) - keep)              # place among the words kept
        back = np.flatnonzero(keep)
        inside = keep[np.minimum(runs[0], len(keep) - 1)]
        few = tuple(c[inside] for c in runs)
        length = few[1] - few[0]
        few = (shift[few[0]], shift[few[0]] + length, few[2])
        few = _long_periods(salted[keep], np.concatenate([[0], np.cumsum(n[more])]), few)
        length = few[1] - few[0]
        start = back[few[0]]
        runs = _join(tuple(c[~inside] for c in runs), (start, start + length, few[2]))
    a, b, q = runs
    long = b - a >= np.maximum(least, 2 * q)
    return a[long], b[long], q[long]


def _long_periods(salted: np.ndarray, bounds: np.ndarray, runs: Runs) -> Runs:
    names = _Names(salted)
    level = SCALE.bit_length() - 1
    for _ in range(level):
        names.grow()
    while 6 << level <= int(np.diff(bounds).max()):
        context = names.grow()
        if not len(context) or int(context.max()) + 1 == len(context):        # nothing repeats at this width
            break
        at, q = _proposals(names, level, bounds, runs)
        if len(at):
            a, b, p = _grown(names, at, q, 2 << level, bounds)
            whole = b - a >= 2 * p
            runs = _join(runs, (a[whole], b[whole], p[whole]))
        level += 1
    return _join(runs, _across(salted, runs))


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def tail_order(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) of the contract's rewritten texts: from word a on, p words repeat. None: the text stays."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _emit(rewrite: bool, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in blocks(batches):
            ids, bounds = word_ids(batch.column("text"))
            order = np.arange(len(ids))
            changed = set()
            if rewrite:
                for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                    first, n = int(bounds[k]), int(bounds[k + 1] - bounds[k])
                    if (tail := tail_order(doc, n)) is not None:
                        a, p = tail
                        order[first + a:first + n] = first + a + np.arange(n - a) % p
                        changed.add(k)
            start, end, period = runs_of(ids[order], bounds, least)
            drop = cover_runs(start + period, end - start - period, len(ids))
            row = np.searchsorted(bounds, start, "right") - 1
            # the longest run of a text; ties: smallest start, then smallest period
            best = np.lexsort((period, start, -(end - start), row))
            head = {int(row[i]): i for i in best[::-1]}
            sorted_runs = np.lexsort((period, start, row))
            parts = np.searchsorted(row[sorted_runs], np.arange(batch.num_rows + 1))
            out = []
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                first, last = int(bounds[k]), int(bounds[k + 1])
                mine = sorted_runs[parts[k]:parts[k + 1]]
                s = (start[mine] - first).tolist()
                length, q = (end[mine] - start[mine]).tolist(), period[mine].tolist()
                words = (text or b"").split()
                if k in changed or len(mine):
                    left = (order[first:last] - first)[~drop[first:last]].tolist()
                    words = [words[i] for i in left]
                top = head.get(k)
                big = (None,) * 4 if top is None else (
                    int(start[top]) - first, int(end[top] - start[top]), int(period[top]),
                    1000 * int(end[top] - start[top]) // int(period[top]))
                listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, length, q)).encode()
                out.append((len(s), *big, _digest(listed), b" ".join(words).decode(), list(zip(s, length, q))))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), kind]
            cols = list(zip(*out))
            cols[7] = [[dict(zip(("start", "length", "period"), r)) for r in c] for c in cols[7]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", *FIELDS])
    return run


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "runs"]


def periodic_runs(docs: DataFrame, least: int = 12, rewrite_tails: bool = False) -> DataFrame:
    """All periodic runs of words of each whole text, and the text with each run cut to its first period.

    A run is a stretch of at least `least` words and two periods, q its smallest period, that no neighbouring word
    extends. Returns one row for each row of docs: doc_id, n_runs, the longest run (ties: smallest start, then
    period) as start, length, period and exponent_milli, runs_sha256 over the sorted list, collapsed (kept words
    joined by a space) and runs (start, length, period). With `rewrite_tails` the words from some place on are first
    replaced by repeats, for a tenth of the ids, chosen by crc32 of the id.

    A text is worked on by itself, in memory of some hundred bytes a word: no rows meet, so copies and hot keys cost
    nothing extra. Null, empty and blank texts have no words and no run; a null doc_id stays null and is never
    rewritten; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    fields = ", ".join(["doc_id long", *(f"{c} long" for c in FIELDS[:5]), "runs_sha256 string", "collapsed string",
                        "runs array<struct<start: long, length: long, period: long>>"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_emit(rewrite_tails, least), fields))
