"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

A text's segmentations form a lattice; each is as likely as the product of its pieces' weights. Top-down
Gumbel search (A* over regions of the lattice): the best perturbed segmentation is drawn forwards with
conditional weights, and all others fall into regions "same pieces up to here, then another one", each with
its own perturbed maximum below that of its parent. The region with the largest maximum gives the next,
distinct segmentation and is split in turn. All randomness is a hash of the row key and the place.

Pieces hold a space at their start or are all spaces, so a text's lattice is a chain of lattices of units
(spaces and the word after them). Units are compiled once for a worker, all new ones of a block together.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, powers, prefix_sums

UNIT = re.compile(" *[^ ]+| +")
SPACE = "▁"
ZIPF = 20.0
ALPHA = 0.5
SAMPLES = 2
KEEP_NODES = 3_000_000          # nodes of compiled units a worker keeps before it starts anew
BLOCK = 512 << 10
SLOT_BITS = 20
STRIDE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a model file with their weights: the logarithm of a Zipf law over ids, times alpha."""

    def __init__(self, model_file: str, alpha: float = ALPHA):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int64)
        spelled: list[tuple[str, int]] = []
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                spelled.append((piece.replace(SPACE, " "), k))
                self.bytes_of[k] = spelled[-1][0].encode()
        if any(" " in text.lstrip(" ") for text, _ in spelled):
            raise ValueError("pieces across spaces are not supported")
        self.weight = -alpha * np.log(np.arange(size) + ZIPF)
        self.byte_weight = -alpha * np.log(size + ZIPF)
        self.longest = max(len(text) for text, _ in spelled)
        texts = [text for text, _ in spelled]
        codes, ends = code_points(texts), np.cumsum([len(t) for t in texts])
        starts = ends - np.array([len(t) for t in texts])
        sums = prefix_sums(mix(codes.astype(np.uint64) + np.uint64(1)))
        hashes = mix((sums[ends] - sums[starts]) * powers(len(codes) + 1)[1][starts])
        self.hashes, self.ids = hashes, np.array([k for _, k in spelled])
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = []                              # tables of one entry a slot; entries that collide go to the next
        left = np.arange(len(hashes))
        while len(left):
            own, at = np.unique(slot[left], return_index=True)
            table = np.full(1 << SLOT_BITS, -1, np.int32)
            table[own] = left[at]
            self.slots.append(table)
            left = np.delete(left, at)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and the ids of these."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        places, ids = [], []
        at = np.arange(len(hashes))
        for table in self.slots:
            entry = table[slot[at]]
            at, entry = at[entry >= 0], entry[entry >= 0]
            hit = self.hashes[entry] == hashes[at]
            places.append(at[hit])
            ids.append(self.ids[entry[hit]])
            at = at[~hit]
        return np.concatenate(places), np.concatenate(ids)

    def decode(self, ids) -> bytes:
        """The text of piece ids, without the space put before it."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


class Column:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(2 * need, self.data.dtype)
            grown[:self.size] = self.data[:self.size]
            self.data = grown
        self.data[self.size:need] = values
        self.size = need


class Units:
    """Compiled lattices. Node v of a unit has edges first[v] to first[v + 1], the longest first, each with its
    conditional probability, the running sum of these, its length in nodes and its piece (or -1 - character)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.columns = {"start": Column(np.int64), "end": Column(np.int64), "first": Column(np.int64),
                        "prob": Column(np.float64), "upto": Column(np.float32), "step": Column(np.int8),
                        "piece": Column(np.int32)}
        self.columns["first"].add(np.zeros(1, np.int64))
        self.view()

    def view(self) -> None:
        self.__dict__.update({name: column.data[:column.size] for name, column in self.columns.items()})

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.first) > KEEP_NODES:
            self.clear()
        fresh = list(set(tokens).difference(self.number))
        if fresh:
            self.compile(fresh)
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))

    def compile(self, texts: list[str]) -> None:
        """Adds units: finds their pieces by hash, sums weights from the ends backwards, in log space."""
        voc, shift, wide = self.vocabulary, len(self.first) - 1, self.vocabulary.longest
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = code_points(texts)
        sums, inverse = prefix_sums(mix(codes.astype(np.uint64) + np.uint64(1))), powers(len(codes) + 1)[1]
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        edges, weight = [], np.full((len(codes), wide), -np.inf)
        for n in range(1, wide + 1):
            at = np.flatnonzero(left >= n)
            hit, ids = voc.find(mix((sums[at + n] - sums[at]) * inverse[at]))
            src, w = at[hit], voc.weight[ids]
            if n == 1:                                                   # characters without a piece are spelled in bytes
                known = np.zeros(len(codes), bool)
                known[src] = True
                other = np.flatnonzero(~known)
                src, ids = np.concatenate([src, other]), np.concatenate([ids, -1 - codes[other].astype(np.int64)])
                w = np.concatenate([w, utf8_size(codes[other]) * voc.byte_weight])
            weight[src, n - 1] = w
            edges.append((src, ids, w))
        node = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), sizes)   # a unit has one node more than characters
        total = np.zeros(len(codes) + len(texts) + wide)
        order = np.argsort(left, kind="stable")
        level = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        reach = np.arange(1, wide + 1)
        for d, (a, b) in enumerate(zip(level[:-1], level[1:]), 1):
            now = order[a:b]
            m = min(d, wide)
            value = weight[now, :m] + total[node[now][:, None] + reach[:m]]
            top = value.max(1)
            total[node[now]] = top + np.log(np.exp(value - top[:, None]).sum(1))
        count = np.zeros(len(codes) + len(texts), np.int64)
        for src, _, _ in edges:
            count[node[src]] += 1
        first = np.cumsum(count)
        free, running = first - count, np.zeros(len(count))
        prob, upto = np.zeros(first[-1]), np.zeros(first[-1], np.float32)
        step, piece = np.zeros(first[-1], np.int8), np.zeros(first[-1], np.int32)
        for n in range(wide, 0, -1):
            src, ids, w = edges[n - 1]
            v = node[src]
            to = free[v]
            free[v] += 1
            p = np.exp(w + total[v + n] - total[v])
            running[v] += p
            prob[to], upto[to], step[to], piece[to] = p, running[v] if n > 1 else 2.0, n, ids
        for name, values in (("start", shift + ends - sizes + np.arange(len(texts))),
                             ("end", shift + ends + np.arange(len(texts))), ("first", len(self.prob) + first),
                             ("prob", prob), ("upto", upto), ("step", step), ("piece", piece)):
            self.columns[name].add(values)
        self.view()
        known = len(self.number)
        self.number.update(zip(texts, range(known, known + len(texts))))


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def uniform(keys: np.ndarray, *places) -> np.ndarray:
    """Numbers in (0, 1), a hash of the row keys and places."""
    h = keys
    for k, p in enumerate(places):
        h = mix(h + STRIDE * (np.atleast_1d(p).astype(np.uint64) + np.uint64(k + 1)))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54


def uniform_key(keys: np.ndarray, *places: int) -> np.ndarray:
    for p in places:
        keys = mix(keys + STRIDE * np.array([p + 1], np.uint64))
    return keys


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def below(limit: np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The largest perturbed value of a set with that mass, given that it lies below the limit."""
    with np.errstate(divide="ignore", over="ignore"):
        return -np.logaddexp(-limit, -(log_mass + gumbel(u)))


class Paths:
    """One segmentation of every text of a block: steps in text order (edge, text) and its regions."""

    def __init__(self, edge, row, token, node, rows: int):
        self.edge, self.row, self.token, self.node = edge, row, token, node
        self.bounds = np.searchsorted(row, np.arange(rows + 1))


class Sampler:
    def __init__(self, units: Units, seed: int):
        self.units, self.seed = units, seed

    def walk(self, token, node, unit, keys, place, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draws pieces from a node of each token to the end of its unit: token, node and edge of each step.

        The draws depend on the row key, the token's place in its text, the turn and the way left."""
        u, end, out = self.units, self.units.end[unit], []
        live = np.flatnonzero(node < end)
        token, node, end = token[live], node[live], end[live]
        keys = mix(keys[live] + STRIDE * (place[live].astype(np.uint64) * np.uint64(64) + np.uint64(turn)))
        while len(token):
            draw = uniform(keys, end - node)
            edge = u.first[node]
            on = np.flatnonzero(u.upto[edge] < draw)
            while len(on):
                edge[on] += 1
                on = on[u.upto[edge[on]] < draw[on]]
            out.append((token, node, edge))
            node = node + u.step[edge]
            live = np.flatnonzero(node < end)
            token, node, keys, end = token[live], node[live], keys[live], end[live]
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        token, node, edge = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(token, kind="stable")
        return token[order], node[order], edge[order]

    def regions(self, path: Paths, since: np.ndarray, limit: np.ndarray, keys: np.ndarray, turn: int):
        """The perturbed maxima of "another piece here" for the steps from since[row] on, and path log weights."""
        p = self.units.prob[path.edge]
        log_p = np.log(p)
        run = np.cumsum(log_p)
        base = np.concatenate([[0.0], run])[path.bounds[:-1]]
        before = run - log_p - base[path.row]
        place = np.arange(len(p)) - path.bounds[path.row]
        on = np.flatnonzero((place >= since[path.row]) & (p < 1.0))
        row = path.row[on]
        top = np.full(len(p), -np.inf)
        top[on] = below(limit[row], before[on] + np.log1p(-p[on]), uniform(uniform_key(keys, turn, 7)[row], place[on]))
        total = np.concatenate([[0.0], run])[path.bounds[1:]] - base
        return top, before, total

    def sample(self, unit: np.ndarray, bounds: np.ndarray, keys: np.ndarray, samples: int):
        """Up to `samples` distinct segmentations of each text, likeliest perturbed first.

        unit: unit numbers of all texts; bounds: where each text starts. Yields paths with the texts that
        have one, their log weights and perturbed values, and at last the values that were not reached.
        """
        u, rows = self.units, len(bounds) - 1
        row_of = np.repeat(np.arange(rows), np.diff(bounds))
        place = np.arange(len(unit)) - bounds[row_of]
        token, node, edge = self.walk(np.arange(len(unit)), u.start[unit], unit, keys[row_of], place, 0)
        value = gumbel(uniform(keys, 0, 0, 3))
        path = Paths(edge, row_of[token], token, node, rows)
        top, before, total = self.regions(path, np.zeros(rows, np.int64), value, keys, 0)
        held = [(path, top, before)]
        barred: list[dict[int, set[int]]] = [{}]
        yield path, np.ones(rows, bool), total, value
        for turn in range(1, samples + 1):
            best = np.full(rows, -np.inf)
            which, at = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for k, (path, top, _) in enumerate(held):
                for row in np.flatnonzero(np.diff(path.bounds)):
                    a, b = path.bounds[row], path.bounds[row + 1]
                    j = int(np.argmax(top[a:b]))
                    if top[a + j] > best[row]:
                        best[row], which[row], at[row] = top[a + j], k, j
            value = best
            if turn == samples:
                yield None, np.isfinite(best), best, best
                return
            live = np.flatnonzero(np.isfinite(best))
            heads, tokens, nodes = [], [], []
            for row in live:
                path, top, before = held[which[row]]
                j = path.bounds[row] + at[row]
                v = int(path.node[j])
                out = barred[which[row]].setdefault(int(j), {int(path.edge[j])})
                edges = np.array([e for e in range(u.first[v], u.first[v + 1]) if e not in out])
                p = u.prob[edges]
                draw = uniform(keys[row:row + 1], turn, at[row], 5)[0] * p.sum()
                e = int(edges[min(len(edges) - 1, np.searchsorted(np.cumsum(p), draw))])
                out.add(e)
                rest = p.sum() - u.prob[e]
                if len(edges) > 1 and rest > 0:
                    top[j] = below(best[row:row + 1], before[j] + np.log([rest]),
                                   uniform(keys[row:row + 1], turn, at[row], 9))[0]
                else:
                    top[j] = -np.inf
                t = int(path.token[j])
                heads.append((path.bounds[row], j, t, v, e))
                tokens.append(np.arange(t, bounds[row + 1]))
                nodes.append(np.concatenate([[v + int(u.step[e])], u.start[unit[t + 1:bounds[row + 1]]]]))
            if not len(live):
                none = np.zeros(0, np.int64)
                held.append((Paths(none, none, none, none, rows), np.zeros(0), np.zeros(0)))
                barred.append({})
                yield held[-1][0], np.zeros(rows, bool), np.zeros(rows), value
                continue
            tokens, nodes = np.concatenate(tokens), np.concatenate(nodes)
            token, node, edge = self.walk(tokens, nodes, unit[tokens], keys[row_of[tokens]],
                                          place[tokens], turn)
            cut = np.searchsorted(token, bounds[live])
            cut_end = np.searchsorted(token, bounds[live + 1])
            parts = []
            for k, row in enumerate(live):
                path = held[which[row]][0]
                a, j, t, v, e = heads[k]
                parts.append((np.concatenate([path.token[a:j], [t], token[cut[k]:cut_end[k]]]),
                              np.concatenate([path.node[a:j], [v], node[cut[k]:cut_end[k]]]),
                              np.concatenate([path.edge[a:j], [e], edge[cut[k]:cut_end[k]]])))
            token, node, edge = (np.concatenate(x) for x in zip(*parts))
            path = Paths(edge, row_of[token], token, node, rows)
            since = np.zeros(rows, np.int64)
            since[live] = at[live] + 1
            top, before, total = self.regions(path, since, np.where(np.isfinite(best), best, 0.0), keys, turn)
            held.append((path, top, before))
            barred.append({})
            yield path, np.isfinite(best), total, value

    def ids(self, path: Paths) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts of a path, and where each text starts; characters without a piece as bytes."""
        found = self.units.piece[path.edge]
        spelled = np.flatnonzero(found < 0)
        if not len(spelled):
            return found, path.bounds
        codes, which = np.unique(-1 - found[spelled], return_inverse=True)
        parts = [self.units.vocabulary.byte_id[list(chr(c).encode())] for c in codes.tolist()]
        count = np.ones(len(found), np.int64)
        count[spelled] = np.array([len(x) for x in parts])[which]
        out = np.repeat(found, count)
        out[np.repeat(found < 0, count)] = np.concatenate([parts[k] for k in which.tolist()])
        return out, np.concatenate([[0], np.cumsum(count)])[path.bounds]


KIND = "struct<ids:array<int>,log_prob:double,score:double,inclusion:double>"


def segment_rows(sampler: Sampler, texts: list[str], keys: np.ndarray, samples: int) -> list[list[tuple]]:
    """For each text its segmentations: ids, log probability, perturbed value and inclusion probability.

    Inclusion is the chance of a value above the first one left out, given that value; 1 if none is left.
    """
    found = [UNIT.findall(" " + t) if t else [] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    unit = sampler.units.of([t for f in found for t in f])
    keys = mix(keys + np.uint64(sampler.seed))
    out: list[list[tuple]] = [[] for _ in texts]
    for path, has, total, value in sampler.sample(unit, bounds, keys, samples):
        if path is not None:
            ids, at = sampler.ids(path)
            for row in np.flatnonzero(has):
                out[row].append((ids[at[row]:at[row + 1]], float(total[row]), float(value[row])))
        else:
            for row in range(len(texts)):
                gap = value[row]
                out[row] = [(ids, lp, v, float(-np.expm1(-np.exp(lp - gap))) if has[row] else 1.0)
                            for ids, lp, v in out[row]]
    return out


def _encode(model_file: str, samples: int, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_file, alpha)
        sampler = Sampler(Units(vocabulary), seed)
        kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()),
                                   ("score", pa.float64()), ("inclusion", pa.float64())]))
        for batch, data, offs in blocks(batches, BLOCK):
            raw = bytes(memoryview(data))
            texts = [raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:])]
            keys = batch.column("row_key").to_numpy(zero_copy_only=False).view(np.uint64)
            found = segment_rows(sampler, texts, keys, samples)
            flat = [s for row in found for s in row]
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(s[0]) for s in flat)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(0, np.int32), *(s[0] for s in flat)]).astype(np.int32)))
            values = pa.StructArray.from_arrays(
                [ids, *(pa.array([s[k] for s in flat], pa.float64()) for k in (1, 2, 3))], fields=list(kind.value_type))
            exact = [all(vocabulary.decode(s[0].tolist()) == raw[a:b] for s in row) if b > a else True
                     for row, a, b in zip(found, offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, values),
                                              pa.array(exact, pa.bool_())], ["doc_id", "samples", "exact"])
    return run


def sampled_segmentations(docs: DataFrame, model_file: str, samples: int = SAMPLES, alpha: float = ALPHA,
                          seed: int = 0) -> DataFrame:
    """Columns doc_id, samples and exact of each row of docs with a text.

    samples has up to `samples` distinct segmentations of the whole text, drawn without replacement: ids,
    log_prob, score (perturbed log probability, descending) and inclusion. exact tells that all decode to
    the text. An empty text has one segmentation, of no pieces; a null text gives a null list. Draws depend
    on doc_id, text, alpha and seed only, so repeated rows agree; a null doc_id draws as id 0 does. Every
    text can be encoded: characters without a piece are spelled in bytes. model_file must be readable by
    the executors.
    """
    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))).alias("row_key"))
    kind = given.schema["doc_id"].dataType.simpleString()
    coded = given.filter("text IS NOT NULL").mapInArrow(_encode(model_file, samples, alpha, seed),
                                                        f"doc_id {kind}, samples array<{KIND}>, exact boolean")
    empty = given.filter("text IS NULL").select("doc_id", F.lit(None).cast(f"array<{KIND}>").alias("samples"),
                                                F.lit(True).alias("exact"))
    return coded.union(empty)


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """The rows (doc_id, ids) with their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_file)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids).decode("utf-8", "replace")
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    given = rows.select("doc_id", "ids")
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, text string")
