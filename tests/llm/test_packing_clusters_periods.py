"""Packing, exact clusters and periodic runs against brute force."""
from __future__ import annotations

import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fieldledger.llm import periods as R
from fieldledger.llm.clusters import candidates, centroid_clusters, hilbert_keys
from fieldledger.llm.packing import WordEncoder, best_fit, packed_sequences, padded_sequences
from fieldledger.llm.periods import periodic_runs, runs_of

WORDS_49K = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, length long, ids string, part int, `a.b` int, row string"
WHITE = " \t\n\x0b\x0c\r"


def prose(rng, n, words=40):
    return " ".join(f"word{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [(k, prose(rng, rng.randint(0, 300))) for k in range(120)]
    same = prose(rng, 150)
    texts += [(200 + k, same) for k in range(60)]                      # a hot length
    texts += [(300, prose(rng, 9000)), (301, ""), (302, None), (None, "a b"), (None, None), (300, "again"), (303, " \n\t "),
              (304, "É́ straße 中文 x<|endoftext|>y 0 00 1x0 don't\x1c!? İ"), (305, "aa bb " * 700), (306, prose(rng, 20) + "\n" + "x " * 40)]
    return [(i, t, "en", 1, "z", 2, 3, "r") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def test_words_are_encoded_as_in_their_text(rows):
    texts = [t for _, t, *_ in rows]
    plain, encode = Tokenizer.from_file(WORDS_49K), WordEncoder(WORDS_49K, 1)
    for part in (texts, texts[::-1], []):
        ids, offs = encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [
            plain.encode(t or "", add_special_tokens=False).ids + [1] for t in part]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_that_of_single_pieces(seed):
    rng, size = random.Random(seed), 64
    lengths = Counter(rng.choice([rng.randint(1, 64), 40, 9]) for _ in range(rng.randint(0, 400)))
    plan, used = best_fit(lengths, size)
    free: list[int] = []                                              # one window at a time
    for n in sorted(lengths.elements(), reverse=True):
        fits = [k for k, c in enumerate(free) if c >= n]
        k = min(fits, key=lambda w: free[w]) if fits else len(free)
        if not fits:
            free.append(size)
        free[k] -= n
    filled = Counter()
    for length, n in lengths.items():
        entries = [p for p in plan.tolist() if p[0] == length]
        for rank in range(n):
            _, first_rank, window, each, offset = [p for p in entries if p[1] <= rank][-1]
            k, slot = divmod(rank - first_rank, each)
            filled[window + k] += length
            assert offset + (slot + 1) * length <= size
    assert used == len(free) and sorted(filled.values()) == sorted(size - c for c in free)


def test_packing(spark, docs, rows):
    plain = Tokenizer.from_file(WORDS_49K)
    got = packed_sequences(docs, WORDS_49K).collect()
    want = Counter((i, *plain.encode(t or "", add_special_tokens=False).ids, 1) for i, t, *_ in rows)
    whole, windows = Counter(), {}
    by_doc: dict = {}
    for r in got:
        ids = struct.unpack(f"<{r.length}I", bytes(r.ids))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and 0 < r.length <= 2048
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    for (doc, n), parts in by_doc.items():
        starts = Counter(s for s, _ in parts)
        if len(set(starts.values())) == 1 and starts[0] == 1:
            joined = tuple(itertools.chain.from_iterable(p for _, p in sorted(parts)))
            assert len(joined) == n
            whole[(doc, *joined)] += 1
        else:                                                         # rows with one id and length
            whole.update((doc, *p) for _, p in parts)
    assert whole == want
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(windows) == list(range(len(windows)))
    assert len(windows) <= sum(r.length for r in got) / 2048 * 1.05 + 1
    assert packed_sequences(docs.limit(0), WORDS_49K).count() == 0


def test_padded_sequences(spark):
    pieces = spark.createDataFrame([(0, 0, 3, b"a" * 12), (0, 3, 2, b"b" * 8), (1, 0, 4, b"c" * 16)],
                                   "sequence_id long, offset long, length long, ids binary")
    got = {r.sequence_id: r for r in padded_sequences(pieces, 8).collect()}
    assert bytes(got[0].ids) == b"a" * 12 + b"b" * 8 + bytes(12) and got[0].padded_length == 8
    assert bytes(got[1].ids) == b"c" * 16 and got[1].padded_length == 4
    assert padded_sequences(pieces.limit(0)).count() == 0


# ---------------------------------------------------------------- clusters

@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 3), (3, 2), (4, 2)])
def test_the_curve_steps_to_a_neighbour(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hilbert_keys(grid, bits)]
    path = grid[np.argsort(keys)]
    assert len(set(keys)) == len(grid)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_keep_every_nearest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        centers, points = rng.integers(-9, 9, (6, 3)), rng.integers(-9, 9, 3) + rng.integers(-2, 3, (5, 3))
        kept = set(candidates(points.min(axis=0), points.max(axis=0), centers).tolist())
        distance = ((points[:, None] - centers) ** 2).sum(axis=2)
        for row in distance:
            assert set(np.flatnonzero(row == row.min()).tolist()) <= kept


def plain_clusters(vectors, k, rounds, dims, scale, seed):
    units = [(i, [int(np.floor(scale * float(x))) for x in e]) for i, e in vectors
             if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted(units, key=lambda u: (u[0] is None, hashlib.sha256(f"{seed}:{u[0]}".encode()).hexdigest(), u[1]))
    centers = [c for _, c in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in units:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centers[j] = [sum(col) // len(vs) for col in zip(*vs)]
    rows = [(i, *nearest(v)[::-1]) for i, v in units]
    part = Counter()
    for _, c, d in rows:
        part[c] += d
    return Counter((i, c, d, part[c], sum(part.values()), tuple(centers[c])) for i, c, d in rows)


@pytest.mark.parametrize(("scale", "k", "block"), [(1024, 8, 16), (1, 5, 512), (1 << 40, 3, 7)])
def test_clusters(spark, scale, k, block):
    rng, dims = random.Random(4), 4
    vectors = [(i, [rng.gauss(c, 0.4) for c in rng.choice([(0, 0, 1, 5), (3, 1, -2, 0), (-4, 2, 0, 0)])]) for i in range(150)]
    vectors += [(500 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(80)]                      # one vector, very common
    vectors += [(7, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0, 4.0]), (900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]),
                (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in vectors],
                               "vec_id long, embedding array<double>, cluster int, place string").repartition(6)
    if scale == 1 << 40:                                             # beyond 64 bits: an error, not a wrong figure
        with pytest.raises(Exception, match="OverflowError"):
            centroid_clusters(df, k, 2, dims, scale, 3, block)
        return
    got = centroid_clusters(df, k, 10, dims, scale, 3, block)
    want = plain_clusters(vectors, k, 10, dims, scale, 3)
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got.collect()) == want
    few = centroid_clusters(df.filter("vec_id < 3"), k, 10, dims, scale)
    assert few.count() == 3 and few.filter("distance <> 0").count() == 0
    assert centroid_clusters(df.limit(0)).count() == 0


# ---------------------------------------------------------------- periods

def plain_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def strange(rng):
    n, kind = rng.randint(0, 260), rng.randrange(7)
    if kind < 2:
        return [rng.randrange((2, 9)[kind]) for _ in range(n)]
    if kind == 2:
        return [bin(i).count("1") % 2 for i in range(n)]
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:
        u = ([rng.randrange(2) for _ in range(rng.randint(1, 6))] * 12)[:rng.randint(1, 40)]
        t = (u * 20)[:n]
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = rng.randrange(3)
        return t
    if kind == 5:                                       # regions of one root that touch
        p = [rng.randrange(2) for _ in range(rng.randint(2, 4))]
        s = rng.randrange(len(p))
        return ((p * 60)[:rng.randint(10, 120)] + ((p[s:] + p[:s]) * 60)[:rng.randint(10, 120)]) * rng.randint(1, 3)
    u = [rng.randrange(50) for _ in range(rng.randint(1, 90))]
    return [rng.randrange(50) for _ in range(rng.randint(0, 40))] + (u * 9)[:n] + [rng.randrange(50) for _ in range(10)]


def assert_runs(texts, least):
    bounds = np.cumsum([0, *map(len, texts)])
    got = sorted(zip(*(c.tolist() for c in runs_of(np.array(sum(texts, []), np.int64), bounds, least))))
    assert got == [(x + int(f), y + int(f), q) for t, f in zip(texts, bounds) for x, y, q in plain_runs(t, least)]


def test_runs():
    rng = random.Random(2)
    for _ in range(80):
        assert_runs([strange(rng) for _ in range(12)], rng.choice([4, 12]))


def test_runs_of_all_short_texts(monkeypatch):
    for scale in (1, 2):                                # small scales bring the whole method to short texts
        monkeypatch.setattr(R, "SCALE", scale)
        assert_runs([list(t) for t in itertools.product((0, 1), repeat=14)], 4)


def test_periodic_runs(docs, rows):
    want = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w, 12)
        gone = {k for a, b, q in runs for k in range(a + q, b)}
        best = min(((a - b, a, q) for a, b, q in runs), default=None)
        top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want[i, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(),
             b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    got = periodic_runs(docs, rewrite_tails=True).collect()
    assert Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed) for r in got) == want
    assert all(len(r.runs) == r.n_runs for r in got)
    assert periodic_runs(docs.limit(0)).count() == 0
