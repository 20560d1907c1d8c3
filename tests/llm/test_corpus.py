"""The corpus operators against brute force, on small tables with nulls, empties, repeats and clashing columns."""
from __future__ import annotations

import hashlib
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldledger.llm import pieces as P
from fieldledger.llm import similar as M
from fieldledger.llm import simhash as S
from fieldledger.llm import suffix as X
from fieldledger.llm.common import settle
from fieldledger.llm.decontaminate import contamination, keep_uncontaminated, winnow
from fieldledger.llm.licenses import scan, signatures
from fieldledger.llm.lines import line_spread, remove_boilerplate
from fieldledger.llm.quality import quality, text_statistics
from fieldledger.llm.simhash import fingerprint, keep_one, near_duplicates
from fieldledger.llm.substring import COVERS, cover_for, remove_repeats
from fieldledger.llm.suffix import remove_later_copies
from fieldledger.llm.toxicity import held_out, keep_clean, toxicity
from fieldledger.llm.warc import archive_round_trip, read_archives, record_chunks, write_archives

# Extra columns have names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, `a.b` int"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WHITE = re.compile("[^\x20\x09-\x0d]+")
WORDS = [f"w{k:02d}" for k in range(60)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, null and empty texts, null and repeated ids, a very long text."""
    rng = random.Random(seed)
    passage, line = prose(rng, 80), prose(rng, 12)
    texts: list[tuple[int | None, str | None]] = [(k, prose(rng, rng.randint(1, 160))) for k in range(30)]
    texts += [(30 + k, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 5)) for k in range(6)]
    texts += [(40 + k, line + "\n" + prose(rng, 60) + "\n" + line) for k in range(14)]
    texts += [(60, texts[3][1]), (61, texts[3][1]), (3, texts[3][1]), (62, "  \t\n "), (63, ""), (64, None), (None, None),
              (None, passage), (None, texts[5][1]), (65, passage.upper()), (66, "é " * 70 + "ü" * 90),
              (67, "aaaa " * 300), (68, passage + " " + passage), (69, prose(rng, 4000)), (70, "straße ▁ 中文 \U0001f600\r\n x")]
    return [(i, t, None if k % 17 == 0 else "en", None if k % 19 == 0 else f"s{k % 13}", 1, "x", "y", 1)
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_covers_meet_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert cover_for(35) == (21, COVERS[21]) and cover_for(1) == (1, (0,))


@pytest.mark.parametrize("width", [1, 5, 12, 35])
def test_repeats(docs, rows, none, width):
    lists = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[k:k + width]) for _, w in lists for k in range(len(w) - width + 1))
    want = Counter()
    for i, w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = [True] * width
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, width).collect())
    assert got == want
    assert remove_repeats(none, width).count() == 0


@pytest.mark.parametrize(("width", "many"), [(50, 10_000), (50, 1), (24, 10_000)])
def test_later_copies(docs, rows, none, width, many):
    order = lambda i: (1 << 63) - 1 if i is None else i
    first: dict[bytes, int] = {}
    coded = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in coded:
        for k in range(len(b) - width + 1):
            first[b[k:k + width]] = min(order(i), first.get(b[k:k + width], 1 << 63))
    want = Counter()
    for i, b in coded:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k:k + width]] < order(i):
                gone[k:k + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.span_start), bytes(r.kept))
                  for r in remove_later_copies(docs, width, many=many).collect())
    assert got == want
    assert remove_later_copies(none).count() == 0


def test_suffix_order_and_earlier_matches():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)) + b"c" * 90, np.uint8)
    raw = data.tobytes() + b"\0" * 128
    places = np.arange(len(data))
    order, lcp = X.suffix_order(data, places)
    assert [raw[p:p + 64] for p in order] == sorted(raw[p:p + 64] for p in places)
    same = lambda a, b: next((k for k in range(64) if raw[a + k] != raw[b + k]), 64)
    assert lcp.tolist() == [0] + [same(a, b) for a, b in zip(order[:-1], order[1:])]
    best = X.longest_earlier(order, lcp)
    for k, p in enumerate(order):
        assert best[k] == max((same(p, q) for q in range(p)), default=0)


def test_entries_that_arrived_are_not_looked_at_again():
    """A last entry that steps over all others by itself took time that grew with the square of their number."""
    n = 60_000
    values, lcp = np.append(np.arange(n), -1), np.full(n + 1, 50)
    began = time.thread_time()
    assert X.nearest_smaller(values, lcp).tolist() == [0] + [50] * (n - 1) + [0]
    assert time.thread_time() - began < 3


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_packed_anchors_meet(limit):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 5, 9, 60]))) for _ in range(90)] + [b"x" * 300] * 2
    table = pa.table({"tid": pa.array(range(7, 99)), "text": pa.array([t.decode() for t in texts])})
    packed = [b for k in range(0, 92, 23) for b in X._emit_anchors(9, 4)(iter(table.slice(k, 23).to_batches()))]
    assert all(b.num_rows <= X.PARTS and len(set(b.column("part").to_pylist())) == b.num_rows for b in packed)
    rows = pa.Table.from_batches(packed).sort_by("part")
    got = [r for b in X._meet(limit)(iter(rows.to_batches(max_chunksize=11))) for r in zip(*(c.to_pylist() for c in b.columns))]
    owners = {}
    for k, t in enumerate(texts):
        for a in X.segments(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 9, 4)[3].view(np.int64).tolist():
            owners.setdefault(a, set()).add(k + 7)
    assert sorted(got) == sorted((a, k) for a, ks in owners.items() if len(ks) > 1 for k in ks)


def test_variants_of_prints_are_not_broadcast(spark):
    links = S.near_links(settle(spark.createDataFrame([(0,), (1,), (7,), (1 << 40,), (255,)], "print long")))
    assert {frozenset(r) for r in links.collect()} == {
        frozenset(p) for p in [(0, 1), (0, 7), (1, 7), (0, 1 << 40), (1, 1 << 40)]}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates(docs, rows, none):
    def plain(text: str | None) -> int:
        w = (text or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()
        shingles = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [S.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [plain(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (prints[k] ^ prints[j]).bit_count() <= 3) for k in range(len(rows))]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None)
             for g in set(group)}
    want = Counter((rows[k][0], f"{prints[k]:016x}", least[group[k]]) for k in range(len(rows)))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    assert got == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def test_keep_one_follows_chains_in_a_bucket(spark):
    """Neighbours are alike, texts further apart are not, and one text is apart from a large group of copies."""
    rng = random.Random(9)
    long = [f"c{k}" for k in range(1000)]
    chain = [(k, " ".join(long[3 * k:3 * k + 100])) for k in range(60)]
    base = [f"g{k}" for k in range(150)]
    near = [(100 + k, " ".join(base[:100] + [f"x{k}"] + base[101:])) for k in range(150)]
    odd = [(300 + k, " ".join([*base[:70], *(f"o{k}{j}" for j in range(80))])) for k in range(12)]
    rows = chain + near + odd
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, uid int, label string, `_key` string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 100, *range(300, 312)]
    items = spark.createDataFrame([(1, " ".join(long[:40]))], "item_id long, text string")
    assert sorted(r.doc_id for r in keep_uncontaminated(kept, items).collect()) == [100, *range(300, 312)]


def test_keep_one_finds_every_pair_of_similarity_four_fifths(spark):
    """Near copies with many differing bits go, in one bucket or in chains; texts below the similarity stay."""
    rng = random.Random(11)
    texts = []
    for size in (5, 9, 30, 120, 400, 3000) * 6:
        text = [f"v{rng.randrange(5000)}" for _ in range(size)]
        for changes in (0, *(rng.randint(1, max(1, size // 30)) for _ in range(5))):
            texts.append(" ".join(text))
            for _ in range(changes):
                text = [*text]
                text[rng.randrange(len(text))] = f"v{rng.randrange(5000)}"
    texts += ["one two", "One  TWO", "one three", "", " "]
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) or frozenset([tuple(w)]) for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for k, a in enumerate(sets):
        for j in range(k):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = max(group[k], group[j]), min(group[k], group[j])
                group = [new if g == old else g for g in group]
    kept = keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    prints = [fingerprint(t.encode()) for t in texts]
    assert sum((prints[k] ^ prints[k - 1]).bit_count() > 3 for k in range(1, len(texts)) if group[k] == group[k - 1]) > 20


def test_fingerprint_does_not_depend_on_pieces(monkeypatch):
    text = prose(random.Random(1), 500).encode()
    whole = fingerprint(text)
    monkeypatch.setattr(S, "PIECE", 64)
    monkeypatch.setattr(S.pieces, "__defaults__", (64,))
    assert fingerprint(text) == whole


def test_pairs_meet_by_wildcard_variants_of_simhash_segments(spark):
    """A pair shares a bucket where a segment of its SimHashes differs by a bit at most, and by no other way."""
    rng = random.Random(31)
    base = [rng.getrandbits(M.BITS) for _ in range(M.SEGMENTS)]
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(M.BITS), n))
    apart = [flip(v, 9) for v in base]
    prints = [base, [flip(v, 1 if k == 5 else 9) for k, v in enumerate(base)],
              [v if k == 20 else flip(v, 9) for k, v in enumerate(base)], apart, apart]
    classes = spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "id long, print array<int>")
    found = {(r.lead, r.id, r.key >> M.BITS) for t in M.buckets(classes) for r in t.collect()}
    assert {f for f in found if f[0] == 0} == {(0, 1, 5), (0, 2, 20)}
    assert {f for f in found if f[0] == 3} == {(3, 4, k) for k in range(M.SEGMENTS)} and all(f[0] in (0, 3) for f in found)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    other = [*words[:200], "x", *words[201:]]
    one, two = (M.sketch(next(M.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 5)))
                for t in (" ".join(w).encode() for w in (words, other)))
    assert 0 < sum(int(a ^ b).bit_count() for a, b in zip(one, two)) < M.FAR


def test_unrelated_prints_rarely_share_a_key(spark):
    """Keys that sets share by chance grow with the square of their number; 28 bits gave some 130 among 3,000 sets."""
    rng = random.Random(8)
    prints = [(k, [rng.getrandbits(M.BITS) for _ in range(M.SEGMENTS)]) for k in range(3000)]
    found = M.buckets(spark.createDataFrame(prints, "id long, print array<int>"))
    assert sum(t.count() for t in found) < 75


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_lose_no_pair(spark, distance):
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1}
    values |= {v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for v in list(values) for _ in range(6)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    found = S.near_links(spark.createDataFrame([(signed(v),) for v in values], "print long"), distance).collect()
    got = {frozenset((r.a, r.b)) for r in found}
    assert got == {frozenset((signed(a), signed(b))) for a in values for b in values
                   if 0 < (a ^ b).bit_count() <= distance}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(400, 450)] + \
            [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)]
    group: dict[int, set[int]] = {}
    for a, b in edges:
        joined = group.get(a, {a}) | group.get(b, {b})
        for x in joined:
            group[x] = joined
    got = {r.node: r.label for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: min(group[x]) for x in linked}


LABEL_WORDS = ("loser", "idiot", "scum")


def labelled(spark, n: int = 500):
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        w = prose(rng, rng.randint(30, 80)).split()
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(LABEL_WORDS)
        texts.append((k, " ".join(w)))
        labels.append((k, 1 if toxic else 0))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_trains_on_one_text_of_an_id(spark):
    """Repeated rows, other texts of an id and repeated labels change no score; a bound below the labels trains on fewer."""
    texts, labels = labelled(spark, 120)
    score = lambda t, l, **k: {(r.doc_id, r.score) for r in toxicity(t, l, **k).collect()}
    plain = score(texts, labels)
    assert score(texts.union(texts), labels.union(labels)) == plain
    assert score(texts.repartition(5), labels.repartition(3)) == plain
    assert score(texts, labels, per_class=5) != plain and score(texts, labels, per_class=1000) == plain


def test_toxicity(spark, none, docs):
    texts, labels = labelled(spark)
    new = spark.createDataFrame([(9001, prose(random.Random(1), 40)), (9002, prose(random.Random(1), 40) + " loserz idiiot scumm scums idiots"),
                                 (9003, None), (9004, ""), (None, "scum"), (9005, "scum"), (9005, "scum")], texts.schema)
    both = texts.union(new)
    out = toxicity(both, labels).collect()
    assert len(out) == both.count() and all(0 <= r.score <= 1 for r in out)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)
    held = [(r.score, r.doc_id % 3 == 0) for r in out if r.held_out and r.doc_id < 9000]
    wins = [a > b for a, t in held if t for b, u in held if not u]
    assert sum(wins) / len(wins) > 0.97
    score = {r.doc_id: r.score for r in out}
    assert score[9002] > score[9001] and score[9003] == score[9004]
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity(texts, other).collect()} == {k: v for k, v in score.items() if k is not None and k < 9000}
    kept = keep_clean(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert toxicity(none, labels).count() == 0
    assert toxicity(docs, labels.limit(0)).count() == docs.count()


def test_base_statistics(docs, rows):
    want = Counter()
    for i, t, *_ in rows:
        w = WHITE.findall(t or "")
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        twice = {k + j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WHITE.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(twice)] += 1
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in text_statistics(docs).collect())
    assert got == want


def test_outliers(spark, none, docs):
    rng = random.Random(4)
    good = [(k, prose(rng, rng.randint(40, 200)), "en", "a" if k % 3 else "b") for k in range(300)]
    bad = [(1000 + k, " ".join(x + "###&&&" for x in prose(rng, 60).split()), "en", "a") for k in range(20)]
    few = [(2000, " ".join(x + "###" for x in prose(rng, 60).split()), "de", "c")]
    out = {r.doc_id: r for r in quality(spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[k].kept for k in range(300)) and not any(out[1000 + k].kept for k in range(20))
    assert out[2000].kept and out[2000].distance is None
    assert quality(none).count() == 0
    got = quality(docs).collect()
    assert len(got) == docs.count()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)


def test_small_groups_are_judged_by_pooled_models(spark):
    """Junk in a small source, in a rare language, and in a table without a large group."""
    rng = random.Random(4)
    junk = lambda n: " ".join(x + "###&&&" for x in prose(rng, n).split())
    good = [(k, prose(rng, rng.randint(40, 200)), "en", f"s{k % 20}") for k in range(300)] + \
        [(300 + k, prose(rng, rng.randint(40, 200)), "fr", "large") for k in range(60)]
    few = [(1000, junk(60), "en", "s3"), (1001, junk(60), "de", "c"), (1002, junk(60), None, None), (1003, junk(60), "fr", "new")]
    fine = [(2000, prose(rng, 90), "de", "c"), (2001, prose(rng, 90), "fr", "new"), (2002, prose(rng, 5), "it", "d")]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality(frame(good + few + fine), pooled=True).collect()}
    assert len(out) == len(good + few + fine) and all(r.distance is not None for r in out.values())
    assert {k for k, r in out.items() if not r.kept} == {1000, 1001, 1002, 1003, 2002}
    tiny = {r.doc_id: r for r in quality(frame(good[:30] + few[:1]), pooled=True).collect()}
    assert {k for k, r in tiny.items() if not r.kept} == {1000}


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low_words(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def test_contamination(spark, docs, rows, none):
    source = [t for _, t, *_ in rows if t]
    items = [(1, " ".join(source[31].split()[30:50])), (2, "  "), (3, None), (4, " ".join(source[2].split()[:7])), (None, source[8]),
             (10, " ".join(source[31].split()[30:50])), (10, "aaaa AAAA-aaaa"), (11, prose(random.Random(77), 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = low_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    want = Counter()
    for i, t, *_ in rows:
        w, hit, named = low_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k:k + n])]
        want[i, len(w), len(hit), tuple(sorted(named)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in contamination(docs, bench).collect())
    assert got == want and any(k[4] for k in want)
    kept = keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[4])
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_winnow_takes_the_first_least_of_every_run():
    h = np.array([5, 3, 3, 9, 1, 7, 7, 7, 7, 2], np.uint64)
    want = sorted({k + int(np.argmin(h[k:k + 4])) for k in range(len(h) - 3)})
    assert winnow(h, 4).tolist() == want and winnow(h, 20).tolist() == []


@pytest.mark.parametrize("keep_first", [True, False])
def test_boilerplate(docs, rows, none, keep_first):
    sites: dict[str, set] = {}
    first: dict[str, int] = {}
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, t, _, s, *_ in rows:
        for x in set((t or "").split("\n")):
            if x.strip(" \t\x0b\x0c\r"):
                sites.setdefault(x, set()).update({s} - {None})
                first[x] = min(order(i), first.get(x, 1 << 63))
    want = Counter()
    for i, t, *_ in rows:
        out = None if t is None else [x for x in t.split("\n") if not (len(sites.get(x, ())) >= 10 and (not keep_first or first[x] != order(i)))]
        want[i, None if t is None else "\n".join(out), 0 if t is None else len(t.split("\n")) - len(out)] += 1
    cut = remove_boilerplate(docs, keep_first=keep_first)
    assert Counter((r.doc_id, r.text, r.n_lines_removed) for r in cut.collect()) == want
    assert cut.columns == [*docs.columns, "n_lines_removed"] and sum(k[2] for k in want) >= 13
    assert remove_boilerplate(none).count() == 0


def test_boilerplate_of_long_texts_takes_one_pass(spark):
    """200,000 lost lines in one text, rows with the same doc_id and other lines, a text lost altogether."""
    lines = [f"line {k}" for k in range(200_000)]
    rows = [(k, "\n".join(lines), f"s{k}") for k in range(2)]
    rows += [(5, "line 7\nown\nline 9\nline 7", "s0"), (5, "own\nline 9", "s0"), (6, "line 3", "s1")]
    begun = time.time()
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sorted(map(tuple, remove_boilerplate(given, 2).select("doc_id", F.length("text"), "text", "n_lines_removed").collect()))
    assert [(i, n if i < 5 else t, lost) for i, n, t, lost in out] == [
        (0, len(rows[0][1]), 0), (1, 0, 200_000), (5, "own", 1), (5, "own", 3), (6, "", 1)]
    assert time.time() - begun < 60


def test_spread_far_from_the_threshold_is_decided_by_the_sketch(spark):
    lines = [(k, "wide\nnarrow" if k < 3 else "wide", f"s{k}") for k in range(60)]
    found = line_spread(spark.createDataFrame(lines, "doc_id long, text string, source string"), 10).collect()
    assert len(found) == 1 and found[0]["first"] == 0


BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICE = ["Licensed under the Apache License, Version 2.0", "GNU General Public License", "cc-BY cc by CC BY-NC 4.0", "MIT license mit LICENSE",
          "the GNU Lesser General Public License version 2.1 or any later version", "SPDX-License-Identifier: BSD-3-Clause",
          "All rights reserved.", "acción mit licencia", "mitlicense", "Kit license ccé by"]


def test_license_scan(spark, none, docs):
    rng = random.Random(6)
    texts = [" ".join(rng.sample(NOTICE, rng.randint(0, 4)) + [prose(rng, 5)] + rng.sample(NOTICE, 1)) for _ in range(40)] + [None, "", "MIT License"]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in scan(given).collect()}
    for k, t in enumerate(texts):
        w, at, names = low_words(t), [], set()
        for phrase, name in BASE:
            p = phrase.split()
            hits = [j for j in range(len(w) - len(p) + 1) if w[j:j + len(p)] == p]
            at += hits
            names |= {name} if hits else set()
        r = out[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(names)) and names <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        for d in r.detections:
            assert not any(e.at <= d.at and e.to >= d.to and e.to - e.at > d.to - d.at for e in r.detections)
    one = scan(spark.createDataFrame([(1, NOTICE[4]), (2, NOTICE[5]), (3, NOTICE[2])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in one} == {1: "lgpl-2.1-or-later", 2: "bsd-3-clause", 3: "cc-by,cc-by-nc-4.0"}
    assert len(signatures()) > 200 and scan(none).count() == 0 and scan(docs).count() == docs.count()


WORDINGS = {
    "Licensed under GPLv3": "gpl-3", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "GPL3": "gpl-3", "MPLv2.0": "mpl-2.0", "EPL2.0": "epl-2.0",
    "FDLv1.3": "fdl-1.3", "ASL2.0": "apache-2.0", "CDDLv1.0": "cddl-1.0", "EUPLv1.2": "eupl-1.2", "LPPL1.3": "lppl-1.3",
    "BSL1.0": "boost-1.0", "WTFPLv2": "wtfpl-2", "FreeBSD License": "bsd-2", "Apache License2.0": "apache-2.0", "GPLv2+": "gpl-2",
    "GPL version 3 of the License, or (at your option) any later version": "gpl-3-or-later", "LGPLv3 or later": "lgpl-3-or-later"}


def sample(expression: str) -> list[str]:
    """A wording for each first, second, ... alternative of the groups of an expression, options taken and left."""
    def expand(tree, pick: int) -> str:
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                first = arg[min(pick, len(arg) - 1)]
                out += chr(first[1] if str(first[0]) == "LITERAL" else first[1][0]) if str(first[0]) != "CATEGORY" else "7" if "DIGIT" in str(first[1]) else "w"
            elif name == "BRANCH":
                out += expand(arg[1][pick % len(arg[1])], pick)
            elif name == "MAX_REPEAT":
                out += expand(arg[2], pick) * max(arg[0], pick % 2)
            elif name == "SUBPATTERN":
                out += expand(arg[3], pick)
        return out
    return [expand(re._parser.parse(expression), pick) for pick in range(6)]


def test_no_keyword_is_stricter_than_its_rule(spark):
    texts = list(WORDINGS)
    out = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: out[k].labels for k, t in enumerate(texts)} == WORDINGS
    rules = signatures()
    given = [(rule[3] * 10 + k, text) for rule in rules for k, text in enumerate(sample(rule[1]))]
    assert all(re.search(rules[k // 10][1], f" {t} ") for k, t in given)
    starts = {k: [p for word in rules[k // 10][2].split("|") for p in (word.replace("~", "se"), word.replace("~", "ce"))] for k, _ in given}
    assert [t for k, t in given if not any(f" {p}" in f" {t}" for p in starts[k])] == []
    some = [(k, t) for k, t in given if k % 10 == 0]
    found = scan(spark.createDataFrame(some, "doc_id long, text string").repartition(8)).collect()
    assert [r.doc_id for r in found if not r.score] == []


@pytest.mark.parametrize("edge", ["\n", "(", "# ", " * ", "\t/** "])
def test_separators_at_the_edges_move_no_word(spark, edge):
    given = [(1, edge + "MIT License) of it"), (2, edge + "see the GPLv3" + edge), (3, edge)]
    out = {r.doc_id: r for r in scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert (out[1].first_word, out[1].last_word, out[1].n_words) == (0, 0, 4)
    assert [(d.at, d.to) for d in out[1].detections] == [(0, 2)] and [(d.at, d.to) for d in out[2].detections] == [(2, 3)]
    assert out[3].n_words == 0 and out[3].first_word is None


def test_archives(spark):
    big = "<p>x é</p>\n" * 40_000
    pages = [(1, "http://a", "a" * 1000), (2, "http://b c", "a" * 1000), (3, None, "a" * 999), (4, "u", "a" * 999), (5, "u", None), (None, "u", "a" * 1000),
             (6, "u", big), (7, "u", big), (7, "u", big), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "b" * 2000)]
    frame = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    best: dict[str, int] = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(i, best.get(h, i))
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        again = h in best and best[h] != i
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[h] if again else None, True] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in archive_round_trip(frame).collect())
    assert got == want
    assert archive_round_trip(frame.limit(0)).count() == 0


def test_archive_chunks_carry_the_digest(spark, tmp_path):
    text = "".join(chr(97 + k % 26) for k in range(10_000))
    frame = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")
    manifest = write_archives(record_chunks(frame, chunk=700), f"file://{tmp_path}/w")
    rows = sorted(read_archives(manifest, 512).collect(), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.data) for r in rows).decode() == text and max(len(r.data) for r in rows) == 512
    assert [r.digest_so_far for r in rows] == [hashlib.sha1(text[:r.bytes_so_far].encode()).hexdigest() for r in rows]
    assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True]


@pytest.fixture(scope="module")
def sampler():
    return P.Sampler(P.Units(P.Vocabulary(MODEL)), 0)


def test_samples_follow_the_lattice(sampler):
    voc, text = sampler.units.vocabulary, "the nat on"
    known = {b.decode(): k for k, b in enumerate(voc.bytes_of) if k > 258}

    def all_of(rest: str):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                for ids, w in all_of(rest[n:]):
                    yield (known[rest[:n]], *ids), w + voc.weight[known[rest[:n]]]

    lattice = list(all_of(" " + text))
    total = np.logaddexp.reduce([w for _, w in lattice])
    chance = {ids: float(np.exp(w - total)) for ids, w in lattice}
    n = 6000
    out = P.segment_rows(sampler, [text] * n, np.arange(n, dtype=np.uint64), 3)
    picks = [[tuple(s[0].tolist()) for s in row] for row in out]
    assert all(len(set(p)) == 3 for p in picks)
    for row in out[:200]:
        assert row[0][2] > row[1][2] > row[2][2]
        assert all(abs(np.exp(s[1]) - chance[tuple(s[0].tolist())]) < 1e-9 for s in row)
    first, second = Counter(p[0] for p in picks), Counter(p[1] for p in picks)
    for ids in sorted(chance, key=chance.get)[-5:]:
        assert abs(first[ids] / n - chance[ids]) < 0.025
        after = sum(chance[a] * chance[ids] / (1 - chance[a]) for a in chance if a != ids)
        assert abs(second[ids] / n - after) < 0.025
    assert abs(np.mean([sum(np.exp(s[1]) / s[3] for s in row) for row in out]) - 1) < 0.02


def test_few_segmentations_end_the_search(sampler):
    rows = P.segment_rows(sampler, ["中", "", "\U0001f600"], np.arange(3, dtype=np.uint64), 4)
    assert [len({tuple(s[0].tolist()) for s in r}) for r in rows] == [len(r) for r in rows]
    assert len(rows[1]) == 1 and rows[1][0][3] == 1.0 and len(rows[1][0][0]) == 0


def test_samples_do_not_depend_on_the_block(sampler, rows):
    texts = [t for _, t, *_ in rows if t]
    keys = np.arange(len(texts), dtype=np.uint64)
    plain = lambda out: [[(s[0].tolist(), s[2]) for s in r] for r in out]
    whole = plain(P.segment_rows(sampler, texts, keys, 3))
    single = [plain(P.segment_rows(sampler, [t], keys[k:k + 1], 3))[0] for k, t in enumerate(texts)]
    assert [[x[0] for x in r] for r in whole] == [[x[0] for x in r] for r in single]
    fresh = P.Sampler(P.Units(sampler.units.vocabulary), 0)
    assert [[x[0] for x in r] for r in plain(P.segment_rows(fresh, texts[::-1], keys[::-1], 3))[::-1]] == [[x[0] for x in r] for r in whole]


def test_encoding_round_trip(docs, rows, none):
    out = P.sampled_segmentations(docs, MODEL, 2)
    got = out.collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    assert Counter(r.doc_id for r in got if r.samples is None) == Counter(i for i, t, *_ in rows if t is None)
    back = P.decoded(out.filter("samples IS NOT NULL").select("doc_id", F.col("samples")[0]["ids"].alias("ids")), MODEL)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t) for i, t, *_ in rows if t is not None)
    assert P.sampled_segmentations(none, MODEL).count() == 0


def test_pipeline(spark, tmp_path, docs):
    """Each stage against its operator's own rows, and the whole against the stages."""
    folder = str(tmp_path)
    given = docs.select("doc_id", "text", "lang", "source", "n_chars")
    toxic = spark.createDataFrame([(900 + k, prose(random.Random(k), 30) + " idiot scum loser" * 3, "en", "s1", 1) for k in range(4)], given.schema)
    given.union(toxic).write.parquet(f"{folder}/documents.parquet")
    texts, labels = labelled(spark)
    more = texts.selectExpr("doc_id + 5000 AS doc_id", "text", "'en' AS lang", "'s0' AS source", "1L AS n_chars")
    more.write.mode("append").parquet(f"{folder}/documents.parquet")
    labels.selectExpr("doc_id + 5000 AS doc_id", "0 AS quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    passage = [r.text for r in given.filter("doc_id = 31").collect()][0]
    spark.createDataFrame([(1, " ".join(passage.split()[25:60]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.settle(stage(spark, now, folder))
        kept.append(now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    ids = [Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert not any(900 + k in ids[0] for k in range(4)) and sum(ids[0].values()) > 350
    assert ids[1] == ids[0]
    assert ids[2] == Counter(r.doc_id for r in keep_one(kept[1]).select("doc_id").collect())
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert ids[3] == Counter(r.doc_id for r in contamination(kept[2], bench).filter("NOT contaminated").collect()) != ids[2]
    assert ids[4] == ids[3] and all(r.exact for r in kept[4].collect())
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(map(repr, whole.collect())) == Counter(map(repr, kept[4].collect()))
