"""Toxicity as a bag of subwords: embeddings averaged over n-grams, words and text, into a linear softmax.

Embeddings and output layer are trained together in numpy on a bounded sample of labelled rows. An unseen
misspelling shares most of its n-grams with the word it comes from, and so most of its vector. After
training both layers are linear, so each bucket folds into one number, and scoring is a mean of numbers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, blocks, byte_table, mix, packed, powers, prefix_sums, settle, with_row

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIM = 8
SCALE = 40.0
EPOCHS = 30
BATCH = 64
PRIOR_WORDS = 30.0               # neutral words added to each mean, so that one odd word doesn't decide
PER_CLASS = 3000
TABLE = byte_table(4)


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the word and bucket of each subword (n-grams with word edges, and the word itself), and
    the row of each word. Words are runs of letters and digits, A-Z lower-cased."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    text = np.full(len(data) + len(offs), 32, np.uint8)
    text[np.arange(len(data)) + rows + 1] = LOWER[data]
    gap = NOT_ALNUM[text]
    text[gap] = 32
    opens = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    closes = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    row_at = np.zeros(len(text), np.int64)
    row_at[np.arange(len(data)) + rows + 1] = rows
    sums, inverse = prefix_sums(TABLE[text]), powers(len(text) + 1)[1]
    gaps = np.concatenate([[0], np.cumsum(gap)])
    word_at = np.zeros(len(text) + 1, np.int64)
    word_at[opens] = 1
    word_at = np.cumsum(word_at) - 1
    words, ids = [np.arange(len(opens))], [(sums[closes] - sums[opens]) * inverse[opens]]
    for n in SIZES:
        at = np.arange(max(0, len(text) - n + 1))
        at = at[gaps[at + n - 1] == gaps[at + 1]]
        words.append(word_at[at + 1])
        ids.append((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n))
    return (np.concatenate(words), (mix(np.concatenate(ids)) & np.uint64(BUCKETS - 1)).astype(np.int64),
            row_at[opens])


def weights(word: np.ndarray, row_of_word: np.ndarray, rows: int) -> np.ndarray:
    """What each subword counts in its row: an equal share of its word, which has an equal share of the row."""
    in_word = np.bincount(word, minlength=len(row_of_word))
    in_row = np.bincount(row_of_word, minlength=rows) + PRIOR_WORDS
    return 1.0 / (in_word[word] * in_row[row_of_word[word]])


BAG = "id bigint, toxic int, buckets array<int>, shares array<float>"


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different buckets of each row, in order, with their weights: at most BUCKETS, however long the text."""
    for batch, data, offs in blocks(batches):
        word, bucket, row_of_word = subwords(data, offs)
        share, row = weights(word, row_of_word, batch.num_rows), row_of_word[word]
        key, place = np.unique(row * BUCKETS + bucket, return_inverse=True)
        share = np.bincount(place, share)
        ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * BUCKETS), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("toxic"), pa.ListArray.from_arrays(ends, pa.array(key % BUCKETS, pa.int32())),
             pa.ListArray.from_arrays(ends, pa.array(share, pa.float32()))], ["id", "toxic", "buckets", "shares"])


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], odds: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Trains embeddings and softmax together by minibatches with per-weight steps (Adagrad).

    Returns the worth of each bucket and the bias, both on the log-odds scale. `odds` is the share of
    toxic to other rows in all training labels; the sample is balanced, so the bias is moved back by it.
    """
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e, seen_o, seen_b = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    samples = [s for s in samples if len(s[1])]
    labels = np.array([s[0] for s in samples], np.int64)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)]) if len(labels) else np.ones(2) / 2
    if not len(labels) or share.min() == 0:
        return np.zeros(BUCKETS), float(np.log(odds))
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for a in range(0, len(order), BATCH):
            part = order[a:a + BATCH]
            ids = np.concatenate([samples[k][1] for k in part])
            w = np.concatenate([samples[k][2] for k in part]) * SCALE
            starts = np.concatenate([[0], np.cumsum([len(samples[k][1]) for k in part])])
            mean = np.add.reduceat(embed[ids] * w[:, None], starts[:-1])
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (0.5 / share[labels[part]])[:, None] / len(part)
            back = np.repeat(p @ out.T, np.diff(starts), axis=0) * w[:, None]
            grad = np.stack([np.bincount(ids, back[:, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            for value, g, seen, rate in ((embed, grad, seen_e, 0.15), (out, mean.T @ p, seen_o, 0.05),
                                         (bias, p.sum(0), seen_b, 0.05)):
                seen += g * g
                value -= (rate * g / np.sqrt(seen)).astype(np.float32)
    fold = out[:, 1] - out[:, 0]
    return SCALE * (embed @ fold).astype(np.float64), float(bias[1] - bias[0] + np.log(odds))


def _train(odds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [(label, np.asarray(buckets.values, np.int64), np.asarray(shares.values, np.float32)) for batch in batches
                   for label, buckets, shares in zip(batch.column("toxic").to_pylist(), batch.column("buckets"), batch.column("shares"))]
        worth, bias = fit(samples, odds)
        yield pa.RecordBatch.from_arrays([pa.array([worth.astype(np.float32).tobytes()]), pa.array([bias])],
                                         ["worth", "bias"])
    return run


def _score(worth: np.ndarray, bias: float, carried: str):
    """The score of each row's text, next to one carried column."""
    worth = worth.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            word, bucket, row_of_word = subwords(data, offs)
            total = np.bincount(row_of_word[word], worth[bucket] * weights(word, row_of_word, batch.num_rows),
                                batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(carried), pa.array(score)], [carried, "score"])
    return run


def held_out(doc_id):
    """True for a third of the ids; labels of these are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Fits on at most `per_class` labelled ids of each class, those with the smallest hashed ids.

    Labels of held-out ids, null ids and null labels are left out; of several labels for an id the larger
    holds, of several texts one. The ids are ranked below a hash that about `per_class` of their class, and
    ten deviations more, do not exceed, so no task meets a whole class. The sample may be broadcast to its
    texts; the training task gets their bags, at most BUCKETS numbers each. The model is a fixed number of
    buckets. Class shares are counted over all labels.
    """
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").dropna()
              .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("hash")))
    shares = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = per_class + 10 * (per_class + 1) ** 0.5
    bound = lambda n: -(1 << 63) + min((1 << 64) - 1, int(wanted / max(n, 1) * (1 << 64)))
    few = usable.filter(F.col("hash") <= F.when(F.col("toxic") == 1, F.lit(bound(shares.get(1, 0)))).otherwise(F.lit(bound(shares.get(0, 0)))))
    by_hash = Window.partitionBy("toxic").orderBy("hash", "doc_id")
    chosen = (few.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= per_class)
              .select(F.col("doc_id").alias("id"), "toxic"))
    texts = (docs.select(F.col("doc_id").cast("long").alias("id"), "text")
             .join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    odds = (shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5)
    model = settle(texts.mapInArrow(bags, BAG).repartition(1).sortWithinPartitions("id")
                   .mapInArrow(_train(odds), "worth binary, bias double")).first()
    if model is None:
        return np.zeros(BUCKETS), float(np.log(odds))
    return np.frombuffer(model["worth"], np.float32).astype(np.float64), model["bias"]


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """Columns doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on) of each row of docs.

    The score reads the whole text and nothing else. Null, empty and wordless texts get the score of a text
    without evidence, the odds of the training labels. Repeated rows get equal scores; a null doc_id is
    kept. Without labels of both classes every score is that of the counted odds.
    """
    worth, bias = train(docs, labels, per_class)
    given = docs.select("doc_id", "text")
    return (given.mapInArrow(_score(worth, bias, "doc_id"),
                             T.StructType([given.schema["doc_id"], T.StructField("score", T.DoubleType())]))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """The rows of docs scored below the threshold, with their columns unchanged."""
    worth, bias = train(docs, labels, per_class)
    scored = packed(docs).mapInArrow(_score(worth, bias, "row"), with_row(docs, ("score", T.DoubleType())))
    return scored.filter(F.col("score") < threshold).select("row.*")
