"""Exact k-means over blocks of vectors in the order of a space-filling curve.

Vectors become integers, are sorted along a Hilbert curve, and neighbours are stored together as one row: a block with
its matrix and the smallest and largest value of each component. For each block the box bounds the distance
to every centroid from below and above; a centroid whose lower bound is beyond the smallest upper bound can be nearest
to none of the block's vectors. The rest are compared exactly, all vectors of the block at once. What a round sends to
the driver is one sum for each centroid and component.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle

BITS = 2                        # levels of a component on the curve: below, around and above its mean
BLOCK = 512                     # vectors of a block
SAFE = 1 << 26                  # up to here a squared distance of 64 components fits 64 bits, and so do its parts


# ---------------------------------------------------------------- the curve

def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of small integers on a Hilbert curve through the grid, as big-endian bytes.

    The grid is turned level by level, from the coarse bit to the fine one, so that each sub-cube is entered where the
    one before was left; the interleaved bits are then the place in Gray code."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flips
    planes = [((x >> level) & 1).T for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


# ---------------------------------------------------------------- vectors as integers

def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the components times `scale` rounded down, of vectors with `dims` finite components."""
    x = F.col("embedding")
    fine = F.coalesce((F.size(x) == dims) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))

    def unit(c: Column) -> Column:
        return F.when(F.abs(c.cast("double")) * scale < 2.0 ** 62, F.floor(c.cast("double") * float(scale))).otherwise(
            F.raise_error(F.lit("a component is too large for 64-bit units")).cast("long"))

    units = F.transform(x, unit)
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), units.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _spread(dims: int):
    """Count, sum and sum of squares of each component, one row for each task and component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            v = matrix(batch.column("v"), dims).astype(float)
            n, total, square = n + len(v), total + v.sum(axis=0), square + (v * v).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)),
                                              pa.array(total), pa.array(square)], ["d", "n", "s", "ss"])
    return run


def _place(dims: int, mean: np.ndarray, spread: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            cells = np.clip(np.floor((v - mean) / spread) + 2, 0, (1 << BITS) - 1).astype(np.int64)
            keys = [row.tobytes() for row in hilbert_keys(cells)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(keys, pa.binary())],
                                             ["vec_id", "v", "place"])
    return run


def _pack(dims: int, size: int):
    """Blocks of `size` neighbours as rows: ids, matrix, box and whether 64 bits suffice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = None, 0
        for batch in batches:
            kept = [batch] if kept is None else [*kept, batch]
            rows += batch.num_rows
            while rows >= size:
                whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                yield block(whole.slice(0, size))
                kept, rows = [whole.slice(size)], rows - size
        if rows:
            yield block(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = matrix(batch.column("v"), dims).astype(np.int64)
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([batch.column("vec_id").to_pylist()], longs), pa.array([v.tobytes()], pa.binary()),
             pa.array([v.min(axis=0).tolist()], longs), pa.array([v.max(axis=0).tolist()], longs),
             pa.array([int(np.abs(v).max()) < SAFE])], ["ids", "data", "low", "high", "safe"])
    return run


def curve_blocks(units: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """The vectors of `units` in blocks of neighbours on the curve, settled. Equal vectors are dealt by their id, so
    that a vector with very many copies fills many blocks in many tasks."""
    stats = (units.mapInArrow(_spread(dims), "d long, n long, s double, ss double")
             .groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("d").collect())
    n = np.array([r[1] for r in stats], float) if stats else np.ones(dims)
    mean = np.array([r[2] for r in stats]) / n if stats else np.zeros(dims)
    spread = np.sqrt(np.maximum(np.array([r[3] for r in stats]) / n - mean ** 2, 1.0)) if stats else np.ones(dims)
    placed = units.mapInArrow(_place(dims, mean, spread), "vec_id long, v array<long>, place binary")
    return settle(placed.withColumn("deal", F.xxhash64("vec_id")).repartitionByRange("place", "deal")
                  .sortWithinPartitions("place", "deal").drop("place", "deal")
                  .mapInArrow(_pack(dims, size), "ids array<long>, data binary, low array<long>, high array<long>, safe boolean"))


# ---------------------------------------------------------------- nearest centroids

def candidates(low: np.ndarray, high: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The centroids that can be nearest to a point of the box, in ascending order; ties stay in."""
    short = np.maximum(np.maximum(low - centers, centers - high), 0)
    far = np.maximum(np.abs(centers - low), np.abs(high - centers))
    return np.flatnonzero((short * short).sum(axis=1) <= (far * far).sum(axis=1).min())


def nearest(v: np.ndarray, centers: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the chosen centroids and its squared distance; ties go to the smaller number."""
    distance = np.empty((len(chosen), len(v)), v.dtype)
    for k, c in enumerate(chosen):
        gap = v - centers[c]
        distance[k] = (gap * gap).sum(axis=1)
    best = distance.argmin(axis=0)
    return chosen[best], distance[best, np.arange(len(v))]


def _assigned(batches: Iterator[pa.RecordBatch], centers: np.ndarray):
    """Each block as ids, integers, cluster and distance. Blocks with huge components use unbounded integers."""
    dims = centers.shape[1]
    near = int(np.abs(centers).max()) < SAFE if centers.size else True
    for batch in batches:
        cols = [batch.column(c) for c in ("ids", "data", "low", "high", "safe")]
        for ids, data, low, high, safe in zip(*cols):
            v = np.frombuffer(data.as_py(), np.int64).reshape(-1, dims)
            box = [x.values.to_numpy() for x in (low, high)]
            c = centers
            if not (safe.as_py() and near):
                v, c, box = v.astype(object), centers.astype(object), [x.astype(object) for x in box]
            yield ids.values, v, *nearest(v, c, candidates(*box, c))


def _sums(centers: np.ndarray):
    """For each task one row a centroid and component: how many vectors, and their sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centers.shape
        count, total = np.zeros(k, object), np.zeros((k, dims), object)
        for _, v, cluster, _ in _assigned(batches, centers):
            for c in np.unique(cluster):
                mine = v[cluster == c]
                count[c] += len(mine)
                total[c] += mine.sum(axis=0).astype(object)
        used = np.flatnonzero(count > 0)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, dims)), pa.array(np.tile(np.arange(dims), len(used))),
                 pa.array(np.repeat(count[used], dims).tolist(), pa.int64()),
                 pa.array([str(x) for x in total[used].ravel()], pa.string())], ["c", "d", "n", "s"])
    return run


def _members(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assigned(batches, centers):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64))],
                ["vec_id", "cluster", "distance"])
    return run


def first_centers(units: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`. Ties (repeated ids): the smaller vector; null ids last."""
    named = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    rows = (units.withColumn("h", F.when(F.col("vec_id").isNotNull(), named))
            .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect())
    return np.array([r.v for r in rows], np.int64)


def lloyd(blocks: DataFrame, centers: np.ndarray, rounds: int) -> np.ndarray:
    """`rounds` times: every vector to its nearest centroid, then every non-empty centroid to the floor of its mean."""
    for _ in range(rounds):
        sums = (blocks.mapInArrow(_sums(centers), "c long, d long, n long, s string").groupBy("c", "d")
                .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        after = centers.copy()
        for c, d, n, s in sums:                                  # k * dims rows
            after[c, d] = int(s) // n
        if (after == centers).all():                             # every further round would repeat this one
            break
        centers = after
    return centers


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024,
                      seed: int = 3, block: int = BLOCK) -> DataFrame:
    """Clusters of vectors (vec_id, embedding) around k centroids, in exact integer arithmetic.

    Components become floor(scale * x). The first centroids are the k vectors with the smallest sha256 of
    `seed:vec_id`; then `rounds` rounds of assignment and means. Returns for each vector vec_id, cluster, distance
    (squared), cluster_inertia and inertia (distances summed over its cluster and over all) and centroid (array).

    Vectors of another length, or with a null or non-finite component, are left out, as are null arrays. Fewer vectors
    than k give fewer centroids; ties go to the smaller number; empty centroids stay where they are; repeated rows give
    repeated rows; a null vec_id is kept, but seeds only where nothing else can. Other columns are ignored; an empty
    table gives an empty one. Sums beyond 64 bits are an error.
    """
    units = whole_vectors(vectors, dims, scale)
    centers = first_centers(units, k, seed)
    spark: SparkSession = vectors.sparkSession
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centers):
        return spark.createDataFrame([], shape)
    blocks = curve_blocks(units, dims, block)
    centers = lloyd(blocks, centers, rounds)
    found = settle(blocks.mapInArrow(_members(centers), "vec_id long, cluster int, distance long"))
    discard(blocks)
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    named = spark.createDataFrame(
        [(c, int(s), int(sum(sums.values())), centers[c].tolist()) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")         # k rows
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
