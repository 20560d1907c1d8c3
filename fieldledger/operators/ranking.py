"""Sorting, limiting and ranking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import settle


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                   rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group. Spark turns ``row_number() <= k`` into a
    per-task group limit before the shuffle, so a hot group sends k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return out.drop("_rank") if rank is None else out.withColumnRenamed("_rank", rank)


def order_nulls_last(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def category_rank(column: str, order: list[str]) -> Column:
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def sum_before(df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str) -> DataFrame:
    """Adds the sum of `amount` over the earlier rows of the same keys (0 for the first), for groups of any size.

    Rows are dealt by ranges of (keys, order), so a group, or a value that very many rows share, is spread over as many
    ranges as it needs, as long as `order` ends in something that tells its rows apart. Each range is summed by itself
    and offset by the ranges before, of which there are as many as partitions. Null keys form a group.
    """
    ranges = settle(df.repartitionByRange(*map(F.col, keys), *order).withColumn("_range", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    sizes = ranges.groupBy(*keys, "_range").agg(F.sum(amount).alias("_own")).select(*named, F.col("_range").alias("_of"), "_own")
    groups = Window.partitionBy(*[f"_key{i}" for i in range(len(keys))]) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_own").over(earlier(groups.orderBy("_of"))), F.lit(0))).drop("_own")
    within = F.coalesce(F.sum(amount).over(earlier(Window.partitionBy("_range", *keys).orderBy(*order))), F.lit(0))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    summed = ranges.withColumn("_within", within).join(offsets, same)
    return summed.withColumn(out, F.col("_offset") + F.col("_within")).select(*df.columns, out)


def row_number_by(df: DataFrame, keys: list[str], leading: list, order: list, out: str) -> DataFrame:
    """row_number within ``keys`` by ``leading`` and, among their equals, by ``order``, for groups of any size; see `sum_before`."""
    by = [F.col(c) if isinstance(c, str) else c for c in [*leading, *order]]
    return sum_before(df, keys, by, F.lit(1), out).withColumn(out, F.col(out) + 1)
