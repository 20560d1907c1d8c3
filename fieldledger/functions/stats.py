"""Statistical column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

SHRINK_K = 8.0
Z = 1.96
NEAR_MISS = -0.25


def shrunk_mean(mean: Column, n: Column, baseline: Column, k: float = SHRINK_K) -> Column:
    return (n * mean + k * baseline) / (n + k)


def effect_interval(diff: Column, se: Column) -> tuple[Column, Column]:
    return diff - Z * se, diff + Z * se


def support_case(diff: Column, lo: Column, hi: Column, n: Column, min_n: int,
                 suggestive: int, backed: int, stable: Column) -> Column:
    """How far an effect is supported. An unknown ``stable`` never demotes."""
    contradicted = F.coalesce(~stable, F.lit(False))
    return (F.when(n < min_n, "thin")
            .when(hi < 0, F.when(contradicted, "unstable").otherwise("below"))
            .when(lo > 0, F.when(contradicted, "unstable").when(n >= backed, "backed")
                  .when(n >= suggestive, "suggestive").otherwise("thin"))
            .when((diff > 0) & (lo > NEAR_MISS) & (n >= suggestive), "suggestive")
            .otherwise("unproven"))


def pearson(x: str, y: str) -> Column:
    """Correlation that is NULL, not an error, on a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
