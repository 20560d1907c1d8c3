"""Quality rules: fixed base rules, then robust multivariate outliers for each language and source.

Minimum covariance determinant: starting from medians and median deviations, the closest part of each
group gives mean and covariance, these give new Mahalanobis distances, and so on. All of it is grouped
aggregation over one narrow table; a group of any size costs a few sums and a mergeable quantile sketch.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 8
STATS = ("letters", "symbols", "lines", "repeats")
FLOORS = (0.05, 0.25, 0.25, 0.25)     # smallest standard deviations: most texts have no symbol or repeat at all
CHI2_MEDIAN = 3.357                   # of four degrees of freedom
CORE = 0.75                           # share of a group that the covariance is taken from
STEPS = 4
CUT = 90.0                            # squared distance beyond which a text is rejected
MIN_ROWS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first place included."""
    def window(hashes: Column, i: Column) -> Column:
        return F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))

    def in_order(w: Column) -> Column:
        hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: window(h, i)))
        return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(h)))

    def places(h: Column) -> Column:
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(keyed, lambda s: F.transform(F.filter(s, lambda e, k: (e["x"] == F.get(s, k - 1)["x"])
                                                          | (e["x"] == F.get(s, k + 1)["x"])), lambda e: e["i"]))
        return let(F.array_sort(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(let(words, in_order))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (nulls empty) and the counts of each row; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    words = let(F.array_remove(F.split(text, WHITE, -1), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                        words.alias("w"), lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
            .select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols"))


def _vector() -> dict[str, Column]:
    """The transformed statistics: logs of rates, so that their spread is of one size."""
    n = F.greatest("n_words", F.lit(1))
    return {"letters": F.log(F.greatest("word_chars", F.lit(1)) / n), "symbols": F.log1p(20 * F.col("n_symbols") / n),
            "lines": F.log1p(20 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "repeats": F.log1p(20 * F.col("n_repeat_words") / n)}


OWN, LANGUAGE, ALL = 0, 1, 2           # the rows a model is fitted to: of a language and source, of a language, all
GROUP = ["level", "lang", "source"]    # pooled models have an empty source, or language and source
PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _distance(p: int = len(STATS)) -> Column:
    """Squared Mahalanobis distance by forward substitution with the model's triangular factor."""
    y: list[Column] = []
    for i in range(p):
        rest = F.col(STATS[i]) - F.col(f"mean_{i}")
        for j in range(i):
            rest = rest - F.col(f"factor_{i}{j}") * y[j]
        y.append(rest / F.col(f"factor_{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _factor(model: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance columns cov_ij."""
    for i in range(len(STATS)):
        for j in range(i + 1):
            rest = F.col(f"cov_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"factor_{i}{k}") * F.col(f"factor_{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"factor_{j}{j}")
            model = model.withColumn(f"factor_{i}{j}", value)
    return model


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and median deviations as a diagonal covariance."""
    mid = settle(rows.groupBy(*GROUP).agg(*(F.percentile_approx(s, 0.5).alias(f"mean_{i}") for i, s in enumerate(STATS)),
                                          F.count(F.lit(1)).alias("n")))
    spread = rows.join(mid, GROUP).groupBy(*GROUP).agg(*(
        F.percentile_approx(F.abs(F.col(s) - F.col(f"mean_{i}")), 0.5).alias(f"mad_{i}") for i, s in enumerate(STATS)))
    model = mid.join(spread, GROUP)
    for i, j in PAIRS:
        model = model.withColumn(f"cov_{i}{j}", F.lit(0.0) if i != j else
                                 F.pow(F.greatest(1.4826 * F.col(f"mad_{i}"), F.lit(FLOORS[i])), 2))
    return model


def _limits(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The model with the quantiles of its own distances in each group."""
    known = settle(_factor(model))
    cuts = (rows.join(known, GROUP).select(*GROUP, _distance().alias("d")).groupBy(*GROUP)
            .agg(F.percentile_approx("d", [0.5, CORE]).alias("q"))
            .select(*GROUP, F.col("q")[0].alias("middle"), F.col("q")[1].alias("core")))
    return settle(known.join(cuts, GROUP))


def covariance_models(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """One robust model for each group: mean, covariance, factor, quantiles, n."""
    model = _limits(rows, _start(rows))
    for _ in range(steps):
        near = rows.join(model, GROUP).filter(_distance() <= F.col("core"))
        off = [F.col(s) - F.col(f"mean_{i}") for i, s in enumerate(STATS)]
        sums = near.groupBy(*GROUP, "n", *(f"mean_{i}" for i in range(len(STATS)))).agg(
            F.count(F.lit(1)).alias("h"), *(F.sum(o).alias(f"sum_{i}") for i, o in enumerate(off)),
            *(F.sum(off[i] * off[j]).alias(f"cross_{i}{j}") for i, j in PAIRS))
        shift = [F.col(f"sum_{i}") / F.col("h") for i in range(len(STATS))]
        model = _limits(rows, sums.select(
            *GROUP, "n", *((F.col(f"mean_{i}") + shift[i]).alias(f"mean_{i}") for i in range(len(STATS))),
            *((F.col(f"cross_{i}{j}") / F.col("h") - shift[i] * shift[j] + (FLOORS[i] ** 2 if i == j else 0.0))
              .alias(f"cov_{i}{j}") for i, j in PAIRS)))
    return model


def _keys(level: Column) -> list[Column]:
    """The columns of GROUP at a level."""
    return [level.alias("level"), F.when(level < ALL, F.col("lang")).otherwise("").alias("lang"),
            F.when(level == OWN, F.col("source")).otherwise("").alias("source")]


def model_levels(rows: DataFrame, min_rows: int, pooled: bool) -> DataFrame:
    """lang, source, level of the model that judges them, and fits, the levels to which their rows belong."""
    sizes = settle(rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n")))
    own = sizes.join(sizes.groupBy("lang").agg(F.sum("n").alias("n_lang")), "lang").withColumn(
        "level", F.when(F.col("n") >= min_rows, OWN).when(F.lit(pooled), F.when(F.col("n_lang") >= min_rows, LANGUAGE).otherwise(ALL)))
    own = settle(own)
    by_language = own.groupBy("lang").agg(F.coalesce(F.bool_or(F.col("level") == LANGUAGE), F.lit(False)).alias("shared"))
    everywhere = bool(own.agg(F.bool_or(F.col("level") == ALL)).first()[0])
    return settle(own.join(by_language, "lang").select("lang", "source", "level", F.array_compact(F.array(
        F.when(F.col("level") == OWN, OWN), F.when(F.col("shared"), LANGUAGE), F.when(F.lit(everywhere), ALL))).alias("fits")))


def quality(docs: DataFrame, cut: float = CUT, min_rows: int = MIN_ROWS, pooled: bool = False) -> DataFrame:
    """Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance
    and kept of each row of docs.

    Base: fewer than 20 words, or more than 30 % repeated words, fails. The models are fitted to the rows
    that pass; a row is kept if it passes and its squared distance, scaled so that the model's median is
    that of the chi-square law where it is larger, stays within `cut`. With `pooled`, groups of fewer than
    `min_rows` rows are judged by the model of their language, and where that has fewer too, by the model of
    all rows, so that each row has a distance. Without, they have no model, their distance is null and they
    are kept. Null and empty texts fail, null languages and sources form a group with the empty ones,
    repeated rows count as often as they occur.
    """
    rows = settle(text_statistics(docs).withColumns(_vector()).withColumn("base_failed", (F.col("n_words") < 20)
                                                    | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    levels = model_levels(rows, min_rows, pooled)
    passed = (rows.filter(~F.col("base_failed")).join(levels, ["lang", "source"])
              .select("lang", "source", *STATS, F.explode("fits").alias("fit")).select(*_keys(F.col("fit")), *STATS))
    model = covariance_models(passed)
    scaled = _distance() / F.greatest(F.lit(1.0), F.col("middle") / CHI2_MEDIAN)
    judged = rows.join(levels.drop("fits"), ["lang", "source"])
    return (judged.select(*(c for c in judged.columns if c not in GROUP), *_keys(F.col("level"))).join(model, GROUP, "left")
            .withColumn("distance", scaled)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept")))
