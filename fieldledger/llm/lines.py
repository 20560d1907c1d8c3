"""Boilerplate lines: how many sites a line is spread over, by HyperLogLog sketches.

Sketches of sites are built for each line hash before the shuffle and merged after it, so a line on every
page costs one small sketch for each task. Only lines whose estimate is near the threshold are counted
exactly; far from it the estimate decides.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

MIN_SITES = 10
LOG2_REGISTERS = 10
MARGIN = 0.2                # more than four standard errors of the sketch (3.3 % with 2^10 registers)


def line_hash(line: Column) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _written(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, "\t\u000b\u000c\r", "    "))) > 0


def _text_key() -> list[Column]:
    """128 bits of a text, so that rows with the same doc_id but other lines keep their own places."""
    return [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit("text"), F.col("text")).alias("_t2")]


def line_spread(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines spread over at least `min_sites` sites (column source): h1, h2 and first, the smallest doc_id.

    Blank lines are not counted, nor is a null source. A null doc_id is larger than every other.
    """
    found = (docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long").alias("doc_id"),
                         F.col("source").cast("string").alias("source"),
                         F.explode(F.array_distinct(F.filter(_lines(F.col("text")), _written))).alias("line"))
             .select("doc_id", "source", line_hash(F.col("line")).alias("h")).select("doc_id", "source", "h.*"))
    spread = settle(found.groupBy("h1", "h2")
                    .agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", LOG2_REGISTERS)).alias("about"),
                         F.min("doc_id").alias("first"))
                    .filter(F.col("about") >= min_sites * (1 - MARGIN) - 1))
    near = F.col("about") <= min_sites * (1 + MARGIN) + 1
    exact = (found.join(spread.filter(near).select("h1", "h2"), ["h1", "h2"], "left_semi")
             .groupBy("h1", "h2").agg(F.countDistinct("source").alias("sites")).filter(F.col("sites") >= min_sites))
    return settle(spread.filter(~near).select("h1", "h2", "first")
                  .union(spread.filter(near).join(exact, ["h1", "h2"]).select("h1", "h2", "first")))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """All columns of docs; text without lines that stand on `min_sites` or more sites, and n_lines_removed.

    With keep_first the document with the smallest doc_id keeps its copies of a line, so no passage is
    lost altogether. Lines are cut at \\n and compared whole; blank ones stay. A null text stays null, a
    text of nothing but boilerplate becomes empty. Documents with the same doc_id, null included, keep or
    lose a line together. A column n_lines_removed of docs is replaced.
    """
    wide = line_spread(docs, min_sites)
    key = [F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("long").alias("_id"), *_text_key()]
    # all within the generated array: what is derived from a text beside it would be worked out for every line
    keyed = F.element_at(F.transform(F.array(F.struct(*_text_key())), lambda t: F.transform(
        _lines(F.col("text")), lambda line, at: F.struct(t["_t1"].alias("_t1"), t["_t2"].alias("_t2"), at.alias("at"),
                                                         _written(line).alias("written"), line_hash(line).alias("h")))), 1)
    lines = (docs.select(key[0], F.explode(F.filter(keyed, lambda x: x["written"])).alias("x"))
             .select("_id", "x._t1", "x._t2", "x.at", "x.h.h1", "x.h.h2"))
    lost = lines.join(wide, ["h1", "h2"])
    if keep_first:
        lost = lost.filter(F.col("_id") != F.col("first"))
    lost = settle(lost.groupBy("_id", "_t1", "_t2").agg(F.collect_set("at").alias("_lost")))
    base = docs.drop("n_lines_removed")
    rows = base.select(F.struct(*(base[f"`{c}`"] for c in base.columns)).alias("row"), "text", *key)
    lines_of = _lines(F.col("text"))
    # by places, which array_except looks up in a hash set: one pass over a text's lines, however many are lost
    def left(lines: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lost")), lambda p: F.get(lines, p))

    # the outer transform binds the lines to a variable: a column would be split anew for every place
    kept = F.element_at(F.transform(F.array(lines_of), left), 1)
    # lost grows with the table, so it is never broadcast and the plan is the same at every size
    cut = (rows.join(lost.hint("merge"), ["_id", "_t1", "_t2"], "left")
           .withColumn("_kept", F.when(F.col("_lost").isNotNull(), kept))
           .withColumn("_n", F.coalesce(F.size("_lost"), F.lit(0)).cast("long"))
           .withColumn("text", F.coalesce(F.array_join("_kept", "\n"), F.col("text"))))
    return cut.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in base.columns),
                      F.col("_n").alias("n_lines_removed"))
