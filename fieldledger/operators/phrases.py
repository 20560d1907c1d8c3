"""Distinctive phrases per unit: document frequencies against the whole archive."""
from __future__ import annotations

import re

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import stem_phrase
from ..sources.tables import settle

MIN_DF, MIN_SHARE, MIN_LIFT, KEEP = 6, 0.04, 0.35, 10
BUCKETS = 1 << 16


def stop_words(spark: SparkSession, extra: list[str] = ()) -> list[str]:
    """Spark's English stop words plus words a caller considers empty."""
    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")) | set(extra))


def word_array(text: Column, stop: list[str]) -> Column:
    """Lower-case words of three letters and more, without stop words and numbers. One pattern reads them all, so
    that no word is looked at by itself."""
    end = "(?![a-z0-9'])"
    empty = f"(?!(?:{'|'.join(map(re.escape, stop))}){end})" if stop else ""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?<![a-z0-9']){empty}[a-z']{{3,}}+{end}"), F.lit(0))


def blocked_tokens(names: DataFrame, columns: list[str], camel: bool = True) -> DataFrame:
    """Name parts longer than two letters; camel case also split. Names that stand in many rows are cut once."""
    names, sources = names.select(*columns).distinct(), []
    for c in columns:
        value = F.coalesce(F.col(c), F.lit(""))
        sources.append(value)
        if camel:
            sources.append(F.regexp_replace(value, "([a-z])(?=[A-Z])", "$1 "))
    parts = F.flatten(F.array(*[F.split(F.lower(s), "[^a-z']+") for s in sources]))
    return (names.select(F.explode(F.array_distinct(parts)).alias("token"))
            .where(F.length("token") > 2).dropDuplicates())


def kept_words(docs: DataFrame, stop: list[str], blocked: DataFrame) -> DataFrame:
    """(obs_id, unit, words): the words of every document with a body and a unit, in order, without stop
    words and blocked names.

    Words stay in their row. Only the names that occur leave it: the distinct words of a document meet the
    blocked names by a semi-join, which Spark broadcasts when they are small and splits when a word is hot.
    Rows with the same obs_id lose the names of all of them. Words and names are settled: both are read once more,
    and Spark then knows whether the names are few enough to be sent to the rows.
    """
    rows = settle(docs.where(F.col("body").isNotNull() & F.col("unit").isNotNull()).select(
        "obs_id", "unit", word_array(F.col("body"), stop).alias("words")))
    names = settle(rows.select("obs_id", F.explode(F.array_distinct("words")).alias("token")).join(blocked, "token", "left_semi")
                   .groupBy("obs_id").agg(F.collect_set("token").alias("names")))
    left = F.filter("words", lambda w: ~F.array_contains("names", w))
    return rows.join(names, "obs_id", "left").select(
        "obs_id", "unit", F.when(F.col("names").isNull(), F.col("words")).otherwise(left).alias("words"))


def phrase_tokens(words: DataFrame) -> DataFrame:
    """(token, n, docs): how often a word stands and in how many documents. Counted before the shuffle."""
    rows = F.concat(F.transform("words", lambda w: F.struct(w.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("docs"))),
                    F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("docs"))))
    return words.select(F.explode(rows).alias("r")).groupBy("r.token").agg(F.sum("r.n").alias("n"), F.sum("r.docs").alias("docs"))


def phrase_sets(words: DataFrame) -> DataFrame:
    """(obs_id, unit, phrases): distinct words and adjacent word pairs of every document, built in its row."""
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))),
                       lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return words.select("obs_id", "unit", F.array_distinct(F.concat("words", F.array_compact(pairs))).alias("phrases"))


def _occurrences(sets: DataFrame) -> DataFrame:
    return sets.select("unit", F.explode("phrases").alias("phrase"))


def mention_index(sets: DataFrame) -> DataFrame:
    """(unit, phrase, df): documents of the unit containing the phrase."""
    return _occurrences(sets).groupBy("unit", "phrase").agg(F.count("*").alias("df"))


def frequent_phrases(sets: DataFrame, min_df: int = MIN_DF, min_share: float = MIN_SHARE) -> DataFrame:
    """(unit, phrase, df, n): phrases in at least min_df documents and min_share of the n of their unit.

    Phrases are first counted by hash bucket, at most BUCKETS numbers for each unit and task. A bucket counts
    at least as much as each of its phrases, so those below the gates hold no phrase that passes, and only
    phrases of the other buckets are counted by name. How many buckets pass depends on the distinct phrases
    of an average document, not on the number of documents; they are settled, so that Spark knows their size
    before it deals out the phrases.
    """
    sizes = sets.groupBy("unit").agg(F.count("*").alias("n"))
    gates = lambda c: (c >= min_df) & (c / F.col("n") >= min_share)
    rows = _occurrences(sets).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).cast("int"))
    full = settle(rows.groupBy("unit", "bucket").agg(F.count("*").alias("c")).join(sizes, "unit").where(gates(F.col("c")))
                  .select("unit", "bucket"))
    counts = rows.join(full, ["unit", "bucket"], "left_semi").groupBy("unit", "phrase").agg(F.count("*").alias("df"))
    return counts.join(sizes, "unit").where(gates(F.col("df")))


def distinctive_phrases(sets: DataFrame, min_df: int = MIN_DF, min_share: float = MIN_SHARE,
                        min_lift: float = MIN_LIFT) -> DataFrame:
    """Phrases far more frequent in a unit than overall, by smoothed log-odds. sets: see ``phrase_sets``; it is
    read several times, so a caller settles it.

    Counts over the archive are taken for the frequent phrases alone. At most 1/min_share phrases per average
    distinct phrase of a document can pass the share gate, so what is left of a unit does not grow with its
    number of documents.
    """
    total = sets.agg(F.count("*")).scalar()
    candidates = settle(frequent_phrases(sets, min_df, min_share))
    wanted = candidates.select("phrase").dropDuplicates()
    overall = _occurrences(sets).join(wanted, "phrase", "left_semi").groupBy("phrase").agg(F.count("*").alias("club"))
    joined = candidates.join(overall, "phrase").withColumn("total", total)
    lift = F.ln(((F.col("df") + 0.5) / (F.col("n") + 1)) / ((F.col("club") + 0.5) / (F.col("total") + 1)))
    return joined.withColumn("lift", lift).where(F.col("lift") > min_lift).select(
        "unit", "phrase", F.col("df").alias("reports"), F.col("n").alias("of"),
        (100.0 * F.col("df") / F.col("n")).alias("share"), F.exp("lift").alias("times_club"),
        (F.col("lift") * F.log1p("df")).alias("score"))


def phrase_greedy_dedupe(scored: DataFrame, keep: int = KEEP) -> DataFrame:
    """In score order, drops phrases containing, contained in, or sharing a stem with
    a kept one. The list per unit is bounded by the share gate above."""
    item = F.struct((-F.round("score", 9)).alias("order"), "phrase", stem_phrase(F.col("phrase")).alias("stem"))
    lists = scored.groupBy("unit").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.expr("cast(array() as array<struct<phrase:string,stem:string>>)")

    def step(kept: Column, d: Column) -> Column:
        clash = F.exists(kept, lambda k: F.contains(k["phrase"], d["phrase"]) | F.contains(d["phrase"], k["phrase"])
                         | (k["stem"] == d["stem"]))
        return F.when((F.size(kept) >= keep) | clash, kept).otherwise(F.concat(kept, F.array(
            F.struct(d["phrase"].alias("phrase"), d["stem"].alias("stem")))))

    chosen = lists.select("unit", F.aggregate("items", empty, step).alias("kept"))
    return chosen.select("unit", F.posexplode("kept").alias("i", "k")).select(
        "unit", (F.col("i") + 1).alias("rank"), F.col("k.phrase").alias("phrase"))


def publish_guard(published: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Published tokens that are also parts of names; must be empty."""
    tokens = published.select(F.explode(F.split(F.lower(F.col(column)), "[^a-z']+")).alias("token")).dropDuplicates()
    return tokens.join(names, "token", "left_semi")
