"""From raw documents to token samples: corpus operators in a row, each on all that its predecessor kept."""
from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import discard, settle, settled_tables
from fieldledger.llm.decontaminate import keep_uncontaminated
from fieldledger.llm.lines import remove_boilerplate
from fieldledger.llm.pieces import sampled_segmentations
from fieldledger.llm.simhash import keep_one
from fieldledger.llm.toxicity import keep_clean


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_used: list[DataFrame] = []          # tables behind the result of the stage that ran last


def releasing(stage: Stage) -> Stage:
    """First deletes the tables that the stage before had settled: its result has been written and reread by then."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*(t for t in _used if t.sparkSession is spark))
        _used.clear()
        with settled_tables() as used:
            out = stage(spark, docs, sf_dir)
        _used.extend(used)
        return out
    return run_stage


@releasing
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents scored as toxic. Labels of held-out ids are not learned from."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@releasing
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that stand on many sources, but for their first document; n_chars follows the text."""
    return (remove_boilerplate(docs).drop("n_lines_removed")
            .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


@releasing
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more between sets of five-word shingles."""
    return keep_one(docs)


@releasing
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which benchmark passages make up a twentieth or more."""
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@releasing
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, with their scores, and whether they decode to it."""
    return sampled_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", encoding)]
ORACLE_SQL: str | None = None          # fingerprints and trained scores are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        if hasattr(before, "settled_at"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
