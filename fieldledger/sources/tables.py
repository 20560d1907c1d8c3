"""Intermediate tables that several later steps read."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to the shared checkpoint folder and reads it back.

    Used where a costly pass feeds several small steps: the pass runs once, and a
    lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt evenly over the session's shuffle partitions, for rows that cost far more
    to work on than to move: long patterns over texts, pages rendered from narrow rows. It is
    the same plan at every size."""
    return scan.repartition(int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
