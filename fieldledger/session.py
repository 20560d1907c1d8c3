"""Session settings shared by the bench, the tests and stand-alone use."""
from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# Values suited to wide aggregations over many groups. None of them changes a
# result; a cluster's own defaults win when the session already exists.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Exact percentiles keep one small map per group; raise the number of
    # groups held in memory before the aggregate falls back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def local_session(app: str, cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names. Where it is unset, a temporary one in
    local mode, removed at the end; on a cluster an error, as executors would not share it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fieldledger-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
        atexit.register(shutil.rmtree, configured, True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured
