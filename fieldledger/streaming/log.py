"""An update log that is merged as it grows: the latest row of each key over all micro-batches.

Batches are folded like digits of a number in base FAN. Every FAN batches their rows become one segment, every
FAN such segments the next larger one, and so on. A row is so written again once for each power of FAN, a reader
meets at most FAN - 1 segments of each size, and which segments make up a log of n batches follows from n alone.
That number is the manifest: a small file of its own, committed after the segments it stands for. Until then
readers and a restarted stream use the segments of the number before, which are deleted one batch later.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import upsert_latest

FAN = 8


def layout(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The segments, as (first batch, end), of a log of that many batches, largest first."""
    size = 1
    while size * fan <= batches:
        size *= fan
    segments, at = [], 0
    while at < batches:
        while at + size > batches:
            size //= fan
        segments.append((at, at + size))
        at += size
    return segments


class UpdateLog:
    """The log in a folder. A row replaces those of its keys that are smaller by `order`.

    A batch given again, after a failure at any point, changes nothing. Readers that began before a batch was
    committed finish on the segments they found. An empty batch counts as one. One stream writes to a folder.
    """

    def __init__(self, folder: str, schema: StructType, keys: list[str], order: list[str], fan: int = FAN):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.folder, self.schema, self.keys, self.order, self.fan = folder, schema, keys, order, fan

    def batches(self, spark: SparkSession) -> int:
        """How many batches are committed."""
        manifest = f"{self.folder}/manifest"
        if not _names(spark, manifest):
            return 0
        return spark.read.schema("batches bigint").option("recursiveFileLookup", True).json(manifest).agg(F.coalesce(F.max("batches"), F.lit(0))).first()[0]

    def segments(self, spark: SparkSession, among: list[tuple[int, int]]) -> DataFrame:
        if not among:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(self._place(s) for s in among))

    def latest(self, spark: SparkSession) -> DataFrame:
        """The newest row of each key over all committed batches."""
        return upsert_latest(self.segments(spark, layout(self.batches(spark), self.fan)), self.keys, self.order).select(*self.schema.names)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a micro-batch; batches are numbered from 0 without a gap, as streams do."""
        spark = batch.sparkSession
        known = self.batches(spark)
        if batch_id < known:
            return
        if batch_id > known:
            raise ValueError(f"batch {batch_id} after {known} batches")
        before, after = layout(known, self.fan), layout(known + 1, self.fan)
        merged = [s for s in before if s not in after]
        rows = self.segments(spark, merged).unionByName(batch.select(*self.schema.names)) if merged else batch
        upsert_latest(rows, self.keys, self.order).select(*self.schema.names).write.mode("overwrite").parquet(self._place(after[-1]))
        self._commit(spark, known + 1)
        self._clear(spark, {*before, *after}, known)

    def _place(self, segment: tuple[int, int]) -> str:
        return f"{self.folder}/rows/{segment[0]}-{segment[1]}"

    def _commit(self, spark: SparkSession, batches: int) -> None:
        spark.createDataFrame([(batches,)], "batches bigint").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/at-{batches}")

    def _clear(self, spark: SparkSession, used: set[tuple[int, int]], known: int) -> None:
        """Deletes what neither this state of the log nor the one before it uses."""
        kept = {f"{a}-{b}" for a, b in used}
        for name in _names(spark, f"{self.folder}/rows"):
            if name not in kept:
                _delete(spark, f"{self.folder}/rows/{name}")
        for name in _names(spark, f"{self.folder}/manifest"):
            if name not in (f"at-{known}", f"at-{known + 1}"):
                _delete(spark, f"{self.folder}/manifest/{name}")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    system, place = _files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _files(spark, path)
    system.delete(place, True)
