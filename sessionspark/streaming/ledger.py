"""An exactly-once writer for foreachBatch: a batch's data counts from the moment that its id is in the ledger.

A batch is written to a folder of its own, replacing what a killed try left there, and then its id is entered by creating a file
that must not exist. A replay of an entered batch does nothing. Readers take the folders of entered batches only, so the data of a
batch that died before its entry is never seen, and is written anew by the replay. Rows are dealt by key, so that one task writes
all of a key's rows of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import THRESHOLD


class Ledger:
    """Batches at path: data in path/data/batch=<id>, the ledger in path/ledger/<id>."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entered(self) -> list[int]:
        """Ids of the batches that count."""
        p, files = self._file("ledger")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(p)) if files.exists(p) else []

    def _enter(self, batch: int) -> None:
        p, files = self._file("ledger", str(batch))
        files.create(p, False).close()

    def write(self, rows: DataFrame, batch: int, key: str) -> bool:
        """Write a batch and enter it; False, and nothing done, where it was entered before."""
        p, files = self._file("ledger", str(batch))
        if files.exists(p):
            return False
        rows.repartition(F.col(key)).write.mode("overwrite").parquet(f"{self.path}/data/batch={batch}")
        self._enter(batch)
        return True

    def rows(self, schema: str) -> DataFrame:
        """All rows of entered batches, with their batch."""
        paths = [f"{self.path}/data/batch={b}" for b in self.entered()]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)


STRIKES = "interview_id long, strikes long, last_event long"


def strike_writer(ledger: Ledger) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for reports (event_id, interview_id, confidence): adds each batch's strikes by interview."""

    def write(rows: DataFrame, batch: int) -> None:
        counted = rows.where((F.col("confidence") >= THRESHOLD) & F.col("interview_id").isNotNull()).groupBy("interview_id").agg(F.count(F.lit(1)).alias("strikes"), F.max("event_id").alias("last_event"))
        ledger.write(counted, batch, "interview_id")

    return write


def strike_counts(ledger: Ledger) -> DataFrame:
    """interview_id and strikes over all batches that count."""
    return ledger.rows(STRIKES).groupBy("interview_id").agg(F.sum("strikes").alias("strikes"), F.max("last_event").alias("last_event"))
