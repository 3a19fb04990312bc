"""Tables in key-hashed parts, of which a change rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from .stored import stored

PART = "_part"


class KeyedTable:
    """A parquet table at path with one row for each key, in n_parts folders by the key's hash.

    A change reads the folders of its own keys, writes them anew (dynamic partition overwrite) and leaves the others' files as
    they are. A job that dies before its commit changes nothing; one that dies within it may have replaced some folders only, and
    is run again with the same changes to the same end. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, n_parts: int) -> None:
        self.spark, self.path, self.key, self.n_parts = spark, path, key, n_parts

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_parts)).cast("int").alias(PART)

    def _key(self, value: Column) -> Column:
        """A key in the table's type, on which its hash depends."""
        return value.cast(self.spark.read.parquet(self.path).schema[self.key].dataType)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition(PART).write.partitionBy(PART).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows.select("*", self._part(F.col(self.key))), "errorifexists")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(PART)

    def get(self, value) -> DataFrame:
        """The row of a key; only its folder is read."""
        part = self.spark.range(1).select(self._part(self._key(F.lit(value)))).first()[0]
        return self.spark.read.parquet(self.path).where((F.col(PART) == part) & (F.col(self.key) == value)).drop(PART)

    def _change(self, changes: DataFrame, rule) -> None:
        changes = changes.withColumn(self.key, self._key(F.col(self.key)))
        held = stored(changes.select("*", self._part(F.col(self.key))), "changes")
        repeated = held.groupBy(self.key).count().where("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"changes hold the key {repeated[0][0]} more than once")
        touched = [r[0] for r in held.select(PART).distinct().collect()]  # at most n_parts
        if touched:
            old = self.spark.read.parquet(self.path).where(F.col(PART).isin(touched))
            # Written apart first, as the folders that are read are replaced.
            self._write(stored(rule(old, held), "parts").select(*old.columns), "overwrite")

    def upsert(self, changes: DataFrame) -> None:
        """Replace the rows of the changes' keys, and add new ones; the columns agree."""
        self._change(changes, lambda old, new: lifecycle.upsert(old, new, self.key))

    def update_fields(self, changes: DataFrame, fields: list[str]) -> None:
        """Replace the named fields of the changes' keys; unknown keys add nothing."""
        self._change(changes, lambda old, new: lifecycle.update_fields(old, new, self.key, fields))

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of keys (one column, the key). A folder left without rows keeps its place with an empty file."""

        def rule(old: DataFrame, gone: DataFrame) -> DataFrame:
            return old.join(gone.select(self.key), self.key, "left_anti")

        held = keys.select(self.key).distinct()
        self._change(held, rule)
        # Dynamic overwrite doesn't touch a folder that gets no row.
        self._drop_emptied(held)

    def _drop_emptied(self, keys: DataFrame) -> None:
        left = self.spark.read.parquet(self.path).join(keys, self.key, "left_semi").select(PART).distinct().collect()
        for (part,) in left:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={part}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
