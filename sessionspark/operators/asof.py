"""As-of joins of two tables: each left row with the last right value of its key before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left and the last value of right's rows of the same key with a time before the row's; null where there is none. A right row at the same time counts after.

    Both tables go through one segmented scan, so a key with any share of the rows is many tasks' work. Null values of right are
    passed over; null keys are one key, as in a window; rows without a time come first.
    """
    columns = left.columns
    row = F.struct(*columns).alias("_left")
    rows = left.select(F.col(key), F.col(at), F.lit(0).alias("_side"), row, F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = right.select(F.col(key), F.col(at), F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.col(value).alias("_value"))
    found = scan.running(scan.blocked(rows.unionByName(other), key, at, "_side"), key, {"_last": ("last", F.col("_value"))}, before=True)
    return found.where("_side = 0").select(*(F.col(f"_left.{c}").alias(c) for c in columns), F.col("_last").alias(value))
