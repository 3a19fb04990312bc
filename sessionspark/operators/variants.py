"""Details as VARIANT: JSON whose shape differs by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, json: str) -> DataFrame:
    """rows with value, the parsed JSON, and broken: there is a text, and it is no JSON."""
    out = rows.withColumn("value", F.try_parse_json(json))
    return out.withColumn("broken", F.col(json).isNotNull() & F.col("value").isNull())


def first_of(value: Column, paths: list[str], kind: str) -> Column:
    """The value at the first of the paths that has one of the kind; null where none has."""
    return F.coalesce(*(F.try_variant_get(value, path, kind) for path in paths))


def shapes(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, how many of its texts are JSON and how many are broken, and the one shape that holds all."""
    found = parsed(rows, json)
    return found.groupBy(key).agg(F.count("value").alias("parsed"), F.count_if("broken").alias("broken"), F.schema_of_variant_agg("value").alias("shape"))
