"""Checks of written rows: each rule is a column expression, and all are counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.documents import MAX_BYTES

# Suffixes that an upload may have.
SUFFIXES = ["pdf", "docx", "txt"]


def one_of(value: Column, choices: list[str]) -> Column:
    return value.isin(choices)


def within(value: Column, low: float, high: float) -> Column:
    return value.between(low, high)


def ordered(start: Column, end: Column) -> Column:
    """The end isn't before the start; holds where either is missing."""
    return start.isNull() | end.isNull() | (end >= start)


def upload(name: Column, n_bytes: Column) -> Column:
    """A file of a known suffix (in any case) and at most MAX_BYTES."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(SUFFIXES) & (n_bytes <= MAX_BYTES)


def numbered(struck: Column, number: Column) -> Column:
    """A report that gave a strike has its number."""
    return ~struck | number.isNotNull()


def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, checked and broken of every rule; a rule that gives null counts as broken."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{k}") for k, ok in enumerate(rules.values())))
    listed = F.array(*(F.struct(F.lit(name).alias("rule"), F.col("n").alias("checked"), F.col(f"_{k}").alias("broken")) for k, name in enumerate(rules)))
    return counts.select(F.explode(listed).alias("r")).select("r.*")
