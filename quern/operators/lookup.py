"""Joins with several keys in turn, and updates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[Column], position: Column) -> DataFrame:
    """key, row: per key the first row by position; every row is found under each of its keys."""
    row = F.struct(*df.columns)
    long = df.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), position.alias("_p"), row.alias("row")).filter("key <> ''")
    return long.groupBy("key").agg(F.min_by("row", "_p").alias("row"))


def fallback_join(left: DataFrame, index: DataFrame, probes: list[Column], to: str = "match") -> DataFrame:
    """left with the row of the first probe that the index has; null if none has.

    index: key (unique), row. Left rows stay as many as they are.
    """
    out = left
    for n, probe in enumerate(probes):
        side = index.select(F.col("key").alias(f"_k{n}"), F.col("row").alias(f"_m{n}"))
        out = out.join(side, probe == F.col(f"_k{n}"), "left")
    return out.withColumn(to, F.coalesce(*(F.col(f"_m{n}") for n in range(len(probes))))).drop(*(f"_k{n}" for n in range(len(probes))), *(f"_m{n}" for n in range(len(probes))))


def last_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the last by position."""
    row = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.max_by(row, position).alias("_r")).select(key, "_r.*")


def update(left: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """left with the column replaced where changes (key unique, value) has the key."""
    return left.join(changes.select(F.col(key).alias("_key"), F.col("value").alias("_value")), F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce("_value", column)).drop("_key", "_value")


def batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """batch, rows (array): consecutive rows in lots of size; positions count from 0 without gaps."""
    return df.groupBy(F.floor(F.col(position) / size).alias("batch")).agg(F.sort_array(F.collect_list(F.struct(position, *(c for c in df.columns if c != position)))).alias("rows"))
