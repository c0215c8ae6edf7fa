"""Exact deduplication that keeps the first row by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.materialize import broadcast_if_small, materialize
from quern.operators.ranking import ranked
from quern.operators.stage import Stage


def first_positions(df: DataFrame, key: Column, position: Column) -> DataFrame:
    """key, first, copies: counted map-side first, so a key that a third of all rows share is no problem."""
    return df.groupBy(key.alias("key")).agg(F.min(position).alias("first"), F.count("*").alias("copies"))


def keep_first(df: DataFrame, keys: list[str], position: str) -> Stage:
    """Rows with reason 'duplicate' for all but the first of each key; null keys are equal to each other.

    position is unique and never null. Keys are aggregated to their first positions, and
    only these meet the rows again: wide rows are neither sorted nor shuffled by key, so a
    key that a third of all rows share is one aggregated row.
    """
    firsts = materialize(df.groupBy(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys))).agg(F.min(position).alias("_first")).select("_first"), "firsts")
    joined = df.join(broadcast_if_small(firsts), F.col(position) == F.col("_first"), "left")
    return Stage(joined.withColumn("reason", F.when(F.col("_first").isNull(), "duplicate")).drop("_first"))


def keep_first_kept(stage: Stage, key: str, position: str, reason: str = "duplicate") -> Stage:
    """Deduplicates among rows that passed; rows rejected before stay so, and a missing key is a duplicate.

    position is unique and never null. Position, key and reason are computed and written
    once; what else a row holds is joined to them by position, where it is used at all.
    """
    thin = materialize(stage.rows.select(F.col(position).alias("_at"), F.col(key).alias("_k"), F.col("reason").alias("_why")), "keys")
    passed = F.col("_why").isNull() & (F.coalesce("_k", F.lit("")) != "")
    firsts = materialize(thin.filter(passed).groupBy("_k").agg(F.min("_at").alias("_first")).select("_first"), "firsts")
    decided = thin.join(broadcast_if_small(firsts), F.col("_at") == F.col("_first"), "left")
    decided = decided.select("_at", F.coalesce("_why", F.when(F.col("_first").isNull(), F.lit(reason))).alias("reason"))
    return Stage(stage.rows.drop("reason").join(decided, F.col(position) == F.col("_at")).drop("_at"))


def keep_first_or_invalid(df: DataFrame, key: str, position: str) -> Stage:
    """keep_first among rows with a key that isn't blank; the others get 'schema_error'."""
    bad = F.col(key).isNull() | (F.trim(key) == "")
    return keep_first_kept(Stage(df.withColumn("reason", F.when(bad, "schema_error"))), key, position)


def duplicate_groups(df: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of keys that occur more than once, with copies and rank (from 0) by position within the key.

    Null keys are no key. Ranks come from counts, so a key of very many rows is no task's alone.
    """
    several = broadcast_if_small(materialize(df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated-keys"))
    return ranked(df.join(several, key), [key], position, "rank")


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """rows, distinct_keys, surplus: how far a key is from unique."""
    one = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"))
    return one.withColumn("surplus", F.col("rows") - F.col("distinct_keys"))
