"""Exact ranks within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.materialize import broadcast_if_small, materialize, rows_of

#: Rows that one task orders.
SLICE = 100_000


def sliced(df: DataFrame, *order: str, rows: int | None = None) -> DataFrame:
    """df, written, with a column _slice: its rows in ranges of the order, about SLICE in each.

    What is first in the order has the lower slice; equal values share one.
    """
    n = (df.count() if rows_of(df) is None else rows_of(df)) if rows is None else rows
    return materialize(df.repartitionByRange(max(1, -(-n // SLICE)), *order).withColumn("_slice", F.spark_partition_id()), "slices")


def ranked(df: DataFrame, group: list[str], order: str, to: str = "rank") -> DataFrame:
    """df with each row's place (from 0) within its group by the order, which should be unique.

    Rows are cut in ranges of (group, order); counts of the ranges give where each begins,
    and only rows of one range are ordered together. Rows of equal order within a group
    get different places, in no certain order. Null groups are a group.
    """
    cut = sliced(materialize(df, "ranked"), *group, order)
    counts = cut.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select(*(F.col(g).alias(f"_g{n}") for n, g in enumerate(group)), F.col("_slice").alias("_s"), before.alias("_before")), "offsets")
    same = F.col("_slice") == F.col("_s")
    for n, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{n}"))
    place = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(order)) - 1
    return cut.withColumn("_place", place).join(broadcast_if_small(offsets), same).withColumn(to, F.col("_before") + F.col("_place")).select(*df.columns, to)


def permuted_key(id_column: Column, seed: int = 42) -> Column:
    """A pseudo-random 64-bit key per row: ordering by it permutes the rows the same way in every run."""
    return F.xxhash64(F.lit(seed), id_column)


def take_by_permutation(df: DataFrame, group: list[str], id_column: str, quotas: DataFrame, quota: str = "quota", seed: int = 42) -> DataFrame:
    """The first quota rows of each group in permuted order, quota 0 or no quota meaning none.

    Rows are ranked in two steps: counts per slice of the key range give the slice in which
    the quota ends, and only rows of that slice are ordered. There are as many slices as
    leave about SLICE rows in each, so a group that holds a third of all rows is counted
    map-side and one slice of it is sorted; the order is that of the key read without sign,
    however many there are. Ties of the key are ordered by id. Groups with a null part are
    groups like others.
    """
    slices = max(256, 1 << (df.count() // SLICE).bit_length())
    key = permuted_key(F.col(id_column), seed)
    keyed = df.withColumn("_key", key).withColumn("_slice", F.floor((F.shiftrightunsigned(F.col("_key"), 32)) / (2**32 / slices)).cast("int"))
    names = [f"_g{n}" for n in range(len(group))]
    counts = keyed.groupBy(*(F.col(g).alias(n) for g, n in zip(group, names)), "_slice").agg(F.count("*").alias("_n"))
    wanted = quotas.select(*(F.col(g).alias(f"_q{n}") for n, g in enumerate(group)), F.col(quota).cast("bigint").alias("_quota"))
    upto = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    same = F.lit(True)
    for n, g in enumerate(names):
        same = same & F.col(g).eqNullSafe(F.col(f"_q{n}"))
    plan = offsets.join(wanted, same).filter("_before < _quota").select(*names, F.col("_slice").alias("_s"), (F.col("_quota") - F.col("_before")).alias("_left"), "_n")
    match = F.col("_slice") == F.col("_s")
    for n, g in zip(names, group):
        match = match & F.col(g).eqNullSafe(F.col(n))
    near = keyed.join(plan, match)
    whole = near.filter("_n <= _left").select(df.columns)
    order = Window.partitionBy(*names, "_s").orderBy("_key", id_column)
    cut = near.filter("_n > _left").withColumn("_rank", F.row_number().over(order)).filter("_rank <= _left").select(df.columns)
    return whole.unionByName(cut)
