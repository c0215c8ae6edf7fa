"""Deterministic splits, caps and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.materialize import broadcast_if_small, materialize
from quern.operators.ranking import SLICE, take_by_permutation


def split_groups(df: DataFrame, group: str, order: Column, parts: Sequence[tuple[str, float]], rest: str) -> DataFrame:
    """df with column split: the first floor(n * share) rows of each group per part, the remainder as rest.

    order is a hexadecimal string, such as a salted content key; null keys come first and
    rows of equal keys stay together, in the earlier part. Only the keys at which a part
    ends are looked for: counts per leading digits, as many as leave about SLICE rows,
    give the slice it ends in, and that slice alone is ordered. Rows are then compared
    with these keys, without a shuffle while the groups are few. Null groups are a group.
    """
    keyed = materialize(df.select(F.col(group).alias("_g"), F.coalesce(order, F.lit("")).alias("_o")), "split-keys")
    total = broadcast_if_small(materialize(keyed.groupBy("_g").agg(F.count("*").alias("_total")), "split-totals"))
    largest = total.agg(F.max("_total")).first()[0] or 0
    digits = 1
    while largest > SLICE * 16**digits:
        digits += 1
    keyed = keyed.withColumn("_s", F.left("_o", F.lit(digits)))
    counts = keyed.groupBy("_g", "_s").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("_g").orderBy("_s")
    offsets = counts.withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
    offsets = offsets.join(total.withColumnRenamed("_g", "_tg"), F.col("_g").eqNullSafe(F.col("_tg"))).drop("_tg")
    ends, upto = [], F.lit(0).cast("bigint")
    for n, (_, share) in enumerate(parts):
        upto = upto + F.floor(F.col("_total") * F.lit(float(share)))
        ends.append(F.struct(F.lit(n).alias("part"), upto.alias("end")))
    cuts = offsets.withColumn("_e", F.explode(F.array(*ends))).filter("_e.end > _before and _e.end <= _before + _n")
    cuts = broadcast_if_small(materialize(cuts.select(F.col("_g").alias("_cg"), F.col("_s").alias("_cs"), "_e.part", (F.col("_e.end") - F.col("_before")).alias("_k")), "split-cuts"))
    at_cut = keyed.join(cuts.select("_cg", "_cs").distinct(), F.col("_g").eqNullSafe(F.col("_cg")) & (F.col("_s") == F.col("_cs"))).drop("_cg", "_cs")
    placed = at_cut.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_s").orderBy("_o")))
    last = placed.join(cuts, F.col("_g").eqNullSafe(F.col("_cg")) & (F.col("_s") == F.col("_cs")) & (F.col("_r") == F.col("_k")))
    bounds = last.groupBy(F.col("_g").alias("_bg")).agg(*(F.max(F.when(F.col("part") == n, F.col("_o"))).alias(f"_b{n}") for n in range(len(parts))))
    bounds = broadcast_if_small(materialize(bounds, "split-bounds"))
    own = df.withColumn("_o", F.coalesce(order, F.lit(""))).join(bounds, F.col(group).eqNullSafe(F.col("_bg")), "left")
    cond = F.when(F.lit(False), "")
    for n, (name, _) in enumerate(parts):
        cond = cond.when(F.col("_o") <= F.col(f"_b{n}"), name)
    return own.withColumn("split", cond.otherwise(rest)).drop("_o", "_bg", *(f"_b{n}" for n in range(len(parts))))


def sample_by_key(df: DataFrame, order: Column, n: int) -> DataFrame:
    """n rows in the order of a hash: the same sample in every run, whatever the partitions."""
    return df.orderBy(order).limit(n)


def capped_parts(df: DataFrame, part: str, task: str, key: str, cap: int, cap_part: str = "train") -> DataFrame:
    """df without the rows of cap_part beyond cap of each task: no task has more in the mix.

    Which stay is decided by a permutation of the column key, unique within a task; a task
    with fewer rows keeps all, rows of other parts all stay.
    """
    own = F.coalesce(F.col(part) == cap_part, F.lit(False))
    quotas = df.filter(own).select(task).distinct().withColumn("quota", F.lit(cap))
    return df.filter(~own).unionByName(take_by_permutation(df.filter(own), [task], key, quotas))


def accepted_prefix(df: DataFrame, accepted: Column, position: str, cap: int) -> DataFrame:
    """The rows up to the one with the cap-th accepted row, by position: what a reader sees that stops there.

    Counts per range of positions, as many as leave about SLICE rows in each, find the
    range in which the cap is reached; only that range is ordered.
    """
    span = materialize(df.agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count("*").alias("_all")), "span")
    slices = max(1024, span.first()["_all"] // SLICE)
    span = span.drop("_all")
    ranged = df.join(F.broadcast(span), F.lit(True)).withColumn("_s", F.floor((F.col(position) - F.col("lo")) * slices / (F.col("hi") - F.col("lo") + 1)))
    counts = ranged.groupBy("_s").agg(F.count_if(accepted).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < cap)
    kept = ranged.join(F.broadcast(before.withColumnRenamed("_s", "_s2")), F.col("_s") == F.col("_s2"))
    whole = kept.filter(F.col("_before") + F.col("_n") < cap)
    order = Window.partitionBy("_s").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    cut = kept.filter(F.col("_before") + F.col("_n") >= cap).withColumn("_seen", F.col("_before") + F.coalesce(F.sum(accepted.cast("int")).over(order), F.lit(0))).filter(F.col("_seen") < cap)
    return whole.select(df.columns).unionByName(cut.select(df.columns))
