"""All buckets together: deduplicated across them and split within each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import record_key
from quern.operators.dedup import keep_first
from quern.operators.materialize import materialize
from quern.operators.split import capped_parts, split_groups
from quern.operators.stage import Stage
from quern.schema import GROUP_A, GROUP_B

THREE_WAY, TWO_WAY = (("train", 0.90), ("val", 0.05)), (("train", 0.95),)


def together(buckets: list[DataFrame], group_key: str | None = None) -> DataFrame:
    """messages, task, key and position (file order, then order of the rows' pos) of all buckets, and group out of the column group_key."""
    out = None
    for n, b in enumerate(buckets):
        one = b.select("messages", F.coalesce("metadata.task", F.lit("unknown")).alias("task"), F.concat(F.format_string("%03d/", F.lit(n)), F.lpad(F.col("pos").cast("string"), 20, "0")).alias("position"), *([F.col(group_key).cast("string").alias("group")] if group_key else []))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("key", record_key(F.col("messages")))


def split(rows: DataFrame, seed: int = 42, cap_per_task: int | None = None) -> Stage:
    """rows with a column split: train, val, shadow, probe; duplicates and unknown tasks are rejects.

    The order within a task is that of a salted content key: new rows don't shuffle the
    others. If the rows have a column group, rows of one group stay in one split, so that
    sizes are those nearest to the shares that whole groups allow; a null group is none.
    With cap_per_task, training rows of a task beyond so many get the reason 'over_cap'.
    """
    unique = keep_first(rows, ["key"], "position")
    known = F.col("task").isin(*GROUP_A, *GROUP_B)
    marked = unique.rows.withColumn("reason", F.coalesce("reason", F.when(~known, "unknown_task")))
    good = marked.filter("reason is null")
    order = F.sha1(F.concat(F.lit(f"{seed}/"), F.coalesce("group", "key") if "group" in rows.columns else F.col("key")))
    a = split_groups(good.filter(F.col("task").isin(*GROUP_A)), "task", order, THREE_WAY, "shadow")
    b = split_groups(good.filter(F.col("task").isin(*GROUP_B)), "task", order, TWO_WAY, "probe")
    parts = a.unionByName(b)
    if cap_per_task is not None:
        parts = materialize(parts, "parts")
        kept = capped_parts(parts, "split", "task", "key", cap_per_task).select(F.col("position").alias("_kept"))
        over = parts.join(kept, F.col("position") == F.col("_kept"), "left").withColumn("reason", F.when(F.col("_kept").isNull(), "over_cap"))
        parts = over.withColumn("split", F.when(F.col("reason").isNull(), F.col("split"))).drop("_kept").select(parts.columns)
    return Stage(parts.unionByName(marked.filter("reason is not null").withColumn("split", F.lit(None).cast("string"))))


def manifest(stage: Stage) -> DataFrame:
    """task, split, reason, rows."""
    return stage.rows.groupBy("task", "split", "reason").agg(F.count("*").alias("rows"))
