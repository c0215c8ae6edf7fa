"""Checks of finished buckets: errors, contamination, lengths, repeated keys, a fixed sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.mcq import looks_like_mcq, message
from quern.functions.text import has_markers
from quern.operators.rules import RuleSet, blank
from quern.operators.split import sample_by_key


def chat_errors(task: str, *required: str) -> RuleSet:
    """All errors of a chat record of a task."""
    user, assistant = message(F.col("messages"), "user"), message(F.col("messages"), "assistant")
    m = F.col("metadata")
    return RuleSet([
        ("messages_count", F.coalesce(F.size("messages") != 2, F.lit(True))),
        ("empty_user", blank(user)),
        ("empty_assistant", blank(assistant)),
        *((f"missing_{f}", blank(m[f].cast("string"))) for f in required),
        ("task", ~m["task"].eqNullSafe(F.lit(task))),
    ])


def summary(rows: DataFrame, errors: RuleSet, key: Column) -> DataFrame:
    """One row: rows, invalid, mcq_like, with_markers, repeated_keys."""
    user, assistant = message(F.col("messages"), "user"), message(F.col("messages"), "assistant")
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.size(errors.all_flags()) > 0).alias("invalid"),
        F.count_if(looks_like_mcq(user, assistant)).alias("mcq_like"),
        F.count_if(F.coalesce(has_markers(user) | has_markers(assistant), F.lit(False))).alias("with_markers"),
        (F.count(key) - F.count_distinct(key)).alias("repeated_keys"),
    )


def exit_code(rows: DataFrame, errors: RuleSet) -> int:
    """1 if a row is invalid."""
    return int(not rows.filter(F.size(errors.all_flags()) > 0).isEmpty())


def spot_check(rows: DataFrame, key: Column, n: int = 5, seed: int = 42) -> DataFrame:
    """n rows, the same in every run."""
    return sample_by_key(rows, F.sha1(F.concat(F.lit(f"{seed}/"), key)), n)
