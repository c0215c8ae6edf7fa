"""Instruction records out of instruction rows and dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import pair_key
from quern.functions.mcq import chat, first_exchange, is_mcq_like
from quern.functions.pyudf import nfc
from quern.functions.text import strip_lines, without_markers
from quern.operators.dedup import keep_first_kept
from quern.operators.rules import RuleSet
from quern.operators.split import sample_by_key
from quern.operators.stage import Stage

USER, ASSISTANT = (10, 2000), (10, 4000)


def _checked(rows: DataFrame, first: list[tuple[str, Column]]) -> Stage:
    u, a = F.col("user"), F.col("assistant")
    rules = RuleSet([
        *first,
        ("user_too_short", F.length(u) < USER[0]),
        ("user_too_long", F.length(u) > USER[1]),
        ("assistant_too_short", F.length(a) < ASSISTANT[0]),
        ("assistant_too_long", F.length(a) > ASSISTANT[1]),
        ("mcq_like_contamination", is_mcq_like(u, a)),
    ])
    return Stage(rows.withColumn("reason", rules.first_reason()).withColumn("dedup_hash", pair_key(u, a)))


def single_turns(rows: DataFrame, position: str = "_row_index") -> Stage:
    """instruction (and input after an empty line) to output; the first of equal exchanges kept."""
    text = lambda c: without_markers(strip_lines(nfc(F.col(c))))
    one = rows.withColumns({"_i": text("instruction"), "_n": text("input"), "assistant": text("output")})
    user = F.when(F.col("_n") != "", F.concat("_i", F.lit("\n\n"), "_n")).otherwise(F.col("_i"))
    return keep_first_kept(_checked(one.withColumn("user", user).drop("_i", "_n"), []), "dedup_hash", position)


def dialogues(rows: DataFrame, position: str) -> Stage:
    """The first user message that an assistant's follows directly."""
    pair = rows.withColumn("_p", first_exchange(F.col("messages")))
    text = lambda c: without_markers(strip_lines(nfc(c)))
    one = pair.withColumn("user", text(F.col("_p.user"))).withColumn("assistant", text(F.col("_p.assistant")))
    kept = keep_first_kept(_checked(one, [("no_valid_user_assistant_pair", F.col("_p").isNull())]), "dedup_hash", position)
    return Stage(kept.rows.drop("_p"))


def records(kept: DataFrame, turn_type: str, source_dataset: str, cap: int, seed: int = 42) -> DataFrame:
    """A capped sample as chat records, in the order of a salted content key."""
    chosen = sample_by_key(kept, F.sha1(F.concat(F.lit(f"{seed}/"), "dedup_hash")), cap)
    meta = F.struct(F.lit("instruction_retention").alias("task"), F.lit("public").alias("source"), F.lit(source_dataset).alias("source_dataset"), F.lit("vi").alias("language"), F.lit(turn_type).alias("turn_type"), F.col("dedup_hash"))
    return chosen.select(chat(F.col("user"), F.col("assistant")).alias("messages"), meta.alias("metadata"))
