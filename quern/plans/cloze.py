"""Next-word records out of raw texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import plain_pair_key
from quern.functions.mcq import NEXT_WORD, chat
from quern.functions.pyudf import nfc
from quern.functions.text import clean_text, words
from quern.operators.dedup import keep_first_kept
from quern.operators.rules import RuleSet, missing
from quern.operators.split import accepted_prefix
from quern.operators.stage import Stage

MIN_WORDS, MAX_WORDS, CAP = 20, 100, 10_000


def pairs(texts: DataFrame, text: Column, low: int = MIN_WORDS, high: int = MAX_WORDS) -> Stage:
    """Columns user, assistant and dedup_hash; reasons carry the word count where it is out of range."""
    w = texts.withColumn("_t", clean_text(nfc(text))).withColumn("_w", words("_t")).withColumn("_n", F.size("_w"))
    target = F.regexp_replace(F.coalesce(F.try_element_at("_w", F.lit(-1)), F.lit("")), r"""[.,!?"':;]+\z""", "")
    w = w.withColumn("assistant", target)
    count = F.col("_n").cast("string")
    rules = RuleSet([
        ("empty_text", missing(text)),
        (F.concat(F.lit("too_short_"), count), F.col("_n") < low),
        (F.concat(F.lit("too_long_"), count), F.col("_n") > high),
        ("empty_target_after_cleaning", F.col("assistant") == ""),
        ("invalid_target_word", ~F.col("assistant").rlike(r"\A\p{L}+\z")),
    ])
    user = F.concat(F.lit(NEXT_WORD + "\n\n"), F.array_join(F.slice("_w", 1, F.greatest(F.col("_n") - 1, F.lit(0))), " "), F.lit("..."))
    out = w.withColumn("reason", rules.first_reason()).withColumn("user", user)
    return Stage(out.withColumn("dedup_hash", plain_pair_key(F.col("user"), F.col("assistant"))).drop("_t", "_w", "_n"))


def stage(documents: DataFrame, position: str = "doc_id", text: str = "text", low: int = MIN_WORDS, high: int = MAX_WORDS) -> Stage:
    """pairs without repeated ones."""
    return keep_first_kept(pairs(documents, F.col(text), low, high), "dedup_hash", position)


def capped(documents: DataFrame, cap: int = CAP, position: str = "doc_id") -> Stage:
    """stage over the prefix that a reader sees who stops at the cap."""
    rows = stage(documents, position).rows
    return Stage(accepted_prefix(rows, F.col("reason").isNull(), position, cap))


def records(kept: DataFrame, source_id: str = "id", domain: str = "domain", source_dataset: str = "corpus") -> DataFrame:
    """Chat records."""
    meta = F.struct(F.lit("cloze_lm_retention").alias("task"), F.lit("public").alias("source"), F.lit(source_dataset).alias("source_dataset"), F.col(source_id).cast("string").alias("source_id"), F.col(domain).alias("domain"), F.lit("vi").alias("language"), F.lit("easy").alias("difficulty"), F.col("dedup_hash"))
    return kept.select(chat(F.col("user"), F.col("assistant")).alias("messages"), meta.alias("metadata"))
