"""Profiles of corpora: percentiles by rank, n-grams, length bias, templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import TEMPLATES, ngrams
from quern.operators.materialize import materialize
from quern.operators.ranking import sliced


def rank_percentiles(df: DataFrame, value: Column, points: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One column per point: the value at index floor(n * p) of the sorted values, and max_value; null for an empty table.

    Nulls are left out. Works on counts of distinct values, cut in ranges: sums of the
    ranges, of which there are few, give the range a point is in, and each range is summed
    up on its own.
    """
    counts = sliced(materialize(df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n")), "value-counts"), "v")
    sums = counts.groupBy("_slice").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("_slice").alias("_s"), before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    upto = F.sum("n").over(Window.partitionBy("_slice").orderBy("v"))
    joined = counts.withColumn("_upto", upto).join(F.broadcast(offsets), F.col("_slice") == F.col("_s")).withColumn("upto", F.col("_before") + F.col("_upto"))
    return joined.agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("_total") * F.lit(float(p))), F.col("v"))).alias(f"p{round(p * 100)}") for p in points), F.max("v").alias("max_value"))


def ngram_counts(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """ngram, rows: how often each n-gram occurs, repetitions within a row included."""
    return df.select(F.explode(ngrams(tokens, n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("rows"))


def lexical_diversity(df: DataFrame, tokens: Column) -> DataFrame:
    """total_tokens, unique_tokens, ratio: counted by word first."""
    counts = df.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.count("*").alias("unique_tokens")).withColumn("ratio", F.round(F.col("unique_tokens") / F.nullif(F.col("total_tokens"), F.lit(0)), 4))


def template_rates(df: DataFrame, question: Column) -> DataFrame:
    """template, rows, percent of all rows."""
    low = F.lower(question)
    one = df.agg(F.count("*").alias("all"), *(F.count_if(low.rlike(p)).alias(k) for k, p in TEMPLATES.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("template"), F.col(k).alias("rows"), F.round(100.0 * F.col(k) / F.nullif(F.col("all"), F.lit(0)), 2).alias("percent")) for k in TEMPLATES))).alias("t")).select("t.*")


def longest_label(lengths: dict[str, Column]) -> Column:
    """Label of the longest choice; of equal ones the first."""
    best = F.array_max(F.array(*(F.struct(c.alias("n"), F.lit(-k).alias("o"), F.lit(x).alias("label")) for k, (x, c) in enumerate(lengths.items()))))
    return best["label"]


def value_counts(df: DataFrame, column: Column, name: str = "value") -> DataFrame:
    """value (null included), rows."""
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("rows"))


def before_after(df: DataFrame, group: Column, kept: Column, name: str = "subject") -> DataFrame:
    """group, before, after, dropped, dropped_percent."""
    g = df.groupBy(group.alias(name)).agg(F.count("*").alias("before"), F.count_if(kept).alias("after"))
    return g.withColumn("dropped", F.col("before") - F.col("after")).withColumn("dropped_percent", F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 2))
