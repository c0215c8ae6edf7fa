"""Sinks: JSON lines, reports, CSV and TSV, with a check by reading again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, position: str | None = None) -> None:
    """One JSON object per line, nulls written; ordered by position, which is left out.

    The files are as many as the sorted partitions; their names keep the order.
    """
    if position:
        df = df.repartitionByRange(position).sortWithinPartitions(position).drop(position)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep).csv(path)


def report(counts: DataFrame, limit: int = 10_000) -> str:
    """A small table of counts as indented JSON; more than limit rows are an error, never cut: such a table is to be written as rows."""
    rows = [json.loads(x) for x in counts.toJSON().take(limit + 1)]
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows: use write_jsonl")
    return json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True)


def write_report(counts: DataFrame, path: str) -> None:
    """report as a text file through Spark, so that it lands where the cluster's files are; a long one as JSON lines instead."""
    spark = counts.sparkSession
    try:
        text = report(counts)
    except ValueError:
        write_jsonl(counts, path)
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def written(df: DataFrame, path: str, fmt: str = "parquet", rows: int | None = None) -> DataFrame:
    """Writes df, reads it again, and fails if the rows aren't as many."""
    n = df.count() if rows is None else rows
    df.write.mode("overwrite").format(fmt).save(path)
    again = df.sparkSession.read.schema(df.schema).format(fmt).load(path)
    if (m := again.count()) != n:
        raise RuntimeError(f"{path}: {n} rows written, {m} read")
    return again
