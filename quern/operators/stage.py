"""What every stage returns: kept rows, rejected rows with a reason, and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import preview


@dataclass(frozen=True)
class Stage:
    """rows with a column reason; null in kept rows. Nothing is computed until a part is used."""

    rows: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.rows.filter("reason is null").drop("reason")

    @property
    def rejects(self) -> DataFrame:
        return self.rows.filter("reason is not null")

    def reject_rows(self, previews: dict[str, Column], n: int = 200) -> DataFrame:
        """reason and previews of n characters; missing values are 'unknown'."""
        return self.rejects.select("reason", *(F.coalesce(F.nullif(preview(c, n), F.lit("")), F.lit("unknown")).alias(k) for k, c in previews.items()))

    def report(self, *by: str) -> DataFrame:
        """reason (null for kept), the columns of by, rows."""
        return self.rows.groupBy("reason", *by).agg(F.count("*").alias("rows"))

    def totals(self) -> DataFrame:
        """loaded, kept, rejected, kept_percent."""
        one = self.rows.agg(F.count("*").alias("loaded"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("rejected"))
        return one.withColumn("kept_percent", F.round(100.0 * F.col("kept") / F.nullif(F.col("loaded"), F.lit(0)), 2))


def capped_rejects(stage: Stage, position: str, cap: int = 1000, silent: tuple[str, ...] = ("duplicate",)) -> DataFrame:
    """The first cap rejects by position; those of the silent reasons are counted elsewhere and not listed."""
    return stage.rejects.filter(~F.col("reason").isin(*silent)).orderBy(position).limit(cap)


def expect(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df; using it fails with the message at the first row for which the condition isn't true."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def expect_unique(df: DataFrame, key: str, message: str = "duplicate key") -> DataFrame:
    """df; using it fails if a non-null key occurs twice."""
    bad = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").agg(F.count("*").alias("_bad"))
    checked = expect(bad, F.col("_bad") == 0, message)
    return df.join(F.broadcast(checked), F.lit(True)).drop("_bad")
