"""Quality rules: ordered conditions that give the first reason or all flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleSet:
    """(reason, condition) pairs; a condition that is null counts as false. A reason may be a column."""

    rules: Sequence[tuple[str | Column, Column]]

    def _named(self) -> list[Column]:
        return [F.when(F.coalesce(cond, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for name, cond in self.rules]

    def first_reason(self) -> Column:
        """Reason of the first rule that holds; null if none does."""
        return F.coalesce(*self._named())

    def all_flags(self) -> Column:
        """Reasons of all rules that hold, in their order."""
        return F.array_compact(F.array(*self._named()))

    def failures(self, df: DataFrame) -> DataFrame:
        """One row per rule: reason and how many rows it holds for, independent of the others."""
        counts = [F.count_if(F.coalesce(cond, F.lit(False))).alias(f"_{n}") for n, (_, cond) in enumerate(self.rules)]
        one = df.agg(*counts)
        return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("reason"), F.col(f"_{n}").alias("rows")) for n, (name, _) in enumerate(self.rules)))).alias("r")).select("r.*")


def blank(c: Column) -> Column:
    """Whether a text is null, empty or white space."""
    return c.isNull() | c.rlike(r"(?U)\A[\s\u00a0]*\z")


def missing(c: Column) -> Column:
    """Whether a text is null or empty."""
    return c.isNull() | (c == "")
