"""Texts that look the same but are written with other characters.

Wide, narrow and joined compatibility forms are resolved, characters composed, unusual
spaces mapped, invisible characters removed and look-alike letters unified
(forms.visual_form); all other compatibility forms and letter case, which a reader can
tell apart, are resolved if they are asked to be. Texts made only of
characters that the form never changes keep their own value on the JVM side; only the
others go through Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import plain_class, visual_form
from quern.operators.materialize import broadcast_if_small, materialize, rows_of, salted_join


def _forms(fold_case: bool, compatibility: bool):
    @F.pandas_udf("string")
    def forms(texts: pd.Series) -> pd.Series:
        distinct = {t: visual_form(t, fold_case, compatibility) for t in texts.unique() if t is not None}
        return texts.map(distinct.get)

    return forms


def has_odd_characters(text: Column) -> Column:
    """Whether the visual form of a text may differ from it; null for null."""
    return text.rlike("[^" + plain_class()[1:])


def one_form(df: DataFrame, column: str, to: str, fold_case: bool = False, compatibility: bool = False) -> DataFrame:
    """df with the column's visual form in column to.

    Null gives null, empty gives empty. With compatibility, all compatibility forms are
    resolved; with fold_case, letters are case-folded.
    """
    odd = F.lit(True) if fold_case or compatibility else has_odd_characters(F.col(column))
    return df.withColumn(to, F.coalesce(_forms(fold_case, compatibility)(F.when(odd, F.col(column))), F.col(column)))


def _hash(c: Column) -> Column:
    """128 bits as a struct of two hashes with different seeds."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))


def look_links(df: DataFrame, id_column: str, column: str, fold_case: bool = False, compatibility: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, members): which spellings look the same, and the rows that have them.

    links: form, raw, raw_b, each pair of different spellings of one form once; members:
    id, form, raw of the rows that have a form of several spellings. Spellings and forms
    are given by their hashes. Null texts match nothing; empty texts are texts. Only ids
    and hashes are shuffled, and each spelling is counted on the map side first, so rows
    that share a spelling, however many, are never compared.
    """
    text = F.col(column)
    odd = F.lit(True) if fold_case or compatibility else has_odd_characters(text)
    thin = df.filter(text.isNotNull()).select(F.col(id_column).alias("id"), _hash(text).alias("raw"), F.when(odd, text).alias("odd"))
    thin = thin.withColumn("form", _forms(fold_case, compatibility)(F.col("odd")))
    thin = materialize(thin.select("id", "raw", F.when(F.col("form").isNotNull(), _hash(F.col("form"))).otherwise(F.col("raw")).alias("form")), "forms")
    spellings = thin.groupBy("form", "raw").agg(F.count("*").alias("n"))
    # a form without odd spellings has one spelling, so few forms are left to meet the rows
    many = materialize(spellings.groupBy("form").agg(F.count("*").alias("spellings")).filter("spellings > 1").select("form"), "spelt-forms")
    members = materialize(thin.join(broadcast_if_small(many), "form", "left_semi"), "spellings")
    kinds = materialize(members.select("form", "raw").distinct(), "kinds")
    links = kinds.alias("x").join(kinds.withColumnRenamed("raw", "raw_b").alias("y"), "form").filter(F.col("raw") < F.col("raw_b")).select("form", "raw", "raw_b")
    return links, members


def same_look(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id_a, id_b: rows, smaller id first, whose texts differ in code points but have one visual form: look_links, each spelling as its rows.

    Rows with equal text are no pair. A spelling of very many rows is spread over several
    tasks, though the pairs themselves are as many as its rows times those of the other
    spelling; who needs no pairs uses look_links.
    """
    links, members = look_links(df, id_column, column)
    key = lambda raw: F.concat(F.hex("form.a"), F.hex("form.b"), F.hex(f"{raw}.a"), F.hex(f"{raw}.b")).alias("key")
    rows = members.select("id", key("raw"))
    pairs = links.select(key("raw"), key("raw_b").alias("key_b"))
    left = salted_join(pairs, rows.withColumnRenamed("id", "id_x"), "key", "id_x", rows_of(members)).select(F.col("key_b").alias("key"), "id_x")
    both = salted_join(left, rows.withColumnRenamed("id", "id_y"), "key", "id_y", rows_of(members))
    return both.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))
