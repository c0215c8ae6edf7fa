"""Parsing and scoring of model predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.pyudf import nfc, nfc_casefold
from quern.functions.text import collapse, lines, strip

# How a line names a label.
STRICT = r"(?iuU)\A\s*Đáp án\s*:\s*([A-Za-z])\s*[.)]?\s*\z"
SINGLE = r"(?iuU)\A\s*([A-Za-z])\s*[.)]?\s*\z"
PREFIX = r"(?iuU)\A\s*(?:Phương án|Phuong an|Chọn|Chon)\s*([A-Za-z])\s*\z"
INLINE = r"(?iuU)\b(?:chọn|chon)\s*([A-Za-z])\b"


def parsed(prediction: Column) -> Column:
    """struct(label, status) of the first three lines that aren't empty.

    Status: ok_strict, ok_fallback, invalid_empty, invalid_no_label, invalid_multi_label,
    invalid_out_of_set. Null counts as empty.
    """
    top = F.slice(lines(nfc(F.coalesce(prediction, F.lit("")))), 1, 3)
    get = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    named = F.transform(top, lambda x: F.struct(F.upper(F.coalesce(get(x, STRICT), get(x, SINGLE), get(x, PREFIX), get(x, INLINE))).alias("label"), get(x, STRICT).isNotNull().alias("strict")))
    found = F.filter(named, lambda n: n["label"].isNotNull())
    valid = F.filter(found, lambda n: n["label"].isin("A", "B", "C", "D"))
    other = F.size(found) - F.size(valid)
    label = F.get(valid, F.lit(0))["label"]
    several = F.size(F.array_distinct(F.transform(valid, lambda n: n["label"]))) > 1
    status = (
        F.when(F.size(top) == 0, "invalid_empty")
        .when(((F.size(valid) > 0) & (other > 0)) | several, "invalid_multi_label")
        .when(F.size(valid) > 0, F.when(F.forall(valid, lambda n: n["strict"]), "ok_strict").otherwise("ok_fallback"))
        .when(other > 0, "invalid_out_of_set")
        .otherwise("invalid_no_label")
    )
    return F.struct(F.when(status.startswith("ok"), label).alias("label"), status.alias("status"))


def answer_key(key: Column) -> Column:
    """A to D out of an answer key: a whole-text form, else its first Latin letter; null for anything else."""
    t = strip(nfc(key))
    get = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    label = F.upper(F.coalesce(get(STRICT), get(SINGLE), get(PREFIX), get("([A-Za-z])")))
    return F.when(label.isin("A", "B", "C", "D"), label)


def is_correct(prediction: Column, key: Column) -> Column:
    """Whether the parsed label is the key's; false if either is missing."""
    return F.coalesce(parsed(prediction)["label"] == answer_key(key), F.lit(False))


def word_form(c: Column) -> Column:
    """A predicted word: composed, case-folded, collapsed, without final punctuation."""
    return nfc_casefold(strip(F.regexp_replace(collapse(strip(nfc(c))), r"[.,;:!?]+\z", "")))


def is_same_word(prediction: Column, target: Column) -> Column:
    return F.coalesce(word_form(prediction) == word_form(target), F.lit(False))
