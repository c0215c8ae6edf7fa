"""The few functions that no built-in expresses, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import ast
import hashlib
import json
import random
import re
import unicodedata
from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(kind: str, f):
    """A pandas UDF that applies f to distinct values; None gives None."""

    @F.pandas_udf(kind)
    def udf(x: pd.Series) -> pd.Series:
        known = {v: f(v) for v in x.unique() if v is not None}
        return x.map(known.get)

    return udf


def nfc(c: Column) -> Column:
    """Composed Unicode form. Texts of plain ASCII skip Python."""
    odd = F.when(c.rlike(r"[^\x00-\x7f]"), c)
    return F.coalesce(_each("string", lambda t: unicodedata.normalize("NFC", t))(odd), c)


def nfc_casefold(c: Column) -> Column:
    return _each("string", lambda t: unicodedata.normalize("NFC", t).casefold())(c)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, in this order of arguments; 0 if either is null or empty."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y)])

    return ratio(a, b)


def shuffled_labels(seed: str) -> list[str]:
    """A to D in an order fixed by the SHA-1 of the seed's hash form."""
    form = re.sub(r"\s+", " ", seed.replace("\u00a0", " ").lower().strip())
    digest, order = hashlib.sha1(form.encode()).digest(), list("ABCD")
    for last in (3, 2, 1):
        other = digest[last] % (last + 1)
        order[last], order[other] = order[other], order[last]
    return order


def place_choices(seed: str, gold: str, others: list[str]) -> tuple[dict[str, str], str]:
    """Choices by label and the label of the gold answer, fixed by the seed."""
    texts = [gold, *others]
    random.Random(seed).shuffle(texts)
    labels = shuffled_labels(seed)
    return dict(zip(labels, texts)), labels[texts.index(gold)]


def placed(seed: Column, gold: Column, others: Column) -> Column:
    """place_choices per row as a struct; all null where seed, gold or the three others are missing."""

    @F.pandas_udf("struct<A:string,B:string,C:string,D:string,answer:string>")
    def place(seeds: pd.Series, golds: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for s, g, o in zip(seeds, golds, lists):
            if s is None or g is None or o is None or len(o) != 3:
                rows.append((None,) * 5)
                continue
            by, answer = place_choices(s, g, list(o))
            rows.append((by["A"], by["B"], by["C"], by["D"], answer))
        return pd.DataFrame(rows, columns=["A", "B", "C", "D", "answer"])

    return place(seed, gold, others)


def _literal(text: str) -> list[str] | None:
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return [None if x is None else str(x) for x in value] if isinstance(value, list) else None


def literal_list(c: Column) -> Column:
    """Array out of a Python list literal; null if it is none."""

    @F.pandas_udf("array<string>")
    def parse(x: pd.Series) -> pd.Series:
        return pd.Series([_literal(t) if t is not None else None for t in x])

    return parse(c)


def is_json(c: Column) -> Column:
    """Whether the text is JSON in the sense of a strict parser; false for null."""

    def ok(t: str) -> bool:
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    return F.coalesce(_each("boolean", ok)(c), F.lit(False))


# Formulas in texts

# Amounts of money, and what belongs between dollar signs.
MONEY = re.compile(r"\$\s?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$\s?\d+\.\d{2}")
FRACTION = re.compile(r"\\frac\{[^{}\n]+\}\{[^{}\n]+\}")
ROOT = re.compile(r"\\sqrt\{[^{}\n]+\}")
POWER = re.compile(r"(?<![\w$])(?:\d+|[a-zA-Z])\^\{[^{}\n]+\}(?![\w$])|(?<![\w$])(?:\d+|[a-zA-Z])\^\d+(?![\w$])")
#: flag to pattern of what must stand between dollar signs
BARE = {"raw_latex_frac": FRACTION, "raw_latex_sqrt": ROOT, "raw_caret_power": POWER}
#: flag to pattern of what must not occur at all
PLAIN = {"literal_backslash_n": r"\\n", "html_entity": r"&[a-zA-Z]+;"}
STRICT = {"broken_placeholder": r"\{\s*\}|\[\s*\]", "raw_latex_begin": r"\\begin", "raw_latex_end": r"\\end"}


#: a sign of money, or one that opens or closes a formula; amounts are tried first
_SIGN = re.compile(rf"(?P<money>{MONEY.pattern})|\$")


def formulas(text: str) -> tuple[list[tuple[int, int]], bool]:
    """Stretches between dollar signs that aren't money, in order, and whether the last of them is left open (to the end)."""
    found, opened = [], None
    at = 0
    while (m := _SIGN.search(text, at)) is not None:
        # only the sign is passed over: an amount may hold no other
        at = m.start() + 1
        if m["money"]:
            continue
        if opened is None:
            opened = m.start()
        else:
            found.append((opened, m.start()))
            opened = None
    if opened is not None:
        found.append((opened, len(text)))
    return found, opened is not None


def _bare(text: str, pattern: re.Pattern) -> list[re.Match]:
    """Matches of a pattern that don't begin within a formula."""
    found = list(pattern.finditer(text))
    if not found or "$" not in text:
        return found
    within, _ = formulas(text)
    starts = [a for a, _ in within]
    out = []
    for m in found:
        k = bisect_left(starts, m.start()) - 1
        if k < 0 or m.start() > within[k][1]:
            out.append(m)
    return out


def formula_flags(text: str, strict: bool = False) -> list[str]:
    """Sorted flags of what is wrong with the formulas of a text; strict adds three checks."""
    out = {"unbalanced_math_dollar"} if "$" in text and formulas(text)[1] else set()
    out |= {flag for flag, p in BARE.items() if _bare(text, p)}
    out |= {flag for flag, p in (PLAIN | (STRICT if strict else {})).items() if re.search(p, text)}
    return sorted(out)


def wrap_formulas(text: str) -> str:
    """Fractions, roots and powers outside formulas put between dollar signs, one kind after the other."""
    for pattern in BARE.values():
        done, out = 0, []
        for m in _bare(text, pattern):
            out += [text[done : m.start()], "$", m[0], "$"]
            done = m.end()
        text = "".join([*out, text[done:]]) if out else text
    return text


def math_flags(c: Column, strict: bool = False) -> Column:
    """formula_flags; empty for null. Texts without $, backslash, ^, &, { and [ skip the scan."""

    @F.pandas_udf("array<string>")
    def flags(x: pd.Series) -> pd.Series:
        return pd.Series([formula_flags(t, strict) if t else [] for t in x])

    return flags(F.when(c.rlike(r"[$\\^&{\[]"), c))


def math_fixed(c: Column) -> Column:
    odd = F.when(c.rlike(r"[\\^]"), c)
    return F.coalesce(_each("string", wrap_formulas)(odd), c)
