"""Content keys, byte for byte those of the usual hash libraries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import choice_form, hash_form


def record_key(messages: Column) -> Column:
    """SHA-256 over role and content of all messages; null contents count as empty."""
    one = lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("")), F.lit("]:"), F.coalesce(m["content"], F.lit("")), F.lit("|"))
    return F.sha2(F.array_join(F.transform(messages, one), ""), 256)


def qa_key(context: Column, question: Column, answer: Column) -> Column:
    """SHA-1 of the hash forms, one per line."""
    return F.sha1(F.concat_ws("\n", hash_form(context), hash_form(question), hash_form(answer)))


def mcq_key(context: Column, question: Column, choices: list[Column]) -> Column:
    """SHA-1 of context, question and the four choice forms."""
    return F.sha1(F.concat_ws("\n", hash_form(context), hash_form(question), *(choice_form(c) for c in choices)))


def context_key(context: Column) -> Column:
    return F.sha1(hash_form(context))


def pair_key(user: Column, assistant: Column) -> Column:
    """SHA-1 of the hash forms of a user and an assistant text."""
    return F.sha1(F.concat_ws("|", hash_form(user), hash_form(assistant)))


def plain_pair_key(user: Column, assistant: Column) -> Column:
    """SHA-1 of the texts as they are."""
    return F.sha1(F.concat_ws("|", user, assistant))


def json_string(c: Column) -> Column:
    """A text as a JSON string, other than ASCII kept."""
    t = F.regexp_replace(c, r'(["\\])', r"\\$1")
    for a, b in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\b", r"\\b"), ("\f", r"\\f")):
        t = F.regexp_replace(t, a, b) if a != "\b" else F.regexp_replace(t, "\u0008", b)
    return F.concat(F.lit('"'), t, F.lit('"'))


def choices_key(question: Column, choices: list[Column]) -> Column:
    """MD5 of question and choices as a JSON object with sorted keys."""
    inner = F.concat_ws(", ", *(json_string(c) for c in choices))
    return F.md5(F.concat(F.lit('{"choices": ['), inner, F.lit('], "question": '), json_string(question), F.lit("}")))
