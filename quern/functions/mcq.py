"""Multiple-choice prompts: rendering and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import clean_text, strip

# The wording of the prompts.
QUESTION = "Câu hỏi: "
PASSAGE = "Đoạn văn: "
READ_AND_CHOOSE = "Đọc đoạn văn sau và chọn đáp án đúng."
ANSWER_SHORTLY = "Dựa vào đoạn văn sau đây, hãy trả lời câu hỏi ngắn gọn:"
NEXT_WORD = "Điền từ tiếp theo vào chỗ trống:"
ANSWER = "Đáp án: "


def render(question: Column, choices: list[Column]) -> Column:
    """Question and choices A to D, one per line."""
    return F.concat_ws("\n", F.concat(F.lit(QUESTION), question), *(F.concat(F.lit(f"{x}. "), c) for x, c in zip("ABCD", choices)))


def render_reading(context: Column, question: Column) -> Column:
    return F.concat(F.lit(PASSAGE), context, F.lit("\n\n" + QUESTION), question)


def render_short(context: Column, question: Column) -> Column:
    return F.concat(F.lit(ANSWER_SHORTLY + "\n\n"), render_reading(context, question))


def render_reading_mcq(context: Column, question: Column, choices: list[Column]) -> Column:
    return F.concat(F.lit(READ_AND_CHOOSE + "\n\n" + PASSAGE), context, F.lit("\n\n"), render(question, choices))


def parse_reading_mcq(content: Column) -> Column:
    """struct(context, question, A, B, C, D): the inverse of render_reading_mcq; null where the form is broken."""
    pattern = (
        r"\A" + READ_AND_CHOOSE.replace(".", r"\.") + r"\n\nĐoạn văn: ((?s:.*?))\n+Câu hỏi: ((?s:.*?))\n+A\. (.*)\nB\. (.*)\nC\. (.*)\nD\. (.*)\n?\z"
    )
    get = lambda n: F.regexp_extract(content, pattern, n)
    return F.when(content.rlike(pattern), F.struct(*(get(n).alias(x) for n, x in enumerate(("context", "question", "A", "B", "C", "D"), 1))))


def labelled_lines(content: Column) -> Column:
    """map of label to text of the lines that start with 'A.' to 'D.'; the last of a repeated label counts."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^[^\S\n]*([ABCD])\.[^\S\n]*([^\n]*)$"), F.lit(0))
    entries = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "([ABCD])", 1).alias("k"), clean_text(F.regexp_replace(x, r"\A\s*[ABCD]\.", "")).alias("v")))
    last = lambda k: F.try_element_at(F.transform(F.filter(entries, lambda e: e["k"] == k), lambda e: e["v"]), F.lit(-1))
    return F.struct(*(last(k).alias(k) for k in "ABCD"))


def parse_wrapped(content: Column) -> Column:
    """struct(question, A, B, C, D) of a prompt whose question and choices may span lines; null unless all four labels occur.

    A repeated label starts its choice again.
    """
    t = F.regexp_replace(content, r"\R", "\n")
    head = F.regexp_extract(t, r"(?s)\A(.*?)(?:^|\n)\s*[ABCD]\.", 1)
    pick = lambda k: F.try_element_at(F.regexp_extract_all(t, F.lit(rf"(?ms)^\s*{k}\.(.*?)(?=^\s*[ABCD]\.|\z)"), F.lit(1)), F.lit(-1))
    parts = {k: clean_text(pick(k)) for k in "ABCD"}
    whole = F.lit(True)
    for k in "ABCD":
        whole = whole & pick(k).isNotNull()
    question = clean_text(F.regexp_replace(strip(head), r"(?U)\ACâu hỏi:\s*", ""))
    return F.when(whole, F.struct(question.alias("question"), *(v.alias(k) for k, v in parts.items())))


def answer_label(content: Column) -> Column:
    """Label of an assistant text 'Đáp án: X'; null for any other."""
    return F.nullif(F.regexp_extract(strip(content), r"(?U)\AĐáp án:\s*([ABCD])\z", 1), F.lit(""))


def message(messages: Column, role: str) -> Column:
    """Content of the first message of a role; null if there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def chat(user: Column, assistant: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))


def first_exchange(messages: Column) -> Column:
    """struct(user, assistant): the first user message directly followed by an assistant's; null if there is none."""
    at = F.when(F.size(messages) >= 2, F.transform(F.sequence(F.lit(0), F.size(messages) - 2), lambda i: F.struct(F.get(messages, i).alias("u"), F.get(messages, i + 1).alias("a"))))
    pair = F.get(F.filter(at, lambda p: (p["u"]["role"] == "user") & (p["a"]["role"] == "assistant")), F.lit(0))
    return F.when(pair.isNotNull(), F.struct(pair["u"]["content"].alias("user"), pair["a"]["content"].alias("assistant")))


def is_mcq_like(user: Column, assistant: Column) -> Column:
    """Whether an exchange is a multiple-choice question answered by its letter; false for nulls."""
    letter = assistant.rlike(r"(?iuU)\A\s*(Đáp án|Answer|Kết quả)\s*:?\s*[A-D]\s*\z")
    listed = user.rlike(r"(?U)[A-D]\.\s+.*?\n[A-D]\.\s+.*?\n[A-D]\.\s+.*?\n[A-D]\.\s+")
    bare = (F.length(assistant) < 20) & assistant.rlike(r"(?iuU)\A\s*[A-D]\.?\s*\z")
    return F.coalesce(letter | (listed & bare), F.lit(False))


def looks_like_mcq(user: Column, assistant: Column) -> Column:
    """The broader test for contaminated records: listed choices or a letter as answer."""
    letter = assistant.rlike(r"(?iuU)\A\s*(Đáp án|Answer|Kết quả)\s*:?\s*[A-D]\s*\z")
    listed = user.rlike(r"(?U)[A-D]\.\s+.*?\n[A-D]\.\s+.*?\n[A-D]\.\s+.*?\n[A-D]\.\s+")
    return F.coalesce(letter, F.lit(False)) | F.coalesce(listed, F.lit(False))
