"""Reading comprehension: raw pool, slice, short answers, generation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import context_key, plain_pair_key, qa_key
from quern.functions.mcq import chat, render_reading, render_short
from quern.functions.text import find_from, hash_form, span_matches, strip
from quern.operators.dedup import keep_first_kept
from quern.operators.rules import RuleSet, blank, missing
from quern.operators.stage import Stage
from quern.schema import RAW_METADATA

CONTEXT, QUESTION, ANSWER = (80, 8000), (5, 400), 300
# Answers that say nothing.
GENERIC_ANSWERS = ("Không có thông tin", "Tất cả các đáp án trên", "Cả A và B", "Cả A, B và C")


def length_rules(context: Column, question: Column, answer: Column) -> list[tuple[str, Column]]:
    c, q = F.length(context), F.length(question)
    return [
        ("missing_context", missing(context)),
        ("context_too_short", c < CONTEXT[0]),
        ("context_too_long", c > CONTEXT[1]),
        ("missing_question", missing(question)),
        ("question_too_short", q < QUESTION[0]),
        ("question_too_long", q > QUESTION[1]),
        ("missing_answer", missing(answer)),
        ("answer_too_long", F.length(answer) > ANSWER),
    ]


def valid_variants(context: Column, texts: Column, starts: Column) -> Column:
    """array<struct<text, answer_start>> of the answers that stand where they should."""
    zipped = F.transform(F.arrays_zip(texts.alias("text"), starts.alias("start")), lambda v: F.struct(v["text"].alias("text"), v["start"].cast("int").alias("answer_start")))
    return F.filter(zipped, lambda v: (v["text"] != "") & span_matches(context, v["answer_start"], v["text"]))


def listed_answers(rows: DataFrame, position: str = "_pos") -> Stage:
    """Raw rows with a list of answers: id, title, context, question, is_impossible, answers<text[], answer_start[]>, split.

    The first valid answer that passes the length rules is taken; if none passes, the first
    valid one's reason counts.
    """
    texts, starts = F.col("answers.text"), F.col("answers.answer_start")
    v = rows.withColumn("_v", F.coalesce(valid_variants(F.col("context"), texts, starts), F.array().cast("array<struct<text:string,answer_start:int>>")))
    fits = F.get(F.filter("_v", lambda x: F.length(x["text"]) <= ANSWER), F.lit(0))
    v = v.withColumn("_a", F.coalesce(fits, F.get("_v", F.lit(0))))
    rules = [
        ("schema_error", F.col("context").isNull() | F.col("question").isNull()),
        ("is_impossible", F.col("is_impossible")),
        ("missing_field", F.col("answers").isNull() | texts.isNull() | starts.isNull()),
        *length_rules(F.col("context"), F.col("question"), F.lit("x"))[:6],
        ("no_valid_answer_variant", F.size("_v") == 0),
        *length_rules(F.col("context"), F.col("question"), F.col("_a.text")),
    ]
    out = v.withColumn("reason", RuleSet(rules).first_reason())
    return Stage(out.select(*rows.columns, F.col("_a.text").alias("answer_text"), F.col("_a.answer_start").alias("answer_start"), F.col("_v").alias("answer_variants"), "reason"))


def joined_words(c: Column) -> Column:
    """No-break spaces and underscores as spaces, stripped, not collapsed; null for blank."""
    return F.nullif(strip(F.translate(c, " _", "  ")), F.lit(""))


def single_answer(rows: DataFrame) -> Stage:
    """Raw rows with one answer and its offset: context, question, answer, answer_start, words joined by underscores.

    The offset is checked on the raw texts, and found again, forward from the shifted place,
    in the normalised ones.
    """
    c, q, a, start = F.col("context"), F.col("question"), F.col("answer"), F.col("answer_start")
    v = rows.withColumns({"_c": joined_words(c), "_q": joined_words(q), "_a": joined_words(a)})
    lead = F.length(F.regexp_extract(F.translate(c, " _", "  "), r"(?U)\A(\s*)", 1))
    shifted = start - lead
    at = F.when(span_matches(F.col("_c"), shifted, F.col("_a")), shifted).otherwise(find_from(F.col("_c"), F.col("_a"), shifted))
    v = v.withColumn("_at", at)
    rules = [
        ("schema_error", c.isNull() | q.isNull() | a.isNull()),
        *length_rules(c, q, a),
        ("missing_answer", blank(a)),
        ("invalid_answer_start", start.isNull()),
        ("answer_start_out_of_range", (start < 0) | (start >= F.length(c))),
        ("span_mismatch", ~span_matches(c, start, a)),
        ("schema_error", F.col("_c").isNull() | F.col("_q").isNull() | F.col("_a").isNull()),
        ("answer_not_found_after_normalize", F.col("_at") < 0),
    ]
    out = v.withColumn("reason", RuleSet(rules).first_reason())
    keep = [x for x in rows.columns if x not in ("context", "question", "answer", "answer_start")]
    return Stage(out.select(*keep, F.coalesce("_c", "context").alias("context"), F.coalesce("_q", "question").alias("question"), F.coalesce("_a", "answer").alias("answer_text"), F.col("_at").cast("int").alias("answer_start"), F.array(F.struct(F.col("_a").alias("text"), F.col("_at").cast("int").alias("answer_start"))).alias("answer_variants"), start.alias("original_answer_start"), "reason"))


def source_id(candidates: list[Column], split: Column, position: Column) -> Column:
    """First id that isn't empty, else split and position."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in candidates), F.concat_ws("-", split, position.cast("string")))


def pool(stages: list[tuple[str, Stage]], split: str = "split", position: str = "_pos") -> Stage:
    """All sources in order: rows of earlier sources win over equal rows of later ones."""
    out = None
    for n, (name, s) in enumerate(stages):
        rows = s.rows.withColumn("source_dataset", F.lit(name)).withColumn("_order", F.lit(n))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    keyed = out.withColumn("dedup_hash", F.when(F.col("reason").isNull(), qa_key(F.col("context"), F.col("question"), F.col("answer_text"))))
    placed = keyed.withColumn("_place", F.concat(F.format_string("%03d/", "_order"), F.lpad(F.col(position).cast("string"), 20, "0")))
    return keep_first_kept(Stage(placed), "dedup_hash", "_place")


def raw_records(kept: DataFrame, split: str = "split", mode: str = "strict_exact") -> DataFrame:
    """Chat records of the raw pool."""
    g = lambda name, kind="string": F.col(name) if name in kept.columns else F.lit(None).cast(kind)
    meta = F.struct(F.lit("comprehension_raw").alias("task"), F.lit("public").alias("source"), F.col("source_dataset"), F.col(split).alias("source_split"), g("id").cast("string").alias("source_id"), F.col("answer_start"), F.coalesce(g("original_answer_start", "int"), "answer_start").alias("original_answer_start"), F.col("answer_text"), F.col("answer_variants"), g("title").alias("title"), F.lit("vi").alias("language"), F.lit("medium").alias("difficulty"), F.lit(mode).alias("span_check_mode"), F.col("dedup_hash"), F.lit("comprehension_raw_v1").alias("qc_version"))
    return kept.select("context", "question", "answer_text", chat(render_reading(F.col("context"), F.col("question")), F.col("answer_text")).alias("messages"), meta.alias("metadata"))


def raw_errors() -> RuleSet:
    """All errors of a raw record."""
    m = F.col("metadata")
    user, answer = F.get("messages", F.lit(0)), F.get("messages", F.lit(1))
    text = F.col("answer_text")
    return RuleSet([
        ("messages must have exactly 2 elements", F.coalesce(F.size("messages") != 2, F.lit(True))),
        ("first role is not user", ~user["role"].eqNullSafe(F.lit("user"))),
        ("user content does not match context/question", ~user["content"].eqNullSafe(render_reading(F.col("context"), F.col("question")))),
        ("second role is not assistant", ~answer["role"].eqNullSafe(F.lit("assistant"))),
        ("assistant content does not match answer_text", ~answer["content"].eqNullSafe(text)),
        *((f"missing metadata field: {f}", m.isNull()) for f in RAW_METADATA),
        ("metadata.task is not comprehension_raw", ~m["task"].eqNullSafe(F.lit("comprehension_raw"))),
        ("context is not a non-empty string", blank(F.col("context"))),
        ("question is not a non-empty string", blank(F.col("question"))),
        ("answer_text is not a non-empty string", blank(text)),
        ("answer_text does not appear in context", ~blank(text) & ~blank(F.col("context")) & ~F.contains("context", text)),
        ("metadata.answer_text does not match top-level answer_text", ~m["answer_text"].eqNullSafe(text)),
        ("metadata.dedup_hash is not a non-empty string", blank(m["dedup_hash"])),
        ("strict_exact span does not match context slice", (m["span_check_mode"] == "strict_exact") & ~blank(F.col("context")) & ~blank(text) & m["answer_start"].isNotNull() & ~span_matches(F.col("context"), m["answer_start"], text)),
    ])


def slice_of(raw: DataFrame, source_dataset: str, mode: str = "strict_exact") -> Stage:
    """Rows of one source whose spans were checked."""
    m = F.col("metadata")
    rules = RuleSet([
        ("missing_metadata", m.isNull()),
        ("source_dataset", ~m["source_dataset"].eqNullSafe(F.lit(source_dataset))),
        ("span_check_mode", ~m["span_check_mode"].eqNullSafe(F.lit(mode))),
        ("answer_variants_empty", F.coalesce(F.size(m["answer_variants"]), F.lit(0)) < 1),
    ])
    return Stage(raw.withColumn("reason", rules.first_reason()))


def short_answers(raw: DataFrame, source_dataset: str, position: str) -> Stage:
    """user, assistant and dedup_hash of one source, without repeated prompts and answers."""
    user = render_short(F.col("context"), F.col("question"))
    rules = RuleSet([
        ("other_source", ~F.col("metadata.source_dataset").eqNullSafe(F.lit(source_dataset))),
        ("missing_field", missing(F.col("context")) | missing(F.col("question")) | missing(F.col("answer_text"))),
    ])
    out = raw.withColumn("user", user).withColumn("assistant", F.col("answer_text")).withColumn("reason", rules.first_reason())
    return keep_first_kept(Stage(out.withColumn("dedup_hash", plain_pair_key(user, F.col("answer_text")))), "dedup_hash", position)


def generation_requests(raw: DataFrame) -> Stage:
    """Requests for distractors: request_id, context, question, gold answer and its variants."""
    c, q, a = F.col("context"), F.col("question"), F.col("answer_text")
    n = F.length(strip(a))
    rules = RuleSet([
        ("invalid_raw_record", F.col("metadata").isNull()),
        ("missing_context", blank(c)),
        ("missing_question", blank(q)),
        ("question_too_short", F.length(strip(q)) < 5),
        ("missing_answer", blank(a)),
        ("answer_too_short", n < 2),
        ("answer_too_long", n > 220),
        ("generic_answer_text", hash_form(a).isin(*(g.lower() for g in GENERIC_ANSWERS))),
        ("context_too_long", F.length(strip(c)) > CONTEXT[1]),
    ])
    suffix = F.coalesce(F.nullif(F.col("metadata.source_id"), F.lit("")), F.nullif(F.col("metadata.dedup_hash"), F.lit("")), context_key(c))
    return Stage(raw.withColumn("request_id", F.concat(F.lit("cmcq-gen-"), suffix)).withColumn("gold_variants", F.transform("metadata.answer_variants", lambda v: v["text"])).withColumn("reason", rules.first_reason()))
