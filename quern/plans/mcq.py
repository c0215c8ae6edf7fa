"""Multiple-choice records: exam and encyclopedia sources, construction from generated distractors, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import choices_key, context_key, mcq_key
from quern.functions.mcq import ANSWER, answer_label, chat, labelled_lines, message, parse_reading_mcq, parse_wrapped, render, render_reading_mcq
from quern.functions.pyudf import literal_list, math_fixed, math_flags, placed, sequence_ratio
from quern.functions.text import ENGLISH_LEFT, answer_letter, choice_form, clean_choice, clean_question, clean_text, explained_answer, grade_difficulty, has_label, hash_form, jaccard, let, ordinal_letter, strip, words
from quern.operators.dedup import keep_first_kept
from quern.operators.lookup import fallback_join, first_by_key
from quern.operators.materialize import materialize
from quern.operators.rules import RuleSet, blank, missing
from quern.operators.stage import Stage, expect
from quern.schema import LABELS, MCQ_METADATA

CHOICE_MAX, RATIO_MAX, IMBALANCE_FROM, NEAR_DUPLICATE = 300, 4, 50, 0.92
# Choices that are no answers of their own.
BANNED_CHOICES = ("không có thông tin", "tất cả các đáp án trên", "cả a và b")


# Exams


def exam_rows(rows: DataFrame, prefix: str, position: str = "_pos") -> DataFrame:
    """question, choice_a..d, answer_letter, subject, grade, sample_id out of question, options (array or list literal), answer 1 to 4, level, category columns."""
    options = F.col("options") if dict(rows.dtypes)["options"].startswith("array") else literal_list(F.col("options"))
    four = rows.withColumn("_o", options).filter(F.coalesce(F.size("_o") == 4, F.lit(False)))
    return four.select("question", *(F.get("_o", F.lit(n)).alias(f"choice_{x}") for n, x in enumerate("abcd")), ordinal_letter(F.col("answer")).alias("answer_letter"), F.coalesce("category_original_lang", "category_en").alias("subject"), F.col("level").cast("string").alias("grade"), F.concat(F.lit(prefix + "_"), F.col(position).cast("string")).alias("sample_id"))


def nested_exam_rows(rows: DataFrame) -> DataFrame:
    """The same out of id, grade, problems<question, choices[], explanation>: one row per problem, labels in choices removed."""
    one = rows.select("id", "grade", F.posexplode_outer("problems").alias("n", "p"))
    four = F.when(F.size("p.choices") == 4, F.transform("p.choices", clean_choice))
    return one.select(F.col("p.question").alias("question"), *(F.get(four, F.lit(n)).alias(f"choice_{x}") for n, x in enumerate("abcd")), explained_answer(F.col("p.explanation")).alias("answer_letter"), F.lit("Toán").alias("subject"), F.col("grade").cast("string").alias("grade"), F.concat_ws("_", F.col("id").cast("string"), F.col("n").cast("string")).alias("sample_id"))


_CHOICES = [f"choice_{x}" for x in "abcd"]


def exam_rules() -> RuleSet:
    return RuleSet([
        ("question", blank(F.col("question"))),
        *((c, blank(F.col(c))) for c in _CHOICES),
        ("answer_letter", ~F.coalesce(F.col("answer_letter").isin(*LABELS), F.lit(False))),
    ])


def exams(rows: DataFrame, position: str) -> Stage:
    """Cleaned rows that are whole, the first of equal ones; reason names the first field that fails."""
    clean = rows.withColumn("question", clean_question("question")).withColumns({c: clean_choice(c) for c in _CHOICES})
    keyed = clean.withColumn("_key", F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c), F.lit("\u0002")) for c in ("question", *_CHOICES, "answer_letter"))), 256))
    checked = Stage(keyed.withColumn("reason", exam_rules().first_reason()))
    out = keep_first_kept(checked, "_key", position)
    return Stage(out.rows.drop("_key"))


def without_labels(kept: DataFrame) -> DataFrame:
    """kept; using it fails if a label is left in a choice."""
    return expect(kept, ~F.exists(F.array(*_CHOICES), has_label), "a choice still has a label")


def exam_records(kept: DataFrame) -> DataFrame:
    user = render(strip("question"), [strip(c) for c in _CHOICES])
    return kept.select(chat(user, F.concat(F.lit(ANSWER), "answer_letter")).alias("messages"), grade_difficulty(F.col("grade")).alias("difficulty"), *(c for c in ("row_id", "sample_id", "subject", "grade") if c in kept.columns))


# Encyclopedia


def wiki(rows: DataFrame, position: str) -> Stage:
    """question, choices (array), answer: cleaned, with all reasons of a bad row joined by +, the first of equal ones kept."""
    c = F.transform("choices", clean_text)
    four = F.when((F.size("choices") == 4) & ~F.exists(c, lambda x: x == ""), c)
    clean = rows.withColumns({"question": clean_text("question"), "choices": four, "answer": answer_letter(F.col("answer"))})
    bad = RuleSet([("missing_question", F.col("question") == ""), ("invalid_choices", F.col("choices").isNull()), ("invalid_answer", F.col("answer").isNull())]).all_flags()
    keyed = clean.withColumn("reason", F.nullif(F.array_join(bad, "+"), F.lit("")))
    return keep_first_kept(Stage(keyed.withColumn("dedup_hash", choices_key(F.col("question"), [F.get("choices", F.lit(n)) for n in range(4)]))), "dedup_hash", position)


def choice_set(content: Column) -> Column:
    """Distinct choices of a prompt in lower case; null unless all four labels occur."""
    c = labelled_lines(content)
    return F.when(c["A"].isNotNull() & c["B"].isNotNull() & c["C"].isNotNull() & c["D"].isNotNull(), F.array_distinct(F.array(*(F.lower(c[x]) for x in LABELS))))


def cleanup_flags(content: Column, assistant: Column, subject: Column, whitelist: list[str]) -> Column:
    """All flags of the cleanup policy; an empty array means keep."""
    english = F.lit(False)
    for p in ENGLISH_LEFT:
        english = english | content.rlike("(?iuU)" + p)
    return RuleSet([
        ("subject_not_in_wiki_mcq_whitelist", ~F.coalesce(subject.isin(whitelist), F.lit(False))),
        ("duplicate_choices_or_invalid_choice_format", F.coalesce(F.size(choice_set(content)), F.lit(0)) < 4),
        ("invalid_assistant_answer_format", answer_label(assistant).isNull()),
        ("hard_english_artifact", english),
    ]).all_flags()


def cleanup(rows: DataFrame, whitelist: list[str]) -> Stage:
    """Chat records with qc_flags and qc_action; reason is the flags of dropped rows joined by ' + '."""
    flags = cleanup_flags(message(F.col("messages"), "user"), message(F.col("messages"), "assistant"), F.col("metadata.subject"), whitelist)
    out = rows.withColumn("qc_flags", flags).withColumn("qc_action", F.when(F.size("qc_flags") == 0, "keep").otherwise("drop"))
    return Stage(out.withColumn("reason", F.nullif(F.array_join(F.array_sort("qc_flags"), " + "), F.lit(""))))


# Formulas


def math_triage(rows: DataFrame, issues: DataFrame, key: str, text: str) -> DataFrame:
    """rows with before_flags, after_flags, fixed and action for those in the worklist (key); others are kept as they are."""
    marked = rows.join(issues.select(F.col(key).alias("_issue")).distinct(), F.col(key) == F.col("_issue"), "left")
    listed = F.when(F.col("_issue").isNotNull(), F.col(text))
    out = marked.withColumn("before_flags", strict_flags(listed))
    out = out.withColumn("_new", F.when(F.size("before_flags") > 0, math_fixed(listed))).withColumn("after_flags", strict_flags(F.col("_new")))
    action = F.when(F.col("_issue").isNull(), "keep").when(F.size("before_flags") == 0, "keep_false_positive").when((F.size("after_flags") == 0) & valid_prompt(F.col("_new")), "fixed_by_rule").otherwise("drop_unresolved_math_format_issue")
    return out.withColumn("action", action).withColumn("fixed", F.when(F.col("action") == "fixed_by_rule", F.col("_new")).otherwise(F.col(text))).drop("_new", "_issue")


def valid_prompt(content: Column) -> Column:
    """Whether a prompt has its question and all labels."""
    ok = content.rlike(r"(?U)\A\s*Câu hỏi:")
    for x in LABELS:
        ok = ok & content.rlike(rf"(?s)\n{x}\.\s*\S")
    return F.coalesce(ok, F.lit(False))


def strict_flags(content: Column) -> Column:
    """All flags of a prompt's formulas and form, sorted; empty for null."""
    form = F.when(content.isNotNull() & ~valid_prompt(content), F.array(F.lit("invalid_user_content_format"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.concat(math_flags(content, strict=True), form))


# Subjects whose records are checked, and what looks suspicious in them.
MATH_SUBJECTS = (
    "abstract_algebra",
    "elementary_mathematics",
    "high_school_mathematics",
    "high_school_statistics",
    "conceptual_physics",
    "high_school_physics",
    "high_school_chemistry",
    "astronomy",
)
SUSPICIOUS = {
    "raw_latex_frac": r"\\frac",
    "raw_latex_sqrt": r"\\sqrt",
    "raw_latex_begin": r"\\begin",
    "raw_latex_end": r"\\end",
    "raw_newline_escape": r"\\n",
    "unbalanced_dollar": r"\$",
    "double_backslash": r"\\\\",
    "html_entity": r"&[a-zA-Z]+;",
    "markdown_table_pipe": r"\|",
    "multiple_underscores": r"__+",
    "caret_power": r"\^",
    "subscript_underscore": r"_[A-Za-z0-9]",
    "broken_placeholder": r"\{\s*\}|\[\s*\]",
}


def format_flags(content: Column) -> Column:
    """Names of the suspicious patterns of a prompt's question and choices; unbalanced_dollar only if their number is odd.

    Null unless the prompt can be parsed.
    """
    p = parse_wrapped(content)
    text = F.concat_ws("\n", *(p[x] for x in ("question", *LABELS)))
    return F.when(p.isNotNull(), let(text, lambda t: RuleSet([(k, t.rlike(v) if k != "unbalanced_dollar" else odd_count(t, "$")) for k, v in SUSPICIOUS.items()]).all_flags()))


def odd_count(text: Column, sign: str) -> Column:
    """Whether a sign occurs an odd number of times."""
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) % 2 == 1


def format_issues(rows: DataFrame, content: Column, subject: Column, subjects: tuple[str, ...] = MATH_SUBJECTS) -> DataFrame:
    """rows of the subjects with flags, those without any left out; null and other subjects have none."""
    return rows.filter(subject.isin(*subjects)).withColumn("flags", format_flags(content)).filter(F.size("flags") > 0)


def fix_reason(original: Column, fixed: Column) -> Column:
    """Why a repaired prompt can't replace the original; null if it can."""
    a, b = parse_wrapped(original), parse_wrapped(fixed)
    return RuleSet([("empty_fixed_text", blank(fixed)), ("invalid_user_content_format", ~valid_prompt(fixed)), ("choice_labels_changed", a.isNotNull() & b.isNull())]).first_reason()


# What a repair can come to, by rule first and by a model's answer then.
BY_RULE = ("missing_source_id_in_jsonl", "invalid_original_user_content", "rule_fix_rejected", "fixed_by_rule", "false_positive_or_no_change_needed", "needs_gemini")
BY_MODEL = ("gemini_fix_rejected", "fixed_by_gemini", "gemini_batch_failed")


def repair_log(rows: DataFrame, issues: DataFrame, answers: DataFrame, key: str = "source_id", text: str = "text") -> DataFrame:
    """key, status, reason, before_flags, after_flags, fixed: a row per issue and, where a rule didn't do, per answer of the model.

    rows: key (of repeated keys the row with the last text counts), text. issues: key; each
    is logged, repeated ones as often. answers: key, fixed, failed (the batch had an
    error); an issue that needs the model and has no answer keeps its one row. fixed is
    what replaces the text, null where nothing does.
    """
    texts = rows.groupBy(F.col(key).alias("_k")).agg(F.max(text).alias("_t"), F.lit(True).alias("_there"))
    t = issues.select(key).join(texts, F.col(key) == F.col("_k"), "left").withColumn("_new", math_fixed(F.col("_t")))
    t = t.withColumn("before_flags", math_flags(F.col("_t"))).withColumn("after_flags", math_flags(F.col("_new"))).withColumn("reason", fix_reason(F.col("_t"), F.col("_new")))
    status = (
        F.when(F.col("_there").isNull(), BY_RULE[0]).when(~valid_prompt(F.col("_t")), BY_RULE[1]).when(F.col("reason").isNotNull(), BY_RULE[2])
        .when((F.size("after_flags") == 0) & (F.col("_new") != F.col("_t")), BY_RULE[3]).when(F.size("after_flags") == 0, BY_RULE[4]).otherwise(BY_RULE[5])
    )
    t = materialize(t.withColumn("status", status), "repairs")
    first = t.select(key, "status", F.when(F.col("status") == BY_RULE[2], F.col("reason")).alias("reason"), "before_flags", "after_flags", F.when(F.col("status") == BY_RULE[3], F.col("_new")).alias("fixed"))
    asked = t.filter(F.col("status") == BY_RULE[5]).select(key, "_t").join(answers.select(F.col(key).alias("_a"), F.col("fixed").alias("_f"), F.coalesce("failed", F.lit(False)).alias("_failed")), F.col(key) == F.col("_a"))
    asked = asked.withColumn("_why", F.when(~F.col("_failed"), fix_reason(F.col("_t"), F.col("_f")))).withColumn("_flags", math_flags(F.col("_f")))
    outcome = F.when(F.col("_failed"), BY_MODEL[2]).when(F.col("_why").isNotNull(), BY_MODEL[0]).otherwise(BY_MODEL[1])
    second = asked.select(key, outcome.alias("status"), F.col("_why").alias("reason"), F.lit(None).cast("array<string>").alias("before_flags"), F.when(~F.col("_failed"), F.col("_flags")).alias("after_flags"), F.when(outcome == BY_MODEL[1], F.col("_f")).alias("fixed"))
    return first.unionByName(second)


# Generated distractors


def response_text(raw: Column, parsed: Column) -> Column:
    """The response as text, or the parsed one as JSON."""
    return F.coalesce(F.when(~blank(raw), raw), F.to_json(parsed, {"ignoreNullFields": "false"}))


def json_object(text: Column) -> Column:
    """The part from the first { to the last }; null if there is none."""
    bare = F.regexp_replace(strip(text), r"(?iU)\A```(?:json)?\s*|\s*```\z", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def near_duplicate(gold: Column, other: Column) -> Column:
    """Equal forms, one within the other, or words shared by 0.8, at least 2 of them."""
    tg, to = (F.array_distinct(words(F.regexp_replace(x, r"(?U)[^\w\s]", " "))) for x in (gold, other))
    return (gold == other) | F.contains(gold, other) | F.contains(other, gold) | ((F.size(F.array_intersect(tg, to)) >= 2) & (jaccard(tg, to) >= 0.8))


def candidates(raw: DataFrame, generated: DataFrame, position: Column, ratio: bool = True) -> Stage:
    """raw records with their distractors: joined by source_id, then by request id; placed under labels if they are sound.

    generated: source_id, request_id, raw_response, parsed_response. Of several responses
    the first by position counts.
    """
    index = first_by_key(generated, [F.col("source_id"), F.col("request_id")], position)
    joined = fallback_join(raw, index, [F.col("metadata.source_id"), F.concat(F.lit("cmcq-gen-"), F.col("metadata.source_id"))])
    obj = json_object(response_text(F.col("match.raw_response"), F.col("match.parsed_response")))
    v = joined.withColumn("_obj", obj).withColumn("_v", F.try_parse_json("_obj"))
    v = v.withColumn("_d", F.try_variant_get("_v", "$.distractors", "array<string>"))
    forms = F.transform("_d", choice_form)
    gold = choice_form(F.col("answer_text"))
    v = v.withColumn("_f", forms).withColumn("_g", gold)
    if ratio:
        v = v.withColumns({f"_r{n}": sequence_ratio(F.col("_g"), F.get("_f", F.lit(n))) for n in range(3)})
        similar = F.greatest(*(F.coalesce(f"_r{n}", F.lit(0.0)) for n in range(3))) >= NEAR_DUPLICATE
    else:
        similar = F.lit(False)
    rules = RuleSet([
        ("missing_generation_output", F.col("match").isNull()),
        ("wrong_distractor_count", F.col("_obj").isNull()),
        ("malformed_generation_json", F.col("_v").isNull()),
        ("wrong_distractor_count", F.coalesce(F.size("_d") != 3, F.lit(True))),
        ("invalid_distractors", F.exists("_d", lambda x: x.isNull())),
        ("empty_distractor", F.exists("_f", lambda x: x == "")),
        ("duplicate_distractors", F.size(F.array_distinct("_f")) != 3),
        ("distractor_matches_gold", F.exists("_f", lambda x: x == F.col("_g"))),
        ("distractor_contains_gold", F.exists("_f", lambda x: F.contains(x, F.col("_g")) | F.contains(F.col("_g"), x))),
        ("distractor_near_duplicate", similar),
    ])
    out = v.withColumn("reason", rules.first_reason())
    seed = F.when(F.col("reason").isNull(), F.coalesce(F.col("metadata.dedup_hash"), F.sha1(hash_form("context"))))
    out = out.withColumn("placed", placed(seed, F.col("answer_text"), F.col("_d")))
    return Stage(out.drop("_obj", "_v", "_f", "_g", *(f"_r{n}" for n in range(3))).withColumnRenamed("_d", "distractors"))


def candidate_records(kept: DataFrame) -> DataFrame:
    """Chat records of sound candidates."""
    p = F.col("placed")
    four = [p[x] for x in LABELS]
    m = F.col("metadata")
    meta = F.struct(F.lit("comprehension_mcq").alias("task"), F.lit("synthetic").alias("source"), m["source_dataset"].alias("source_dataset"), m["source_split"].alias("source_split"), m["source_id"].alias("source_id"), context_key(F.col("context")).alias("context_hash"), m["dedup_hash"].alias("raw_dedup_hash"), mcq_key(F.col("context"), F.col("question"), four).alias("mcq_dedup_hash"), F.col("answer_text").alias("gold_answer_text"), p["answer"].alias("answer"), F.create_map(*(x for k, c in zip(LABELS, four) for x in (F.lit(k), c))).alias("choices"))
    return kept.select(*(c for c in ("row_id",) if c in kept.columns), chat(render_reading_mcq(F.col("context"), F.col("question"), four), F.concat(F.lit(ANSWER), p["answer"])).alias("messages"), meta.alias("metadata"))


def _choices(m: Column) -> Column:
    """Choices A to D as an array; null unless the keys are exactly these."""
    keys = F.array_sort(F.map_keys(m["choices"]))
    return F.when(keys == F.array(*(F.lit(x) for x in LABELS)), F.array(*(F.try_element_at(m["choices"], F.lit(x)) for x in LABELS)))


def rule_check(records: DataFrame, position: str, source_dataset: Column | None = None) -> Stage:
    """Rule checks of candidates: the first reason in the order of the checks, then repeated keys among those that pass."""
    m = F.col("metadata")
    r = records.withColumn("_c", _choices(m)).withColumn("_f", F.transform("_c", choice_form)).withColumn("_g", choice_form(m["gold_answer_text"])).withColumn("_p", parse_reading_mcq(message(F.col("messages"), "user")))
    label = answer_label(message(F.col("messages"), "assistant"))
    long, short = F.array_max(F.transform("_c", F.length)), F.array_min(F.transform("_c", F.length))
    # of the distractors in their order, the first that fails decides
    right = F.array_position(F.array(*(F.lit(x) for x in LABELS)), m["answer"]).cast("int") - 1
    against = F.get("_f", right)
    told = F.transform("_f", lambda x, k: F.when(k == right, None).when((F.col("_g") != "") & F.contains(x, F.col("_g")), "distractor_contains_gold").when(near_duplicate(against, x), "distractor_matches_gold"))
    distractor = F.get(F.array_compact(told), F.lit(0))
    # likewise of the choices
    size = F.get(F.array_compact(F.transform("_c", lambda x: F.when(F.length(x) > CHOICE_MAX, "choice_too_long").when(choice_form(x).isin(*BANNED_CHOICES), "banned_option_text"))), F.lit(0))
    at = F.get("_f", F.array_position(F.array(*(F.lit(x) for x in LABELS)), m["answer"]).cast("int") - 1)
    rules = RuleSet([
        ("invalid_messages", F.coalesce(F.size("messages") != 2, F.lit(True)) | message(F.col("messages"), "user").isNull()),
        ("invalid_task", ~m["task"].eqNullSafe(F.lit("comprehension_mcq"))),
        ("invalid_source_dataset", F.lit(False) if source_dataset is None else ~m["source_dataset"].eqNullSafe(source_dataset)),
        ("invalid_assistant_answer_format", label.isNull()),
        ("invalid_answer_label", ~F.coalesce(m["answer"].isin(*LABELS) & (m["answer"] == label), F.lit(False))),
        ("missing_choices", F.col("_c").isNull()),
        ("empty_choice", F.exists("_c", blank)),
        ("duplicate_choices_normalized", F.size(F.array_distinct("_f")) != 4),
        ("gold_answer_missing_from_choices", ~F.array_contains("_f", F.col("_g"))),
        ("gold_answer_label_mismatch", at != F.col("_g")),
        (size, size.isNotNull()),
        (distractor, distractor.isNotNull()),
        ("choice_length_imbalance", (long >= IMBALANCE_FROM) & (long >= RATIO_MAX * short)),
        ("missing_choices", F.col("_p").isNull()),
        ("missing_context_or_question", blank(F.col("_p.context")) | blank(F.col("_p.question"))),
    ])
    checked = Stage(r.withColumn("reason", rules.first_reason()).withColumn("_key", m["mcq_dedup_hash"]).drop("_c", "_f", "_g", "_p"))
    out = keep_first_kept(checked, "_key", position, "duplicate_mcq_dedup_hash")
    return Stage(out.rows.drop("_key"))


def soft_checks(records: DataFrame) -> DataFrame:
    """long_choices, uneven_rows, long_answers: what is odd but kept."""
    c = F.transform(_choices(F.col("metadata")), F.length)
    return records.agg(F.coalesce(F.sum(F.size(F.filter(c, lambda n: n > 80))), F.lit(0)).alias("long_choices"), F.count_if(F.array_max(c) - F.array_min(c) >= 20).alias("uneven_rows"), F.count_if(F.length("metadata.gold_answer_text") > 80).alias("long_answers"))


def record_errors() -> RuleSet:
    """All errors of a finished record."""
    m = F.col("metadata")
    user, assistant = message(F.col("messages"), "user"), message(F.col("messages"), "assistant")
    forms = F.transform(_choices(m), choice_form)
    gold = choice_form(m["gold_answer_text"])
    at = F.get(forms, F.array_position(F.array(*(F.lit(x) for x in LABELS)), m["answer"]).cast("int") - 1)
    p = parse_reading_mcq(user)
    return RuleSet([
        ("invalid_messages", F.coalesce(F.size("messages") != 2, F.lit(True))),
        ("empty_user_content", blank(user)),
        ("empty_assistant_content", blank(assistant)),
        ("invalid_assistant_answer_format", ~blank(assistant) & answer_label(assistant).isNull()),
        *((f"missing_metadata_{f}", m[f].isNull()) for f in MCQ_METADATA),
        ("invalid_task", ~m["task"].eqNullSafe(F.lit("comprehension_mcq"))),
        ("invalid_source", ~m["source"].eqNullSafe(F.lit("synthetic"))),
        ("invalid_answer_label", ~F.coalesce(m["answer"].isin(*LABELS), F.lit(False))),
        ("missing_choices", _choices(m).isNull() | p.isNull()),
        ("empty_choice", F.exists(forms, lambda x: x == "")),
        ("duplicate_choices_normalized", F.size(F.array_distinct(forms)) != 4),
        ("gold_answer_missing_from_choices", (gold == "") | ~F.array_contains(forms, gold)),
        ("gold_answer_label_mismatch", F.array_contains(forms, gold) & (at != gold)),
        ("missing_context_or_question", blank(p["context"]) | blank(p["question"])),
    ])


def solver_requests(records: DataFrame) -> Stage:
    """Records fit to be solved, with context, question, choices and gold label."""
    m = F.col("metadata")
    p = parse_reading_mcq(message(F.col("messages"), "user"))
    rules = RuleSet([
        ("invalid_task", ~m["task"].eqNullSafe(F.lit("comprehension_mcq"))),
        ("invalid_source", ~m["source"].eqNullSafe(F.lit("synthetic"))),
        ("invalid_source_dataset", missing(m["source_dataset"])),
        ("invalid_answer_label", ~F.coalesce(m["answer"].isin(*LABELS), F.lit(False))),
        ("invalid_messages", p.isNull()),
    ])
    return Stage(records.withColumn("request", F.struct(p["context"].alias("context"), p["question"].alias("question"), m["choices"].alias("choices"), m["answer"].alias("gold"))).withColumn("reason", rules.first_reason()))


def solver_check(records: DataFrame, solved: DataFrame, position: Column) -> Stage:
    """records joined with the solver's output by content key, then by source_id; kept where it found the gold answer.

    solved: mcq_dedup_hash, source_id, raw_response.
    """
    index = first_by_key(solved, [F.col("mcq_dedup_hash"), F.col("source_id")], position)
    joined = fallback_join(records, index, [F.col("metadata.mcq_dedup_hash"), F.col("metadata.source_id")])
    v = joined.withColumn("_obj", json_object(F.col("match.raw_response"))).withColumn("_v", F.try_parse_json("_obj"))
    answer = F.upper(strip(F.try_variant_get("_v", "$.predicted_answer", "string")))
    bad = F.try_variant_get("_v", "$.bad_reason", "string")
    rules = RuleSet([
        ("missing_solver_output", F.col("match").isNull()),
        ("malformed_solver_json", F.col("_v").isNull()),
        ("invalid_solver_output", answer.isNull()),
        ("invalid_solver_answer", ~answer.isin(*LABELS)),
        ("solver_ambiguous", ~F.try_variant_get("_v", "$.is_unambiguous", "boolean").eqNullSafe(F.lit(True))),
        ("solver_bad_reason", bad.isNotNull() & ~bad.isin("", "false", "0", "[]", "{}")),
        ("solver_mismatch", answer != F.col("metadata.answer")),
    ])
    return Stage(v.withColumn("reason", rules.first_reason()).withColumn("solver_answer", answer).drop("_obj", "_v", "match"))


def finished(records: DataFrame) -> DataFrame:
    """records; using it fails at an invalid record or a repeated key."""
    flags = record_errors().all_flags()
    ok = expect(records, F.size(flags) == 0, "invalid record")
    several = records.groupBy("metadata.mcq_dedup_hash").count().filter("count > 1").agg(F.count("*").alias("_n"))
    return ok.join(F.broadcast(expect(several, F.col("_n") == 0, "duplicate_mcq_dedup_hash")), F.lit(True)).drop("_n")

