"""Pipelines on small fixtures of their own."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import mcq as prompts
from quern.operators.materialize import materialize
from quern.plans import boundary, cloze, comprehension, instruction, mcq, recheck, scoring, training_split

CTX = "x" * 79


def test_cloze_reasons(spark):
    words = " ".join(["chữ"] * 19)
    rows = [(1, None), (2, ""), (3, "một hai ba"), (4, words + " Nội!"), (5, words + " 2024"), (6, words + " ..."), (7, words + "  Nội!"), (8, "chữ " * 101)]
    got = {r.doc_id: (r.reason, r.assistant) for r in cloze.stage(spark.createDataFrame(rows, "doc_id int, text string")).rows.collect()}
    assert got[1][0] == got[2][0] == "empty_text"
    assert got[3][0] == "too_short_3" and got[8][0] == "too_long_101"
    assert got[4] == (None, "Nội") and got[5][0] == "invalid_target_word" and got[6][0] == "empty_target_after_cleaning"
    assert got[7][0] == "duplicate"


@pytest.mark.parametrize(
    ("c", "q", "a", "want"),
    [
        (CTX, "hỏi gì", "a", "context_too_short"), (CTX + "x", "hỏi gì", "a", None), ("x" * 8000, "hỏi gì", "a", None), ("x" * 8001, "hỏi gì", "a", "context_too_long"),
        (CTX + "x", "hỏi?", "a", "question_too_short"), (CTX + "x", "q" * 400, "a", None), (CTX + "x", "q" * 401, "a", "question_too_long"),
        (CTX + "x", "hỏi gì", "a" * 300, None), (CTX + "x", "hỏi gì", "a" * 301, "answer_too_long"), (None, "hỏi gì", "a", "missing_context"), (CTX + "x", None, "a", "missing_question"), (CTX + "x", "hỏi gì", "", "missing_answer"),
    ],
)
def test_length_chain(one, c, q, a, want):
    from quern.operators.rules import RuleSet

    cols = [F.lit(x).cast("string") for x in (c, q, a)]
    assert one(RuleSet(comprehension.length_rules(*cols)).first_reason()) == want


LISTED = "id string, title string, context string, question string, is_impossible boolean, answers struct<text:array<string>,answer_start:array<int>>, split string, _pos int"


def test_listed_answers(spark):
    c = "Hà Nội " + "x" * 90
    rows = [
        ("1", None, c, "Ở đâu vậy?", False, (["Huế", "Hà Nội"], [0, 0]), "train", 1),
        ("2", None, c, "Ở đâu vậy?", True, (["Hà Nội"], [0]), "train", 2),
        ("3", None, c, "Ở đâu vậy?", False, None, "train", 3),
        ("4", None, c, "Ở đâu vậy?", False, (["Huế"], [0]), "train", 4),
        ("5", None, None, "Ở đâu vậy?", False, (["Huế"], [0]), "train", 5),
        ("6", None, "x" * 400 + " y", "Ở đâu vậy?", False, (["x" * 301, "y"], [0, 401]), "train", 6),
        ("7", None, "x" * 400, "Ở đâu vậy?", False, (["x" * 301], [0]), "train", 7),
    ]
    got = {r.id: (r.reason, r.answer_text) for r in comprehension.listed_answers(spark.createDataFrame(rows, LISTED)).rows.collect()}
    assert got["1"] == (None, "Hà Nội") and got["6"] == (None, "y")
    assert [got[k][0] for k in "23457"] == ["is_impossible", "missing_field", "no_valid_answer_variant", "schema_error", "answer_too_long"]


SINGLE = "id string, context string, question string, answer string, answer_start int, split string, _pos int"


def test_single_answer_keeps_the_validated_place(spark):
    base = "Hà_Nội " + "y" * 73 + "Hà_Nội"
    rows = [
        ("1", base, "Ở đâu vậy?", "Hà_Nội", 80, "train", 1),
        ("2", "  " + base, "Ở đâu vậy?", "Hà_Nội", 2, "train", 2),
        ("3", base, "Ở đâu vậy?", "Hà_Nội", 3, "train", 3),
        ("4", base, "Ở đâu vậy?", "Hà_Nội", 999, "train", 4),
        ("5", base, "Ở đâu vậy?", "Hà_Nội", None, "train", 5),
    ]
    got = {r.id: r for r in comprehension.single_answer(spark.createDataFrame(rows, SINGLE)).rows.collect()}
    assert (got["1"].reason, got["1"].answer_start, got["1"].answer_text) == (None, 80, "Hà Nội")
    assert (got["2"].reason, got["2"].answer_start) == (None, 0)
    assert [got[k].reason for k in "345"] == ["span_mismatch", "answer_start_out_of_range", "invalid_answer_start"]


def test_first_source_wins(spark):
    c = "Hà Nội " + "x" * 90
    a = comprehension.listed_answers(spark.createDataFrame([("1", None, c, "Ở đâu vậy?", False, (["Hà Nội"], [0]), "train", 1)], LISTED))
    b = comprehension.single_answer(spark.createDataFrame([("2", c, "Ở  đâu vậy?", "Hà Nội", 0, "train", 1)], SINGLE))
    pool = comprehension.pool([("one", a), ("two", b)])
    assert {(r.source_dataset, r.reason) for r in pool.rows.collect()} == {("one", None), ("two", "duplicate")}
    records = comprehension.raw_records(pool.kept)
    assert records.filter(F.size(comprehension.raw_errors().all_flags()) > 0).count() == 0
    broken = records.withColumn("context", F.lit("z"))
    assert "user content does not match context/question" in broken.select(comprehension.raw_errors().all_flags().alias("e")).first().e


def _raw(spark, n=1, **over):
    c = "Hà Nội là thủ đô. " + "x" * 90
    meta = {"task": "comprehension_raw", "source_dataset": "d", "source_split": "train", "source_id": "s1", "dedup_hash": "raw-hash-1", "span_check_mode": "strict_exact", "answer_variants": [("Hà Nội", 0)]} | over
    schema = "row_id int, context string, question string, answer_text string, messages array<struct<role:string,content:string>>, metadata struct<task:string,source_dataset:string,source_split:string,source_id:string,dedup_hash:string,span_check_mode:string,answer_variants:array<struct<text:string,answer_start:int>>>"
    keys = ("task", "source_dataset", "source_split", "source_id", "dedup_hash", "span_check_mode", "answer_variants")
    return spark.createDataFrame([(n, over.get("context", c), over.get("question", "Đâu là thủ đô?"), over.get("answer", "Hà Nội"), [], tuple(meta[k] for k in keys))], schema)


@pytest.mark.parametrize(
    ("over", "want"),
    [({}, None), ({"answer": "a"}, "answer_too_short"), ({"answer": "a" * 221}, "answer_too_long"), ({"context": "x" * 8001}, "context_too_long"), ({"question": " Ai? "}, "question_too_short"), ({"answer": "cả A và b"}, "generic_answer_text"), ({"answer": " "}, "missing_answer")],
)
def test_generation_requests(spark, over, want):
    assert comprehension.generation_requests(_raw(spark, **over)).rows.first().reason == want


def test_slice(spark):
    rows = _raw(spark).unionByName(_raw(spark, source_dataset="e")).unionByName(_raw(spark, span_check_mode="x")).unionByName(_raw(spark, answer_variants=[]))
    assert sorted(str(r.reason) for r in comprehension.slice_of(rows, "d").rows.collect()) == ["None", "answer_variants_empty", "source_dataset", "span_check_mode"]


GEN = "source_id string, request_id string, raw_response string, parsed_response struct<distractors:array<string>,notes:string>, pos int"


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ('{"distractors": ["Huế", "Đà Nẵng", "Vinh"]}', None),
        ('```json\n{"distractors": ["Huế", "Đà Nẵng", "Vinh"]}\n```', None),
        ('Đây: {"distractors": ["Huế", "Vinh"]}', "wrong_distractor_count"),
        ("không có", "wrong_distractor_count"),
        ('{"distractors": [}', "malformed_generation_json"),
        ('{"distractors": ["Huế", "", "Vinh"]}', "empty_distractor"),
        ('{"distractors": ["Huế", "A. huế", "Vinh"]}', "duplicate_distractors"),
        ('{"distractors": ["Huế", "hà nội", "Vinh"]}', "distractor_matches_gold"),
        ('{"distractors": ["Huế", "thành phố Hà Nội", "Vinh"]}', "distractor_contains_gold"),
    ],
)
def test_candidates(spark, response, want):
    gen = spark.createDataFrame([("s1", "r1", response, None, 1)], GEN)
    assert mcq.candidates(_raw(spark), gen, F.col("pos")).rows.first().reason == want


def test_construction_end_to_end(spark):
    gen = spark.createDataFrame([(None, "cmcq-gen-s1", None, (["Huế", "Đà Nẵng", "Vinh"], None), 1)], GEN)
    stage = mcq.candidates(_raw(spark).unionByName(_raw(spark, n=2, source_id="s2", dedup_hash="h2")), gen, F.col("pos"))
    assert sorted(str(r.reason) for r in stage.rows.collect()) == ["None", "missing_generation_output"]
    records = materialize(mcq.candidate_records(stage.kept), "records")
    r = records.first()
    assert r.metadata.answer == "C" and r.metadata.choices["C"] == "Hà Nội" and r.messages[1].content == "Đáp án: C"
    assert mcq.rule_check(records, "row_id").rows.first().reason is None
    assert mcq.rule_check(records.unionByName(records.withColumn("row_id", F.lit(9))), "row_id").rejects.first().reason == "duplicate_mcq_dedup_hash"
    assert mcq.record_errors().failures(records).filter("rows > 0").count() == 0
    assert mcq.finished(records).count() == 1
    with pytest.raises(Exception, match="duplicate_mcq_dedup_hash"):
        mcq.finished(records.unionByName(records)).collect()
    assert mcq.solver_requests(records).rows.first().request.gold == "C"
    solved = lambda text: spark.createDataFrame([(None, "s1", text, 1)], "mcq_dedup_hash string, source_id string, raw_response string, pos int")
    reason = lambda text: mcq.solver_check(records, solved(text), F.col("pos")).rows.first().reason
    ok = {"predicted_answer": "C", "is_unambiguous": True, "bad_reason": None}
    assert reason(json.dumps(ok)) is None and reason(f"```json\n{json.dumps(ok)}\n```") is None
    assert reason(json.dumps(ok | {"predicted_answer": "A"})) == "solver_mismatch"
    assert reason(json.dumps(ok | {"is_unambiguous": False})) == "solver_ambiguous"
    assert reason(json.dumps(ok | {"bad_reason": "mơ hồ"})) == "solver_bad_reason"
    assert reason(json.dumps(ok | {"predicted_answer": "E"})) == "invalid_solver_answer"
    assert reason("x") == "malformed_solver_json" and reason("{}") == "invalid_solver_output"
    assert mcq.soft_checks(records).first().long_choices == 0


@pytest.fixture(scope="module")
def records(spark):
    gen = spark.createDataFrame([("s1", "r1", '{"distractors": ["Huế", "Đà Nẵng", "Vinh"]}', None, 1)], GEN)
    return materialize(mcq.candidate_records(mcq.candidates(_raw(spark), gen, F.col("pos")).kept), "records")


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"task": "x"}, "invalid_task"), ({"answer": "E"}, "invalid_answer_label"), ({"choices": {"A": "a"}}, "missing_choices"),
        ({"choices": {"A": "Huế", "B": "Vinh", "C": " ", "D": "Lào"}}, "empty_choice"), ({"choices": {"A": "Huế", "B": "huế", "C": "Hà Nội", "D": "Lào"}}, "duplicate_choices_normalized"),
        ({"choices": {"A": "Huế", "B": "Vinh", "C": "Lào", "D": "Mai"}}, "gold_answer_missing_from_choices"), ({"choices": {"A": "Hà Nội", "B": "Vinh", "C": "Lào", "D": "Mai"}}, "gold_answer_label_mismatch"),
        ({"choices": {"A": "y" * 301, "B": "Vinh", "C": "Hà Nội", "D": "Mai"}}, "choice_too_long"), ({"choices": {"A": "Không có thông tin", "B": "Vinh", "C": "Hà Nội", "D": "Mai"}}, "banned_option_text"),
        ({"choices": {"A": "Thủ đô Hà Nội", "B": "Vinh", "C": "Hà Nội", "D": "Mai"}}, "distractor_contains_gold"), ({"choices": {"A": "z" * 60, "B": "Vinh", "C": "Hà Nội", "D": "Mai"}}, "choice_length_imbalance"),
    ],
)
def test_rule_check(records, change, want):
    meta = F.col("metadata")
    for k, v in change.items():
        meta = meta.withField(k, F.create_map(*(F.lit(x) for kv in v.items() for x in kv)) if isinstance(v, dict) else F.lit(v))
    assert mcq.rule_check(records.withColumn("metadata", meta), "row_id").rows.first().reason == want


def test_exams(spark):
    schema = "question string, options array<string>, answer string, level string, category_original_lang string, category_en string, _pos int"
    rows = spark.createDataFrame([("Hỏi?", ["A. 1", "2", "3", "4"], "2", "12", None, "Maths", 7), ("Hỏi?", ["1"], "2", "1", None, None, 8)], schema)
    flat = mcq.exam_rows(rows, "x")
    assert flat.count() == 1 and flat.first().asDict() | {"question": "Hỏi?"} == {"question": "Hỏi?", "choice_a": "A. 1", "choice_b": "2", "choice_c": "3", "choice_d": "4", "answer_letter": "B", "subject": "Maths", "grade": "12", "sample_id": "x_7"}
    listed = mcq.exam_rows(rows.withColumn("options", F.lit("['1', '2', '3', '4']")), "x")
    assert listed.first().choice_d == "4"
    nested = spark.createDataFrame([("p", "5", [("Hỏi?", ["A. 1", "B. 2", "C. 3", "D. 4"], "Chọn đáp án C")]), ("q", "5", None)], "id string, grade string, problems array<struct<question:string,choices:array<string>,explanation:string>>")
    got = {r.sample_id: r for r in mcq.nested_exam_rows(nested).collect()}
    assert got["p_0"].choice_a == "1" and got["p_0"].answer_letter == "C" and len(got) == 2
    both = flat.unionByName(mcq.nested_exam_rows(nested)).withColumn("row_id", F.monotonically_increasing_id())
    kept = mcq.without_labels(mcq.exams(both, "row_id").kept)
    assert kept.count() == 2 and mcq.exam_records(kept).first().messages[0].content.startswith("Câu hỏi: Hỏi?\nA. 1\nB. 2")


def test_wiki_and_cleanup(spark):
    rows = spark.createDataFrame([(1, " Hỏi ", ["1", "2", "3", "4"], "0"), (2, "Hỏi", ["1", "2", "3", "4"], "a."), (3, "", ["1"], "x")], "row_id int, question string, choices array<string>, answer string")
    got = {r.row_id: r.reason for r in mcq.wiki(rows, "row_id").rows.collect()}
    assert got == {1: None, 2: "duplicate", 3: "missing_question+invalid_choices+invalid_answer"}
    chat = lambda user, answer, subject: (1, [("user", user), ("assistant", answer)], (subject,))
    good = "Câu hỏi: x\nA. 1\nB. 2\nC. 3\nD. 4"
    df = spark.createDataFrame([chat(good, "Đáp án: A", "s"), chat(good + " according to", "A", "t"), chat(good.replace("2", "1"), "Đáp án: A", "s")], "row_id int, messages array<struct<role:string,content:string>>, metadata struct<subject:string>")
    flags = sorted((r.qc_flags for r in mcq.cleanup(df, ["s"]).rows.collect()), key=len)
    assert flags == [[], ["duplicate_choices_or_invalid_choice_format"], ["subject_not_in_wiki_mcq_whitelist", "invalid_assistant_answer_format", "hard_english_artifact"]]


def test_math_triage(spark):
    p = "Câu hỏi: {}\nA. 1\nB. 2\nC. 3\nD. 4"
    rows = spark.createDataFrame([(1, p.format(r"\frac{1}{2}")), (2, p.format("không")), (3, p.format("$x")), (4, p.format("2^3"))], "row_id int, text string")
    issues = spark.createDataFrame([(1,), (2,), (3,)], "row_id int")
    got = {r.row_id: (r.action, r.fixed) for r in mcq.math_triage(rows, issues, "row_id", "text").collect()}
    assert [got[k][0] for k in (1, 2, 3, 4)] == ["fixed_by_rule", "keep_false_positive", "drop_unresolved_math_format_issue", "keep"]
    assert r"$\frac{1}{2}$" in got[1][1] and got[4][1] == p.format("2^3")


def test_fix_reason(one):
    good = "Câu hỏi: x\nA. 1\nB. 2\nC. 3\nD. 4"
    assert one(mcq.fix_reason(F.lit(good), F.lit(good))) is None
    assert one(mcq.fix_reason(F.lit(good), F.lit("Câu hỏi: x"))) == "invalid_user_content_format"
    assert one(mcq.fix_reason(F.lit(good), F.lit(" "))) == "empty_fixed_text"


def test_instruction_reasons(spark):
    rows = [
        (1, "Hãy viết một câu.", None, "Đây là một câu dài."), (2, "Hãy viết", None, "Đây là một câu dài."), (3, "Hãy viết một câu.", "", "ngắn"), (4, "### Human: Hãy viết một câu.", "", "Đây là một câu dài."),
        (5, "Chọn:\nA. 1\nB. 2\nC. 3\nD. 4", None, "Đáp án: B"), (6, None, None, None), (7, "Hãy viết một câu.", "phụ", "Đây là một câu dài."),
    ]
    got = {r._row_index: r.reason for r in instruction.single_turns(spark.createDataFrame(rows, "_row_index int, instruction string, input string, output string")).rows.collect()}
    assert got == {1: None, 2: "user_too_short", 3: "assistant_too_short", 4: "duplicate", 5: "assistant_too_short", 6: "user_too_short", 7: None}


def test_dialogues_and_sample(spark):
    rows = [(n, [("system", "s"), ("user", f"Câu hỏi số {n} là gì?"), ("assistant", f"Trả lời cho câu số {n}.")]) for n in range(20)] + [(99, [("user", "x")])]
    stage = instruction.dialogues(spark.createDataFrame(rows, "p int, messages array<struct<role:string,content:string>>"), "p")
    assert stage.rejects.first().reason == "no_valid_user_assistant_pair"
    a, b = (sorted(r.metadata.dedup_hash for r in instruction.records(stage.kept.repartition(k), "first_turn_pair", "d", 7).collect()) for k in (1, 6))
    assert a == b and len(a) == 7


def test_training_split(spark):
    bucket = lambda task, n: spark.range(n).select(F.col("id").alias("pos"), prompts.chat(F.concat(F.lit(f"{task} "), F.col("id").cast("string")), F.lit("a")).alias("messages"), F.struct(F.lit(task).cast("string").alias("task")).alias("metadata"))
    rows = training_split.together([bucket("exams_mcq", 100), bucket("cloze_lm_retention", 100), bucket("exams_mcq", 10), bucket("other", 3)])
    stage = training_split.split(rows)
    got = {(r.task, r.split, r.reason): r.rows for r in training_split.manifest(stage).collect()}
    assert got == {("exams_mcq", "train", None): 90, ("exams_mcq", "val", None): 5, ("exams_mcq", "shadow", None): 5, ("cloze_lm_retention", "train", None): 95, ("cloze_lm_retention", "probe", None): 5, ("exams_mcq", None, "duplicate"): 10, ("other", None, "unknown_task"): 3}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Đáp án: B", ("B", "ok_strict")), ("c.", ("C", "ok_fallback")), ("Tôi chọn D nhé", ("D", "ok_fallback")), ("Phương án A", ("A", "ok_fallback")), ("Đáp án: A\nĐáp án: B", (None, "invalid_multi_label")),
        ("Đáp án: E", (None, "invalid_out_of_set")), ("không biết", (None, "invalid_no_label")), (" \n ", (None, "invalid_empty")), (None, (None, "invalid_empty")), ("một\nhai\nba\nĐáp án: A", (None, "invalid_no_label")), ("Đáp án: A\nE", (None, "invalid_multi_label")),
    ],
)
def test_parsed_predictions(one, text, want):
    assert tuple(one(scoring.parsed(F.lit(text).cast("string")))) == want


def test_scores(one):
    assert one(scoring.is_correct(F.lit("Đáp án: B"), F.lit("(b)"))) and not one(scoring.is_correct(F.lit("x"), F.lit("B")))
    assert one(scoring.is_same_word(F.lit(" Nội. "), F.lit("nội"))) and not one(scoring.is_same_word(F.lit(None).cast("string"), F.lit("nội")))
    assert one(scoring.answer_key(F.lit("123"))) is None


def test_recheck(spark):
    df = spark.createDataFrame([([("user", "u"), ("assistant", "a")], ("t", "k")), ([("user", "Human: u"), ("assistant", " ")], ("t", "k"))], "messages array<struct<role:string,content:string>>, metadata struct<task:string,dedup_hash:string>")
    errors = recheck.chat_errors("t", "dedup_hash")
    assert recheck.summary(df, errors, F.col("metadata.dedup_hash")).first().asDict() == {"rows": 2, "invalid": 1, "mcq_like": 0, "with_markers": 1, "repeated_keys": 1}
    assert recheck.exit_code(df, errors) == 1 and recheck.exit_code(df.limit(0), errors) == 0
    assert recheck.spot_check(df, F.col("metadata.dedup_hash"), 1).count() == 1


def test_backoff():
    assert list(boundary.waits(draw=lambda: 0.0)) == [2, 4, 8, 16, 32] and max(boundary.waits(8, lambda: 1.0)) == 75
    calls, slept = [], []

    def model(batch):
        calls.append(batch)
        if len(calls) < 3:
            raise boundary.ModelError(503)
        return batch

    assert boundary.call(model, [1], slept.append, lambda: 0.0) == [1] and slept == [2, 4]
    with pytest.raises(boundary.ModelError):
        boundary.call(lambda b: (_ for _ in ()).throw(boundary.ModelError(400)), [1], slept.append)


def test_matched_responses(spark):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("x", "t")], "k string, fixed string")
    assert boundary.matched(a, b, "k").first().fixed == "t"
    with pytest.raises(Exception, match="don't match"):
        boundary.matched(a, b.withColumn("k", F.lit("y")), "k").collect()


def test_groups_stay_together_and_tasks_are_capped(spark):
    rows = spark.range(400).select(F.col("id").alias("pos"), F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"), F.struct(F.lit("exams_mcq").alias("task")).alias("metadata"), (F.col("id") % 100).alias("g"))
    grouped = training_split.split(training_split.together([rows], "g")).kept
    assert grouped.groupBy("group").agg(F.count_distinct("split").alias("n")).filter("n <> 1").count() == 0
    assert {r.split: r["count"] for r in grouped.groupBy("split").count().collect()} == {"train": 360, "val": 20, "shadow": 20}
    capped = training_split.split(training_split.together([rows]), cap_per_task=100)
    assert {(r.split, r.reason): r.n for r in capped.rows.groupBy("split", "reason").agg(F.count("*").alias("n")).collect()} == {("train", None): 100, (None, "over_cap"): 260, ("val", None): 20, ("shadow", None): 20}


def test_distractors_are_judged_in_their_order(spark):
    def record(n, choices, gold):
        user = prompts.READ_AND_CHOOSE + "\n\nĐoạn văn: một đoạn\n\nCâu hỏi: Cái gì?\n" + "\n".join(f"{x}. {c}" for x, c in zip("ABCD", choices))
        meta = ("comprehension_mcq", gold, "A", dict(zip("ABCD", choices)), f"k{n}")
        return (n, [("user", user), ("assistant", "Đáp án: A")], meta)

    schema = "row_id bigint, messages array<struct<role:string,content:string>>, metadata struct<task:string,gold_answer_text:string,answer:string,choices:map<string,string>,mcq_dedup_hash:string>"
    rows = [
        record(1, ["sông Hồng", "dòng sông Hồng lớn", "x", "y"], "sông Hồng"),
        record(2, ["sông Hồng lớn", "x", "sông Hồng", "y"], "sông Hồng lớn"),
        record(3, ["sông Hồng lớn", "sông Hồng", "sông Hồng lớn nhất", "y"], "sông Hồng lớn"),
        record(4, ["sông Hồng", "cả a và b", "x" * 301, "y"], "sông Hồng"),
        record(5, ["sông Hồng", "x" * 301, "cả a và b", "y"], "sông Hồng"),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("metadata", F.struct("metadata.*", F.lit("d").alias("source_dataset")))
    got = {r.row_id: r.reason for r in mcq.rule_check(df, "row_id").rows.collect()}
    assert got == {1: "distractor_contains_gold", 2: "distractor_matches_gold", 3: "distractor_matches_gold", 4: "banned_option_text", 5: "choice_too_long"}


def test_repair_log(spark):
    prompt = lambda q: f"Câu hỏi: {q}\nA. một\nB. hai\nC. ba\nD. bốn"
    rows = spark.createDataFrame([("a", prompt(r"Tính \frac{1}{2}?")), ("b", prompt("Tính gì?")), ("c", prompt("Giá $5?")), ("d", "không phải"), ("e", prompt("Và $6?")), ("f", prompt("Rồi $7?")), ("g", prompt("Lại $8?"))], "source_id string, text string")
    issues = spark.createDataFrame([(x,) for x in "abcdefgz"], "source_id string")
    answers = spark.createDataFrame([("c", prompt("Giá 5 đô?"), False), ("e", "hỏng", False), ("f", None, True), ("a", "nobody asked", False)], "source_id string, fixed string, failed boolean")
    got = sorted((r.source_id, r.status, r.reason, r.fixed is not None) for r in mcq.repair_log(rows, issues, answers).collect())
    assert got == [
        ("a", "fixed_by_rule", None, True),
        ("b", "false_positive_or_no_change_needed", None, False),
        ("c", "fixed_by_gemini", None, True),
        ("c", "needs_gemini", None, False),
        ("d", "invalid_original_user_content", None, False),
        ("e", "gemini_fix_rejected", "invalid_user_content_format", False),
        ("e", "needs_gemini", None, False),
        ("f", "gemini_batch_failed", None, False),
        ("f", "needs_gemini", None, False),
        ("g", "needs_gemini", None, False),
        ("z", "missing_source_id_in_jsonl", None, False),
    ]


def test_format_flags(spark):
    text = "Câu hỏi: " + "giá $5 | a__b x^2 x_1 {} &lt;\nA. \\\\frac\nB. \\sqrt\nC. \\begin \\end\nD. \\n $$"
    df = spark.createDataFrame([(1, text, "astronomy"), (2, text, "khác"), (3, "không", "astronomy")], "id int, t string, s string")
    got = mcq.format_issues(df, F.col("t"), F.col("s")).collect()
    assert [r.id for r in got] == [1] and got[0].flags == list(mcq.SUSPICIOUS)
