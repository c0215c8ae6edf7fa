"""Queries of the core library over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import keys, mcq, text
from quern.functions.pyudf import is_json, math_flags
from quern.operators import dedup, leakage, lookup, split, stats
from quern.operators.materialize import materialize
from quern.operators.rules import RuleSet
from quern.operators.setjoin import similar_sets
from quern.plans import cloze, comprehension, instruction, recheck, scoring, training_split
from quern.plans import mcq as mcq_plan
from quern.queries import sqltext as q
from quern.queries.registry import query

READING = "phongthi/vi_trich_doan"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))


# Cloze

_CLOZE = f"""
base as (select doc_id, text, {q.clean("nfc_normalize(text)")} as t from documents),
w as (select doc_id, text, t, {q.words("t")} as ws from base),
c as (select doc_id, text, ws, len(ws) as n, regexp_replace(coalesce(ws[len(ws)], ''), '[.,!?"'':;]+$', '') as target from w),
r as (select doc_id, target, array_to_string(ws[1:n-1], ' ') as ctx,
      case when text is null or text = '' then 'empty_text' when n < 20 then 'too_short_' || n when n > 100 then 'too_long_' || n
           when target = '' then 'empty_target_after_cleaning' when not regexp_full_match(target, '\\pL+') then 'invalid_target_word' end as reason from c),
p as (select doc_id, target, reason, sha1({q.lit(mcq.NEXT_WORD)} || chr(10) || chr(10) || ctx || '...' || '|' || target) as dedup_hash from r),
k as (select *, case when reason is null and row_number() over (partition by reason is null, dedup_hash order by doc_id) > 1 then 'duplicate' else reason end as why from p)
"""


@query(f"with {_CLOZE} select doc_id, why as reason from k")
def cloze_reasons(spark: SparkSession, d: str) -> DataFrame:
    return cloze.stage(_t(spark, d, "documents")).rows.select("doc_id", "reason")


@query(f"with {_CLOZE} select doc_id, target as assistant, dedup_hash from k where why is null")
def cloze_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cloze.stage(_t(spark, d, "documents")).kept.select("doc_id", "assistant", "dedup_hash")


@query(
    f"""with {_CLOZE}, o as (select *, row_number() over (order by sha1('42/' || dedup_hash)) as rk, count(*) over () as n from k where why is null)
select case when rk <= floor(n * 0.95::double) then 'train' else 'probe' end as split, count(*) as rows from o group by 1"""
)
def cloze_split_report(spark: SparkSession, d: str) -> DataFrame:
    kept = cloze.stage(_t(spark, d, "documents")).kept.withColumn("task", F.lit("cloze_lm_retention"))
    parts = split.split_groups(kept, "task", F.sha1(F.concat(F.lit("42/"), "dedup_hash")), training_split.TWO_WAY, "probe")
    return _counts(parts, "split")


@query(
    f"""with {_CLOZE}, s as (select *, coalesce(sum(case when why is null then 1 else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as seen from k)
select why as reason, count(*) as rows from s where seen < 50 group by 1"""
)
def cloze_capped(spark: SparkSession, d: str) -> DataFrame:
    """The prefix of a reader that stops at 50 accepted rows (a cap is the feature)."""
    return _counts(cloze.capped(_t(spark, d, "documents"), 50).rows, "reason")


# Reading comprehension

_LENGTHS = f"""case when {q.missing("context")} then 'missing_context' when length(context) < 80 then 'context_too_short' when length(context) > 8000 then 'context_too_long'
 when {q.missing("question")} then 'missing_question' when length(question) < 5 then 'question_too_short' when length(question) > 400 then 'question_too_long'
 when {q.missing("answer_text")} then 'missing_answer' when length(answer_text) > 300 then 'answer_too_long' end"""


@query(f"select row_id, {_LENGTHS} as reason from comprehension_seed_raw")
def length_reasons(spark: SparkSession, d: str) -> DataFrame:
    rules = RuleSet(comprehension.length_rules(F.col("context"), F.col("question"), F.col("answer_text")))
    return _t(spark, d, "comprehension_seed_raw").select("row_id", rules.first_reason().alias("reason"))


@query(
    f"""select row_id, sha1({q.hash_form("context")} || chr(10) || {q.hash_form("question")} || chr(10) || {q.hash_form("answer_text")}) as qa_key,
sha1({q.hash_form("context")}) as context_key from comprehension_seed_raw"""
)
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "comprehension_seed_raw")
    return t.select("row_id", keys.qa_key(F.col("context"), F.col("question"), F.col("answer_text")).alias("qa_key"), keys.context_key(F.col("context")).alias("context_key"))


@query(
    f"""with k as (select row_id, sha1({q.hash_form("context")} || chr(10) || {q.hash_form("question")} || chr(10) || {q.hash_form("answer_text")}) as k from comprehension_seed_raw)
select row_id, case when row_number() over (partition by k order by row_id) > 1 then 'duplicate' end as reason from k"""
)
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "comprehension_seed_raw")
    keyed = t.select("row_id", keys.qa_key(F.col("context"), F.col("question"), F.col("answer_text")).alias("k"))
    return dedup.keep_first(keyed, ["k"], "row_id").rows.select("row_id", "reason")


@query(
    """with b as (select row_id, metadata.dedup_hash as h from comprehension_seed_raw),
f as (select h, min(row_id) as first from b where h is not null and trim(h, ' ') <> '' group by 1)
select b.row_id, case when b.h is null or trim(b.h, ' ') = '' then 'schema_error' when f.first <> b.row_id then 'duplicate' end as reason from b left join f on f.h = b.h"""
)
def dedup_given_hash(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "comprehension_seed_raw").select("row_id", F.col("metadata.dedup_hash").alias("h"))
    return dedup.keep_first_or_invalid(t, "h", "row_id").rows.select("row_id", "reason")


@query(
    """with m as (select row_id, sha256(array_to_string(list_transform(messages, lambda m: '[' || coalesce(m.role, '') || ']:' || coalesce(m.content, '') || '|'), '')) as k from comprehension_seed_raw)
select k as key, count(*) as copies, min(row_id) as first from m group by 1"""
)
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "comprehension_seed_raw")
    return dedup.first_positions(t, keys.record_key(F.col("messages")), F.col("row_id")).select("key", "copies", "first")


_SPAN = "substring(context, metadata.answer_start + 1, length(answer_text)) = answer_text and metadata.answer_start >= 0"


@query(
    f"""select case when context is null or answer_text is null or metadata.answer_start is null then 'missing' when {_SPAN} then 'exact'
when position(answer_text in context) > 0 then 'elsewhere' else 'absent' end as span, count(*) as rows from comprehension_seed_raw group by 1"""
)
def span_check(spark: SparkSession, d: str) -> DataFrame:
    c, a, s = F.col("context"), F.col("answer_text"), F.col("metadata.answer_start")
    kind = F.when(c.isNull() | a.isNull() | s.isNull(), "missing").when(text.span_matches(c, s, a), "exact").when(text.find_from(c, a, F.lit(0)) >= 0, "elsewhere").otherwise("absent")
    return _counts(_t(spark, d, "comprehension_seed_raw").select(kind.alias("span")), "span")


@query(
    """select row_id, len(list_filter(metadata.answer_variants, lambda v: v.text <> '' and v.answer_start >= 0 and substring(context, v.answer_start + 1, length(v.text)) = v.text)) as valid_variants
from comprehension_seed_raw where context is not null and metadata.answer_variants is not null"""
)
def valid_variants(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "comprehension_seed_raw").filter("context is not null and metadata.answer_variants is not null")
    v = F.col("metadata.answer_variants")
    return t.select("row_id", F.size(comprehension.valid_variants(F.col("context"), v["text"], v["answer_start"])).alias("valid_variants").cast("bigint"))


def _error(name: str, cond: str) -> str:
    return f"case when {cond} then {q.lit(name)} end"


_RAW_ERRORS = ", ".join([
    _error("messages must have exactly 2 elements", "coalesce(len(messages) <> 2, true)"),
    _error("first role is not user", "messages[1].role is distinct from 'user'"),
    _error("user content does not match context/question", "messages[1].content is distinct from ('Đoạn văn: ' || context || chr(10) || chr(10) || 'Câu hỏi: ' || question)"),
    _error("second role is not assistant", "messages[2].role is distinct from 'assistant'"),
    _error("assistant content does not match answer_text", "messages[2].content is distinct from answer_text"),
    _error("metadata.task is not comprehension_raw", "metadata.task is distinct from 'comprehension_raw'"),
    _error("context is not a non-empty string", q.blank("context")),
    _error("question is not a non-empty string", q.blank("question")),
    _error("answer_text is not a non-empty string", q.blank("answer_text")),
    _error("answer_text does not appear in context", f"not {q.blank('answer_text')} and not {q.blank('context')} and not contains(context, answer_text)"),
    _error("metadata.answer_text does not match top-level answer_text", "metadata.answer_text is distinct from answer_text"),
    _error("metadata.dedup_hash is not a non-empty string", q.blank("metadata.dedup_hash")),
    _error("strict_exact span does not match context slice", f"metadata.span_check_mode = 'strict_exact' and not {q.blank('context')} and not {q.blank('answer_text')} and metadata.answer_start is not null and not ({_SPAN})"),
])


@query(f"select row_id, array_to_string([{_RAW_ERRORS}], '; ') as errors from comprehension_seed_raw")
def raw_record_errors(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "comprehension_seed_raw")
    return t.select("row_id", F.array_join(comprehension.raw_errors().all_flags(), "; ").alias("errors"))


@query(
    f"""select row_id, case when metadata is null then 'missing_metadata' when metadata.source_dataset is distinct from '{READING}' then 'source_dataset'
when metadata.span_check_mode is distinct from 'strict_exact' then 'span_check_mode' when coalesce(len(metadata.answer_variants), 0) < 1 then 'answer_variants_empty' end as reason from comprehension_seed_raw"""
)
def slice_reasons(spark: SparkSession, d: str) -> DataFrame:
    return comprehension.slice_of(_t(spark, d, "comprehension_seed_raw"), READING).rows.select("row_id", "reason")


_SHORT = f"{q.lit(mcq.ANSWER_SHORTLY)} || chr(10) || chr(10) || 'Đoạn văn: ' || context || chr(10) || chr(10) || 'Câu hỏi: ' || question"


@query(
    f"""with b as (select row_id, case when metadata.source_dataset is distinct from '{READING}' then 'other_source' when {q.missing("context")} or {q.missing("question")} or {q.missing("answer_text")} then 'missing_field' end as r,
sha1({_SHORT} || '|' || answer_text) as h from comprehension_seed_raw),
k as (select *, row_number() over (partition by r is null, h order by row_id) as rn from b)
select row_id, h as dedup_hash from k where r is null and rn = 1"""
)
def short_answers(spark: SparkSession, d: str) -> DataFrame:
    return comprehension.short_answers(_t(spark, d, "comprehension_seed_raw"), READING, "row_id").kept.select("row_id", "dedup_hash")


_GEN = f"""case when metadata is null then 'invalid_raw_record' when {q.blank("context")} then 'missing_context' when {q.blank("question")} then 'missing_question'
when length({q.strip("question")}) < 5 then 'question_too_short' when {q.blank("answer_text")} then 'missing_answer' when length({q.strip("answer_text")}) < 2 then 'answer_too_short'
when length({q.strip("answer_text")}) > 220 then 'answer_too_long' when {q.hash_form("answer_text")} in ({", ".join(q.lit(g.lower()) for g in comprehension.GENERIC_ANSWERS)}) then 'generic_answer_text'
when length({q.strip("context")}) > 8000 then 'context_too_long' end"""


@query(f"select row_id, {_GEN} as reason from comprehension_seed_raw")
def generation_reasons(spark: SparkSession, d: str) -> DataFrame:
    return comprehension.generation_requests(_t(spark, d, "comprehension_seed_raw")).rows.select("row_id", "reason")


# Generated distractors

_FIRST = """g as (select *, row_number() over (order by created_at nulls first, request_id nulls first, model nulls first, coalesce(raw_response, chr(65535))) as pos from generation_output),
idx as (select key, arg_min(pos, pos) as pos from (select source_id as key, pos from g union all select request_id, pos from g) where key is not null and key <> '' group by key)"""


def _positioned(generated: DataFrame) -> Column:
    return F.struct("created_at", "request_id", "model", F.coalesce("raw_response", F.lit("\uffff")))


@query(
    f"""with {_FIRST},
j as (select c.row_id, coalesce(a.pos, b.pos) as pos from comprehension_seed_raw c left join idx a on a.key = c.metadata.source_id left join idx b on b.key = 'cmcq-gen-' || c.metadata.source_id)
select j.row_id, g.request_id from j left join g on g.pos = j.pos"""
)
def fallback_join(spark: SparkSession, d: str) -> DataFrame:
    gen = _t(spark, d, "generation_output")
    index = lookup.first_by_key(gen, [F.col("source_id"), F.col("request_id")], _positioned(gen))
    sid = F.col("metadata.source_id")
    out = lookup.fallback_join(_t(spark, d, "comprehension_seed_raw"), index, [sid, F.concat(F.lit("cmcq-gen-"), sid)])
    return out.select("row_id", F.col("match.request_id").alias("request_id"))


@query()
def distractor_reasons(spark: SparkSession, d: str) -> DataFrame:
    gen = _t(spark, d, "generation_output")
    return mcq_plan.candidates(_t(spark, d, "comprehension_seed_raw"), gen, _positioned(gen)).rows.select("row_id", "reason")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    gen = _t(spark, d, "generation_output")
    return materialize(mcq_plan.candidate_records(mcq_plan.candidates(_t(spark, d, "comprehension_seed_raw"), gen, _positioned(gen)).kept), "candidates")


@query()
def mcq_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("row_id", "metadata.mcq_dedup_hash", "metadata.answer")


@query()
def rule_check_reasons(spark: SparkSession, d: str) -> DataFrame:
    return mcq_plan.rule_check(_candidates(spark, d), "row_id").rows.select("row_id", "reason")


@query()
def finished_record_errors(spark: SparkSession, d: str) -> DataFrame:
    flags = _candidates(spark, d).select("row_id", mcq_plan.record_errors().all_flags().alias("errors"))
    return flags.select("row_id", F.array_join("errors", "+").alias("errors"))


@query("select json_valid(coalesce(raw_response, '')) and raw_response is not null as ok, model, count(*) as rows from generation_output group by 1, 2")
def response_is_json(spark: SparkSession, d: str) -> DataFrame:
    return _counts(_t(spark, d, "generation_output").select(is_json(F.col("raw_response")).alias("ok"), "model"), "ok", "model")


# Exams

_EXAM_FIELDS = ("question", "choice_a", "choice_b", "choice_c", "choice_d")


@query(
    "select unnest(['question', 'choice_a', 'choice_b', 'choice_c', 'choice_d', 'answer_letter']) as reason, unnest(["
    + ", ".join(f"count(*) filter (where {q.blank(c)})" for c in _EXAM_FIELDS)
    + ", count(*) filter (where not coalesce(answer_letter in ('A', 'B', 'C', 'D'), false))]) as rows from exams_mcq_seed"
)
def exam_failures(spark: SparkSession, d: str) -> DataFrame:
    return mcq_plan.exam_rules().failures(_t(spark, d, "exams_mcq_seed"))


@query(
    f"""with d as (select *, min(row_id) over (partition by {", ".join(_EXAM_FIELDS)}, answer_letter) as first from exams_mcq_seed)
select row_id, case when row_id <> first then 'duplicate' end as reason from d"""
)
def exam_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "exams_mcq_seed").select("row_id", *_EXAM_FIELDS, "answer_letter")
    return dedup.keep_first(rows, [*_EXAM_FIELDS, "answer_letter"], "row_id").rows.select("row_id", "reason")


@query(
    f"""with k as (select row_id, {q.hash_form("question")} as q from exams_mcq_seed where question is not null),
c as (select *, count(*) over (partition by q) as copies, row_number() over (partition by q order by row_id) - 1 as rank from k)
select row_id, copies, rank from c where copies > 1"""
)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "exams_mcq_seed").filter("question is not null").select("row_id", text.hash_form("question").alias("q"))
    return dedup.duplicate_groups(rows, "q", "row_id").select("row_id", "copies", F.col("rank").cast("bigint").alias("rank"))


@query(
    """select metadata.split as split, case when regexp_full_match(trim(metadata.grade), '[+-]?\\d+') and try_cast(trim(metadata.grade) as int) between 1 and 6 then 'easy'
when regexp_full_match(trim(metadata.grade), '[+-]?\\d+') and try_cast(trim(metadata.grade) as int) between 10 and 12 then 'hard' else 'medium' end as difficulty, count(*) as rows from exams_mcq_seed group by 1, 2"""
)
def exam_difficulty(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "exams_mcq_seed").select(F.col("metadata.split").alias("split"), text.grade_difficulty(F.col("metadata.grade")).alias("difficulty"))
    return _counts(rows, "split", "difficulty")


_EXAM = ", ".join(f"{q.clean_choice(c)} as {c}" for c in _EXAM_FIELDS[1:])


@query(
    f"""with c as (select row_id, {q.clean_question("question")} as question, {_EXAM}, answer_letter, {q.difficulty("metadata.grade")} as difficulty from exams_mcq_seed),
g as (select *, row_number() over (partition by question, choice_a, choice_b, choice_c, choice_d, answer_letter order by row_id) as rn from c
 where not ({" or ".join(q.blank(c) for c in _EXAM_FIELDS)}) and coalesce(answer_letter in ('A', 'B', 'C', 'D'), false))
select row_id, difficulty, sha1('Câu hỏi: ' || question || chr(10) || 'A. ' || choice_a || chr(10) || 'B. ' || choice_b || chr(10) || 'C. ' || choice_c || chr(10) || 'D. ' || choice_d) as prompt_key from g where rn = 1"""
)
def exam_records(spark: SparkSession, d: str) -> DataFrame:
    kept = mcq_plan.exams(_t(spark, d, "exams_mcq_seed").withColumn("grade", F.col("metadata.grade")).withColumn("subject", F.col("metadata.subject")), "row_id").kept
    records = mcq_plan.exam_records(mcq_plan.without_labels(kept))
    return records.select("row_id", "difficulty", F.sha1(F.get("messages", F.lit(0))["content"]).alias("prompt_key"))


# Leakage

def _side(table: str, id_: str, choices: list[str]) -> str:
    form = q.question_form("question")
    forms = ", ".join(q.choice_form(c) for c in choices)
    whole = " and ".join(f"coalesce({q.choice_form(c)}, '') <> ''" for c in choices)
    ws = f"list_filter(regexp_split_to_array({form}, ' '), lambda w: w <> '')"
    return f"(select {id_} as id, nullif({form}, '') as qn, list_distinct({ws}) as tokens, nullif(array_to_string(list_sort({ws}), ' '), '') as sorted, case when {whole} then [{forms}] end as ch from {table})"


_C = _side("exams_mcq_seed", "row_id", [f"choice_{x}" for x in "abcd"])
_B = _side("benchmark_items", "item_id", [f"choices['{x}']" for x in "ABCD"])


def _leak_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    a = _t(spark, d, "exams_mcq_seed").select(F.col("row_id").alias("id"), "question", F.array(*(F.col(f"choice_{x}") for x in "abcd")).alias("choices"), none.alias("context"), none.alias("answer_text"))
    b = _t(spark, d, "benchmark_items").select(F.col("item_id").alias("id"), "question", F.array(*(F.try_element_at("choices", F.lit(x)) for x in "ABCD")).alias("choices"), none.alias("context"), none.alias("answer_text"))
    return a, b


@query(
    f"""with c as {_C}, b as {_B},
toks as (select c.id, b.id as bid, count(*) as n from (select id, unnest(tokens) as t from c) c join (select id, unnest(tokens) as t from b) b on b.t = c.t group by 1, 2),
m as (
 select c.id, b.id as bid, 0 as rule from c join b on b.qn = c.qn
 union all select c.id, b.id, 1 from c join b on b.sorted = c.sorted
 union all select c.id, b.id, 2 from c join b on b.ch = c.ch
 union all select t.id, t.bid, 1 from toks t join c on c.id = t.id join b on b.id = t.bid where t.n >= 0.8 * (len(c.tokens) + len(b.tokens) - t.n)
), f as (select id, min((bid, rule)) as best from m group by 1)
select c.id, ['exact_question_match', 'near_duplicate_question', 'same_choices_pattern'][best[2] + 1] as reason, best[1] as benchmark_id from c left join f on f.id = c.id"""
)
def leak_first_reason(spark: SparkSession, d: str) -> DataFrame:
    """Without sequence ratios, which SQL can't express; leak_with_ratios has them."""
    return leakage.first_leak(*_leak_sides(spark, d), ratio=False)


@query()
def leak_with_ratios(spark: SparkSession, d: str) -> DataFrame:
    return leakage.first_leak(*_leak_sides(spark, d))


def _context_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training records as candidates, those held out as the benchmark."""
    t = _t(spark, d, "comprehension_seed_raw")
    rows = t.select(F.col("row_id").alias("id"), "question", F.lit(None).cast("array<string>").alias("choices"), "context", "answer_text", F.coalesce(F.col("metadata.source_split"), F.lit("")).alias("split"))
    return rows.filter("split = 'train'").drop("split"), rows.filter("split <> 'train'").drop("split")


_W3, _W2, _C5 = q.word_grams("w", 3), q.word_grams("w", 2), q.char_grams("ctx", 5)


def _near_contexts(column: str, t: float) -> str:
    """Pairs of texts with similar sets in a column."""
    return f"""select c.ctx as c, b.ctx as b from (select x.ctx, y.ctx as other, count(*) as n from (select ctx, unnest({column}) as g from ct) x join (select ctx, unnest({column}) as g from bt) y on x.g = y.g group by 1, 2) m
 join ct c on c.ctx = m.ctx join bt b on b.ctx = m.other where m.n >= {t} * (len(c.{column}) + len(b.{column}) - m.n)"""


_R = f"""r as (select row_id as id, coalesce(metadata.source_split, '') = 'train' as is_train, nullif({q.question_form("question")}, '') as qn, nullif({q.hash_form("context")}, '') as ctx, nullif({q.hash_form("answer_text")}, '') as fact from comprehension_seed_raw),
p as (select *, string_split(qn, ' ') as ws, list_distinct(string_split(qn, ' ')) as tokens, array_to_string(list_sort(string_split(qn, ' ')), ' ') as sorted from r),
qs as (select qn, any_value(tokens) as tokens from p where qn is not null and is_train group by 1), qb as (select qn, any_value(tokens) as tokens from p where qn is not null and not is_train group by 1),
qt as (select x.qn, y.qn as other, count(*) as n from (select qn, unnest(tokens) as t from qs) x join (select qn, unnest(tokens) as t from qb) y on x.t = y.t group by 1, 2),
w as (select ctx, is_train, string_split(ctx, ' ') as w from (select distinct ctx, is_train from p where ctx is not null)),
t as (select ctx, is_train, case when len(w) >= 3 then {_W3} when len(w) = 2 then {_W2} else [] end as grams, case when length(ctx) >= 5 then {_C5} else [] end as chars from w),
ct as (select * from t where is_train), bt as (select * from t where not is_train),
near as (select ct.ctx as c, bt.ctx as b from ct join bt on contains(ct.ctx, bt.ctx) or contains(bt.ctx, ct.ctx) union {_near_contexts("grams", 0.5)} union {_near_contexts("chars", 0.45)}),
c as (select * from p where is_train), b as (select * from p where not is_train),
m as (select c.id, b.id as bid, 0 as rule from c join b on b.qn = c.qn union all select c.id, b.id, 1 from c join b on b.sorted = c.sorted
 union all select c.id, b.id, 1 from qt join c on c.qn = qt.qn join b on b.qn = qt.other where qt.n >= 0.8 * (len(c.tokens) + len(b.tokens) - qt.n)
 union all select c.id, b.id, 3 from near join c on c.ctx = near.c join b on b.ctx = near.b union all select c.id, b.id, 4 from c join b on b.fact = c.fact),
f as (select id, min((bid, rule)) as best from m group by 1)"""


@query(f"with {_R} select c.id, [{', '.join(q.lit(r) for r in leakage.RULES)}][best[2] + 1] as reason, best[1] as benchmark_id from c left join f on f.id = c.id")
def leak_context_overlap(spark: SparkSession, d: str) -> DataFrame:
    """All rules on records with contexts and answers, but for the sequence ratios."""
    return leakage.first_leak(*_context_sides(spark, d), facts="text", ratio=False)


@query()
def leak_context_reason(spark: SparkSession, d: str) -> DataFrame:
    """All rules, the sequence ratios of questions and contexts included."""
    return leakage.first_leak(*_context_sides(spark, d), facts="text")


@query(
    f"""with w as (select row_id, coalesce(metadata.split, '') = 'train' as is_train, {q.words("lower(question)")} as w from exams_mcq_seed),
k as (select array_to_string(w, ' ') as k, any_value(w) as w, min(row_id) filter (where not is_train) as l, min(row_id) filter (where is_train) as r, count(*) filter (where not is_train) as nl, count(*) filter (where is_train) as nr from w where len(w) > 0 group by 1),
g as (select *, case when len(w) < 5 then [k] else {q.word_grams("w", 5)} end as grams from k),
p as (select a.k as a, b.k as b, count(*) as n from (select k, unnest(grams) as x from g where nl > 0) a join (select k, unnest(grams) as x from g where nr > 0) b on b.x = a.x group by 1, 2)
select a.l as "left", b.r as "right", a.nl as left_rows, b.nr as right_rows from p join g a on a.k = p.a join g b on b.k = p.b where p.n >= 0.8 * (len(a.grams) + len(b.grams) - p.n)"""
)
def similar_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of all rows that aren't training rows, against those that are: pairs of classes of equal wording.

    left and right are the first rows of a class on either side, left_rows and right_rows
    how many it has. Shingles have five words; a shorter question is one shingle.
    """
    rows = _t(spark, d, "exams_mcq_seed").select("row_id", (F.coalesce("metadata.split", F.lit("")) == "train").alias("is_train"), text.words(F.lower("question")).alias("w")).filter("size(w) > 0")
    side = lambda f, train: f(F.when(F.col("is_train") == train, F.col("row_id")))
    classes = rows.groupBy("w").agg(F.min("row_id").alias("u"), side(F.min, False).alias("left"), side(F.min, True).alias("right"), side(F.count, False).alias("left_rows"), side(F.count, True).alias("right_rows"))
    five = text.ngram_hashes(F.col("w"), 5)
    units = classes.select("u", "left", "right", "left_rows", "right_rows", (F.col("left_rows") > 0).alias("is_left"), (F.col("right_rows") > 0).alias("is_right"), F.when(F.size("w") < 5, F.array(F.xxhash64("w"))).otherwise(five).alias("grams"))
    units = materialize(units, "questions")
    pairs = similar_sets(units, 0.8, ready=True).unionByName(units.filter("is_left and is_right").select(F.col("u").alias("left"), F.col("u").alias("right")))
    a, b = units.select(F.col("u").alias("_a"), F.col("left").alias("_l"), "left_rows"), units.select(F.col("u").alias("_b"), F.col("right").alias("_r"), "right_rows")
    return pairs.join(a, F.col("left") == F.col("_a")).join(b, F.col("right") == F.col("_b")).select(F.col("_l").alias("left"), F.col("_r").alias("right"), "left_rows", "right_rows")


# Encyclopedia questions

_PIECE = "substring(list_filter(p[2:], lambda x: x[1] = '{0}')[-1], 2)"
_PARTS = f"""mk as (select row_id, metadata.subject as subject, metadata.answer as answer, metadata.dedup_hash as stored, string_split(regexp_replace(regexp_replace(messages[1].content, '{q.BREAK}', chr(10), 'g'), '(?m)^[\\s\\x0B]*([ABCD])\\.', chr(1) || '\\1', 'g'), chr(1)) as p from wiki_mcq_seed),
cut as (select row_id, subject, answer, stored, p[1] as head, {", ".join(f"{_PIECE.format(x)} as {x.lower()}0" for x in "ABCD")} from mk),
parts as (select row_id, subject, answer, stored, coalesce(length(a0 || b0 || c0 || d0) >= 0, false) as parsed, {q.clean("regexp_replace(" + q.strip("head") + f", '^Câu hỏi:{q.WS}*', '')")} as question, {", ".join(f"{q.clean(x.lower() + '0')} as {x}" for x in "ABCD")} from cut)"""


def _wiki_parts(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "wiki_mcq_seed")
    return t.select("row_id", F.col("metadata.subject").alias("subject"), F.col("metadata.answer").alias("answer"), F.col("metadata.dedup_hash").alias("stored"), mcq.parse_wrapped(F.get("messages", F.lit(0))["content"]).alias("p")).select("row_id", "subject", "answer", "stored", F.col("p").isNotNull().alias("parsed"), "p.*")


@query(f"with {_PARTS} select row_id, parsed, {', '.join(f'case when parsed then {x} end as {x}' for x in ('question', *'ABCD'))} from parts")
def wiki_prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    """Question and choices of each prompt; parsed is false, and they are null, where a label is missing."""
    return _wiki_parts(spark, d).select("row_id", "parsed", "question", *"ABCD")


_QUOTED = lambda x: f"chr(34) || replace(replace({x}, '\\', '\\\\'), chr(34), '\\' || chr(34)) || chr(34)"


@query(
    f"""with {_PARTS}, k as (select row_id, stored, md5('{{"choices": [' || {" || ', ' || ".join(_QUOTED(x) for x in "ABCD")} || '], "question": ' || {_QUOTED("question")} || '}}') as own from parts where parsed)
select row_id, own, own = lower(stored) as same from k"""
)
def wiki_content_keys(spark: SparkSession, d: str) -> DataFrame:
    """Whether the stored hash is the one of question and choices; null where none is stored."""
    own = keys.choices_key(F.col("question"), [F.col(x) for x in "ABCD"])
    return _wiki_parts(spark, d).filter("parsed").select("row_id", own.alias("own"), F.lower("stored").alias("stored")).select("row_id", "own", (F.col("own") == F.col("stored")).alias("same"))


_BIAS = f"""{_PARTS}, n as (select subject, {q.answer_letter("answer")} as answer, length(A) as a, length(B) as b, length(C) as c, length(D) as d from parts where parsed),
f as (select subject, case answer when 'A' then a when 'B' then b when 'C' then c when 'D' then d end as "right", a + b + c + d as total, answer, case greatest(a, b, c, d) when a then 'A' when b then 'B' when c then 'C' else 'D' end as longest from n where answer is not null),
g as (select subject, "right", (total - "right") / 3 as wrong, "right" - (total - "right") / 3 as gap, longest = answer as longest_is_right from f)"""


def _length_frame(spark: SparkSession, d: str) -> DataFrame:
    n = {x: F.length(x) for x in "ABCD"}
    p = _wiki_parts(spark, d).filter("parsed").withColumn("answer", text.answer_letter(F.col("answer"))).filter("answer is not null")
    right = F.coalesce(*(F.when(F.col("answer") == x, c) for x, c in n.items()))
    wrong = (n["A"] + n["B"] + n["C"] + n["D"] - right) / 3
    return p.select("subject", right.alias("right"), wrong.alias("wrong"), (right - wrong).alias("gap"), (stats.longest_label(n) == F.col("answer")).alias("longest_is_right"))


@query(
    f"""with {_BIAS} select subject, count(*) as rows, round(avg("right"), 3) as mean_right, round(avg(wrong), 3) as mean_wrong, round(avg(gap), 3) + 0.0 as mean_gap, round(avg(longest_is_right::int) * 100, 2) as longest_percent from g group by 1"""
)
def length_bias_by_subject(spark: SparkSession, d: str) -> DataFrame:
    f = _length_frame(spark, d)
    return f.groupBy("subject").agg(F.count("*").alias("rows"), F.round(F.avg("right"), 3).alias("mean_right"), F.round(F.avg("wrong"), 3).alias("mean_wrong"), F.round(F.avg("gap"), 3).alias("mean_gap"), F.round(F.avg(F.col("longest_is_right").cast("int")) * 100, 2).alias("longest_percent"))


@query(f"with {_BIAS} select subject, count(*) as suspects from g where longest_is_right and gap >= 5 group by 1")
def length_bias_suspects(spark: SparkSession, d: str) -> DataFrame:
    return _length_frame(spark, d).filter("longest_is_right and gap >= 5").groupBy("subject").agg(F.count("*").alias("suspects"))


_TOKENS = f"list_filter(regexp_extract_all({q.clean('lower(question)')}, '[0-9a-zA-ZÀ-ỹ]+'), lambda t: length(t) > 1 and t not in ({q.STOP}))"


@query(
    f"""with t as (select {_TOKENS} as w from exams_mcq_seed where question is not null),
g as (select unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as ngram from t where len(w) >= 2)
select ngram, count(*) as rows from g group by 1"""
)
def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.ngram_counts(_t(spark, d, "exams_mcq_seed").filter("question is not null"), text.content_words("question"), 2)


@query(
    f"""with t as (select {_TOKENS} as w from exams_mcq_seed where question is not null),
g as (select unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as ngram from t where len(w) >= 3)
select ngram, count(*) as rows from g group by 1 order by rows desc, ngram limit 50"""
)
def top_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent (a top-k report)."""
    return stats.ngram_counts(_t(spark, d, "exams_mcq_seed").filter("question is not null"), text.content_words("question"), 3).orderBy(F.desc("rows"), "ngram").limit(50)


@query(
    f"""with t as (select unnest({_TOKENS}) as w from exams_mcq_seed where question is not null)
select count(*) as total_tokens, count(distinct w) as unique_tokens, round(count(distinct w) / count(*), 4) as ratio from t"""
)
def lexical_diversity(spark: SparkSession, d: str) -> DataFrame:
    return stats.lexical_diversity(_t(spark, d, "exams_mcq_seed").filter("question is not null"), text.content_words("question"))


@query(
    "select unnest([" + ", ".join(q.lit(k) for k in text.TEMPLATES) + "]) as template, unnest(["
    + ", ".join(f"count(*) filter (where regexp_matches(lower(question), {q.lit(p)}))" for p in text.TEMPLATES.values()) + "]) as rows, unnest(["
    + ", ".join(f"round(100.0 * count(*) filter (where regexp_matches(lower(question), {q.lit(p)})) / count(*), 2)" for p in text.TEMPLATES.values()) + "]) as percent from exams_mcq_seed"
)
def template_rates(spark: SparkSession, d: str) -> DataFrame:
    return stats.template_rates(_t(spark, d, "exams_mcq_seed"), F.col("question"))


@query("select metadata.subject as subject, count(*) as rows from exams_mcq_seed group by 1")
def subject_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(_t(spark, d, "exams_mcq_seed"), F.col("metadata.subject"), "subject")


@query(
    """select metadata.subject as subject, count(*) as before, count(*) filter (where answer_letter = 'A') as after, count(*) - count(*) filter (where answer_letter = 'A') as dropped,
round(100.0 * (count(*) - count(*) filter (where answer_letter = 'A')) / count(*), 2) as dropped_percent from exams_mcq_seed group by 1"""
)
def before_after(spark: SparkSession, d: str) -> DataFrame:
    return stats.before_after(_t(spark, d, "exams_mcq_seed"), F.col("metadata.subject"), F.col("answer_letter") == "A")


@query(
    """with n as (select list_sort(list(n_chars)) as v from documents where n_chars is not null)
select v[cast(floor(len(v) * 0.5) as int) + 1] as p50, v[cast(floor(len(v) * 0.9) as int) + 1] as p90, v[cast(floor(len(v) * 0.99) as int) + 1] as p99, v[len(v)] as max_value from n"""
)
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_percentiles(_t(spark, d, "documents"), F.col("n_chars"))


@query("select count(*) as rows, count(distinct id) as distinct_keys, count(*) - count(distinct id) as surplus from documents")
def id_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return dedup.uniqueness(_t(spark, d, "documents"), "id")


def _whitelist(spark: SparkSession, d: str) -> list[str]:
    """Subjects of the target table, which is of fixed size."""
    return [r[0] for r in _t(spark, d, "sample_targets").filter("target_field = 'subject'").select("category").collect()]


_LINE = "list_filter(l, lambda x: regexp_extract(x, '([ABCD])', 1) = '{0}')[-1]"
_CLEANUP = f"""w as (select row_id, metadata.subject as subject, {q.user()} as u, {q.assistant()} as a from wiki_mcq_seed),
l as (select *, list_filter(string_split(u, chr(10)), lambda x: regexp_matches(x, '^[^\\S\\n]*[ABCD]\\.')) as l from w),
c as (select *, [{", ".join("lower(" + q.clean("regexp_replace(" + _LINE.format(x) + r", '^\s*[ABCD]\.', '')") + ")" for x in "ABCD")}] as four, {" and ".join(_LINE.format(x) + " is not null" for x in "ABCD")} as whole from l),
f as (select row_id, list_sort(list_filter([case when coalesce(subject not in (select category from sample_targets where target_field = 'subject'), true) then 'subject_not_in_wiki_mcq_whitelist' end,
 case when coalesce(not whole or len(list_distinct(four)) < 4, true) then 'duplicate_choices_or_invalid_choice_format' end,
 case when not regexp_full_match(coalesce({q.strip("a")}, ''), 'Đáp án:{q.WS}*[ABCD]') then 'invalid_assistant_answer_format' end,
 case when {" or ".join(f"coalesce(regexp_matches(u, '(?i){p}'), false)" for p in text.ENGLISH_LEFT)} then 'hard_english_artifact' end], lambda x: x is not null)) as flags from c)"""


@query(f"with {_CLEANUP} select array_to_string(flags, ' + ') as flags, count(*) as rows from f group by 1")
def cleanup_flag_sets(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "wiki_mcq_seed")
    flags = mcq_plan.cleanup_flags(mcq.message(F.col("messages"), "user"), mcq.message(F.col("messages"), "assistant"), F.col("metadata.subject"), _whitelist(spark, d))
    return _counts(t.select(F.array_join(F.array_sort(flags), " + ").alias("flags")), "flags")


@query(f"with {_CLEANUP} select row_id, case when len(flags) = 0 then 'keep' else 'drop' end as qc_action, array_to_string(flags, ' + ') as flags from f")
def cleanup_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = mcq_plan.cleanup(_t(spark, d, "wiki_mcq_seed"), _whitelist(spark, d)).rows
    return rows.select("row_id", "qc_action", F.array_join(F.array_sort("qc_flags"), " + ").alias("flags"))


@query(
    """select s as subject, s in (select category from sample_targets) as wanted from (select distinct metadata.subject as s from wiki_mcq_seed where metadata.subject is not null)"""
)
def whitelist_subjects(spark: SparkSession, d: str) -> DataFrame:
    have = _t(spark, d, "wiki_mcq_seed").select(F.col("metadata.subject").alias("subject")).filter("subject is not null")
    want = _t(spark, d, "sample_targets").select(F.col("category").alias("subject"))
    return have.intersect(want).withColumn("wanted", F.lit(True)).unionByName(have.subtract(want).withColumn("wanted", F.lit(False)))


@query(
    """select w.row_id, exists (select 1 from sample_targets t where t.category = w.metadata.subject and t.target_permille >= 80) as listed from wiki_mcq_seed w"""
)
def worklist_membership(spark: SparkSession, d: str) -> DataFrame:
    listed = _t(spark, d, "sample_targets").filter("target_permille >= 80").select(F.col("category").alias("subject")).distinct()
    rows = _t(spark, d, "wiki_mcq_seed").select("row_id", F.col("metadata.subject").alias("subject"))
    marked = rows.join(listed, "subject", "left_semi").withColumn("listed", F.lit(True))
    return marked.unionByName(rows.join(listed, "subject", "left_anti").withColumn("listed", F.lit(False))).select("row_id", "listed")


_MATH = r"""t as (select row_id, messages[1].content as t from wiki_mcq_seed),
s as (select row_id, t, string_split(regexp_replace(t, '\$(\s?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\s?\d+\.\d{2})', chr(1) || '\1', 'g'), '$') as s from t),
h as (select row_id, t, len(s) % 2 = 0 as odd, array_to_string(list_transform(s, lambda x, i: case when i % 2 = 1 then x else replace(replace(replace(x, '\frac', chr(2)), '\sqrt', chr(2)), '^', chr(2)) end), '$') as h from s),
f as (select row_id, t, list_sort(list_filter([case when odd then 'unbalanced_math_dollar' end, case when regexp_matches(h, '\\frac\{[^{}\n]+\}\{[^{}\n]+\}') then 'raw_latex_frac' end, case when regexp_matches(h, '\\sqrt\{[^{}\n]+\}') then 'raw_latex_sqrt' end,
 case when regexp_matches(h, '(?:^|[^\pL\pN_$\x01])(?:[0-9]+|[a-zA-Z])\^(?:\{[^{}\n]+\}|[0-9]+)(?:$|[^\pL\pN_$\x01])') then 'raw_caret_power' end,
 case when contains(t, '\n') then 'literal_backslash_n' end, case when regexp_matches(t, '&[a-zA-Z]+;') then 'html_entity' end], lambda x: x is not null)) as flags from h)"""


@query(f"with {_MATH} select row_id, coalesce(array_to_string(flags, ','), '') as flags from f")
def formula_flags(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "wiki_mcq_seed").select("row_id", math_flags(F.get("messages", F.lit(0))["content"]).alias("flags"))
    return t.select("row_id", F.array_join("flags", ",").alias("flags"))


def _flagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(_t(spark, d, "wiki_mcq_seed").select("row_id", F.get("messages", F.lit(0))["content"].alias("text")), "prompts")
    return rows, rows.filter(F.size(math_flags(F.col("text"))) > 0).select("row_id")


@query()
def formula_triage(spark: SparkSession, d: str) -> DataFrame:
    rows, flagged = _flagged(spark, d)
    return mcq_plan.math_triage(rows, flagged, "row_id", "text").select("row_id", "action")


@query()
def formula_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the flagged prompts by rule alone."""
    rows, flagged = _flagged(spark, d)
    none = spark.createDataFrame([], "row_id bigint, fixed string, failed boolean")
    return mcq_plan.repair_log(rows, flagged, none, "row_id", "text").select("row_id", "status", "reason", F.array_join("after_flags", ",").alias("flags"))


_NAIVE = ", ".join(f"case when {f'regexp_matches(t, {q.lit(p)})' if k != 'unbalanced_dollar' else 'len(string_split(t, chr(36))) % 2 = 0'} then {q.lit(k)} end" for k, p in mcq_plan.SUSPICIOUS.items())


@query(
    f"""with {_PARTS}, t as (select row_id, question || chr(10) || A || chr(10) || B || chr(10) || C || chr(10) || D as t from parts where parsed),
f as (select row_id, list_filter([{_NAIVE}], lambda x: x is not null) as flags from t) select row_id, array_to_string(flags, ',') as flags from f where len(flags) > 0"""
)
def format_issues(spark: SparkSession, d: str) -> DataFrame:
    """Suspicious formats of prompts of all subjects."""
    t = _t(spark, d, "wiki_mcq_seed").select("row_id", mcq_plan.format_flags(F.get("messages", F.lit(0))["content"]).alias("flags"))
    return t.filter(F.size("flags") > 0).select("row_id", F.array_join("flags", ",").alias("flags"))


# Instructions and dialogues


_TEXT = lambda c: q.without_markers(q.strip_lines(f"nfc_normalize({c})"))
_LETTER = f"regexp_matches(a, '(?i)^{q.WS}*(Đáp án|Answer|Kết quả){q.WS}*:?{q.WS}*[A-D]{q.WS}*$')"
_LISTED = "regexp_matches(u, '" + r"\n".join([rf"[A-D]\.{q.WS}+.*?"] * 3) + rf"\n[A-D]\.{q.WS}+')"
_BARE = f"length(a) < 20 and regexp_matches(a, '(?i)^{q.WS}*[A-D]\\.?{q.WS}*$')"


@query(
    f"""with t as (select _row_index, {_TEXT("instruction")} as i, {_TEXT("input")} as n, {_TEXT("output")} as a from instruction_rows),
x as (select _row_index, case when n <> '' then i || chr(10) || chr(10) || n else i end as u, a from t),
r as (select *, case when length(u) < 10 then 'user_too_short' when length(u) > 2000 then 'user_too_long' when length(a) < 10 then 'assistant_too_short' when length(a) > 4000 then 'assistant_too_long'
 when {_LETTER} or ({_LISTED} and {_BARE}) then 'mcq_like_contamination' end as reason, {q.hash_form("u")} || '|' || {q.hash_form("a")} as k from x),
f as (select k, min(_row_index) as first from r where reason is null group by 1)
select r._row_index, case when r.reason is not null then r.reason when f.first <> r._row_index then 'duplicate' end as reason from r left join f on f.k = r.k"""
)
def instruction_reasons(spark: SparkSession, d: str) -> DataFrame:
    return instruction.single_turns(_t(spark, d, "instruction_rows")).rows.select("_row_index", "reason")


@query("select row_id, messages[1].content as \"user\", messages[2].content as assistant from comprehension_seed_raw where messages[1].role = 'user' and messages[2].role = 'assistant'")
def first_exchanges(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "comprehension_seed_raw").select("row_id", mcq.first_exchange(F.col("messages")).alias("p"))
    return t.filter("p is not null").select("row_id", "p.user", "p.assistant")


@query(
    f"""select count(*) as rows, count(*) filter (where instruction is null or instruction = '') as no_instruction,
count(*) filter (where regexp_matches(coalesce(output, ''), '(?i)(Human|Assistant|Instruction|Response|Input|Output)\\s*:')) as with_markers from instruction_rows"""
)
def instruction_markers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "instruction_rows").agg(F.count("*").alias("rows"), F.count_if(F.col("instruction").isNull() | (F.col("instruction") == "")).alias("no_instruction"), F.count_if(F.coalesce(text.has_markers("output"), F.lit(False))).alias("with_markers"))


# Splits and samples

_BUCKETS = f"""
docs as (select row_id, 'exams_mcq' as task, sha256('[user]:' || coalesce(question, '') || '|') as k, '000/' || lpad(row_id::varchar, 20, '0') as pos from exams_mcq_seed
 union all select row_id, coalesce(metadata.task, 'unknown'), sha256(array_to_string(list_transform(messages, lambda m: '[' || coalesce(m.role, '') || ']:' || coalesce(m.content, '') || '|'), '')), '001/' || lpad(row_id::varchar, 20, '0') from wiki_mcq_seed
 union all select row_id, coalesce(metadata.task, 'unknown'), sha256(array_to_string(list_transform(messages, lambda m: '[' || coalesce(m.role, '') || ']:' || coalesce(m.content, '') || '|'), '')), '002/' || lpad(row_id::varchar, 20, '0') from comprehension_seed_raw),
u as (select *, row_number() over (partition by k order by pos) as rn from docs),
g as (select *, case when rn > 1 then 'duplicate' when task not in ('exams_mcq', 'wiki_mcq', 'comprehension_short_answer', 'instruction_retention', 'cloze_lm_retention') then 'unknown_task' end as reason from u),
o as (select *, row_number() over (partition by task order by sha1('42/' || k)) as rk, count(*) over (partition by task) as n from g where reason is null)"""


def _buckets(spark: SparkSession, d: str) -> list[DataFrame]:
    e = _t(spark, d, "exams_mcq_seed").select(F.col("row_id").alias("pos"), F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("messages"), F.struct(F.lit("exams_mcq").alias("task")).alias("metadata"))
    others = [_t(spark, d, n).select(F.col("row_id").alias("pos"), "messages", F.struct(F.col("metadata.task").alias("task")).alias("metadata")) for n in ("wiki_mcq_seed", "comprehension_seed_raw")]
    return [e, *others]


@query(
    f"""with {_BUCKETS}
select task, case when rk <= floor(n * 0.9::double) then 'train' when rk <= floor(n * 0.9::double) + floor(n * 0.05::double) then 'val' else 'shadow' end as split, null as reason, count(*) as rows from o group by 1, 2
union all select task, null, reason, count(*) from g where reason is not null group by 1, 3"""
)
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return training_split.manifest(training_split.split(training_split.together(_buckets(spark, d))))


@query(
    f"""with {_BUCKETS} select k as key, case when rk <= floor(n * 0.9::double) then 'train' when rk <= floor(n * 0.9::double) + floor(n * 0.05::double) then 'val' else 'shadow' end as split from o"""
)
def split_members(spark: SparkSession, d: str) -> DataFrame:
    return training_split.split(training_split.together(_buckets(spark, d))).kept.select("key", "split")


@query("select row_id from exams_mcq_seed order by sha1('42/' || row_id::varchar) limit 200")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """200 rows (a sampling operator)."""
    return split.sample_by_key(_t(spark, d, "exams_mcq_seed").select("row_id"), F.sha1(F.concat(F.lit("42/"), F.col("row_id").cast("string"))), 200)


# Scoring and updates


@query(
    """select case when s is null then 'invalid_empty' when regexp_matches(s, '^Đáp án:\\s*[ABCD]$') then 'ok_strict' else 'other' end as status,
coalesce(regexp_extract(s, '([ABCD])$', 1) = regexp_extract(upper(metadata.answer), '([ABCD])', 1) and metadata.answer is not null, false) as correct, count(*) as rows
from (select trim(messages[2].content) as s, metadata from wiki_mcq_seed) group by 1, 2"""
)
def prediction_scores(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "wiki_mcq_seed").select(F.get("messages", F.lit(1))["content"].alias("s"), F.col("metadata.answer").alias("answer"))
    return _counts(t.select(scoring.parsed(F.col("s"))["status"].alias("status"), scoring.is_correct(F.col("s"), F.col("answer")).alias("correct")), "status", "correct")


@query(
    """with l as (select source_id, arg_max(model, (coalesce(created_at, timestamp '1970-01-01'), coalesce(request_id, ''), coalesce(model, ''), coalesce(raw_response, ''))) as model from generation_output group by 1)
select c.row_id, coalesce(l.model, c.metadata.source_dataset) as origin from comprehension_seed_raw c left join l on l.source_id = c.metadata.source_id"""
)
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    gen = _t(spark, d, "generation_output").withColumn("p", F.struct(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("request_id", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce("raw_response", F.lit(""))))
    last = lookup.last_by_key(gen.select("source_id", "p", "model"), "source_id", "p").select("source_id", F.col("model").alias("value"))
    rows = _t(spark, d, "comprehension_seed_raw").select("row_id", F.col("metadata.source_id").alias("source_id"), F.col("metadata.source_dataset").alias("origin"))
    return lookup.update(rows, last, "source_id", "origin").select("row_id", "origin")


@query("select cast(floor((_row_index - 1) / 2) as bigint) as batch, count(*) as size, min(_row_index) as first from instruction_rows group by 1")
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "instruction_rows").select((F.col("_row_index") - 1).alias("pos"), "_row_index", "instruction")
    b = lookup.batches(rows, "pos", 2)
    return b.select("batch", F.size("rows").cast("bigint").alias("size"), F.get("rows", F.lit(0))["_row_index"].alias("first"))


@query(
    f"""select count(*) as rows, count(*) filter (where coalesce(len(messages) <> 2, true) or {q.blank(q.user())} or {q.blank(q.assistant())} or {q.blank("metadata.source_dataset")} or {q.blank("metadata.dedup_hash")} or metadata.task is distinct from 'wiki_mcq') as invalid,
count(metadata.dedup_hash) - count(distinct metadata.dedup_hash) as repeated_keys from wiki_mcq_seed"""
)
def recheck_wiki(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "wiki_mcq_seed")
    return recheck.summary(rows, recheck.chat_errors("wiki_mcq", "source_dataset", "dedup_hash"), F.col("metadata.dedup_hash")).select("rows", "invalid", "repeated_keys")
