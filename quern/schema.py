"""The record types every stage reads and writes."""

from __future__ import annotations

MESSAGES = "messages array<struct<role:string,content:string>>"
VARIANTS = "answer_variants array<struct<text:string,answer_start:int>>"

#: Metadata fields that a raw comprehension record must have.
RAW_METADATA = (
    "task source source_dataset source_split source_id answer_start original_answer_start answer_text "
    "answer_variants title language difficulty span_check_mode dedup_hash qc_version"
).split()
#: Metadata fields that a multiple-choice comprehension record must have.
MCQ_METADATA = "task source source_dataset source_split source_id gold_answer_text answer choices mcq_dedup_hash context_hash".split()

CHAT = f"{MESSAGES}, metadata struct<task:string>"
RAW = (
    f"context string, question string, answer_text string, {MESSAGES}, metadata struct<task:string,source:string,source_dataset:string,"
    "source_split:string,source_id:string,answer_start:int,original_answer_start:int,answer_text:string,"
    "answer_variants:array<struct<text:string,answer_start:int>>,title:string,language:string,difficulty:string,"
    "span_check_mode:string,dedup_hash:string,qc_version:string>"
)
#: Task names of a finished corpus by group: three-way split, or train and probe.
GROUP_A = ("exams_mcq", "wiki_mcq", "comprehension_short_answer")
GROUP_B = ("instruction_retention", "cloze_lm_retention")
LABELS = ("A", "B", "C", "D")
