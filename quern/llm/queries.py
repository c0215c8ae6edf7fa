"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import copies, crossplit, leaks, lookalikes, markup, mixing, prose, quotas, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1 Evaluation texts in training text


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))
    return found.select("doc_id", "item_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark_items")
    return leaks.leak_report(leaks.find_leaks(table(spark, sf_dir, "documents"), items), items)


# 2 Records across splits


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "comprehension_seed_raw")
    e = table(spark, sf_dir, "exams_mcq_seed")
    reading = crossplit.context_pairs(c.select("row_id", F.col("metadata.source_split").alias("split"), "question", "context"))
    exams = crossplit.choice_pairs(e.select("row_id", F.col("metadata.split").alias("split"), "question", F.array("choice_a", "choice_b", "choice_c", "choice_d").alias("choices")))
    return reading.select(F.lit("comprehension_seed_raw").alias("source_table"), "*").unionByName(exams.select(F.lit("exams_mcq_seed").alias("source_table"), "*"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _overlaps(spark, sf_dir)
    return pairs.select("source_table", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, split, source_dataset of the evaluation rows: rows, rows that recur in train, pairs."""
    c = table(spark, sf_dir, "comprehension_seed_raw").select(F.lit("comprehension_seed_raw").alias("source_table"), "row_id", F.col("metadata.source_split").alias("split"), F.col("metadata.source_dataset").alias("source_dataset"))
    e = table(spark, sf_dir, "exams_mcq_seed").select(F.lit("exams_mcq_seed").alias("source_table"), "row_id", F.col("metadata.split").alias("split"), F.col("metadata.source_dataset").alias("source_dataset"))
    held = c.unionByName(e).filter(F.col("split").isin(*crossplit.EVAL_SPLITS))
    hits = _overlaps(spark, sf_dir).groupBy("source_table", F.col("id_a").alias("row_id")).agg(F.count("*").alias("partners"))
    return held.join(hits, ["source_table", "row_id"], "left").groupBy("source_table", "split", "source_dataset").agg(F.count("*").alias("eval_rows"), F.count("partners").alias("overlapping_rows"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))


# 3 Markup


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wiki_mcq_seed").select("row_id", F.get("messages", F.lit(0))["content"].alias("content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.convert(_contents(spark, sf_dir), "row_id", "content", clean=False).select("row_id", F.explode("kinds").alias("kind"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.convert(_contents(spark, sf_dir), "row_id", "content").select("row_id", "clean")


# 4 Look-alikes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lookalikes.same_look(table(spark, sf_dir, "comprehension_seed_raw"), "row_id", "context")
    b = lookalikes.same_look(table(spark, sf_dir, "exams_mcq_seed"), "row_id", "question")
    return a.select(F.lit("comprehension_seed_raw").alias("source_table"), "*").unionByName(b.select(F.lit("exams_mcq_seed").alias("source_table"), "*"))


def p4_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lookalikes.one_form(table(spark, sf_dir, "comprehension_seed_raw").select("row_id", "context"), "context", "form")
    b = lookalikes.one_form(table(spark, sf_dir, "exams_mcq_seed").select("row_id", "question"), "question", "form")
    return a.select(F.lit("comprehension_seed_raw").alias("source_table"), "row_id", "form").unionByName(b.select(F.lit("exams_mcq_seed").alias("source_table"), "row_id", "form"))


# 5 Copies


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    wiki = table(spark, sf_dir, "wiki_mcq_seed")
    content = F.get("messages", F.lit(0))["content"]
    w = wiki.select(F.lit("wiki_mcq_seed").alias("source_table"), F.col("row_id").alias("id"), copies.from_chat(content, F.col("metadata.answer")).alias("canonical"))
    exams = table(spark, sf_dir, "exams_mcq_seed")
    e = exams.select(F.lit("exams_mcq_seed").alias("source_table"), F.col("row_id").alias("id"), copies.from_columns(F.col("question"), [F.col(f"choice_{x}") for x in "abcd"], F.col("answer_letter")).alias("canonical"))
    return w.unionByName(e)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _canonical(spark, sf_dir)
    out = []
    for name in ("wiki_mcq_seed", "exams_mcq_seed"):
        _, members = copies.copies_of(rows.filter(F.col("source_table") == name).drop("source_table"))
        out.append(members.select(F.lit(name).alias("source_table"), F.col("first_id").alias("id_a"), F.col("id").alias("id_b")))
    return out[0].unionByName(out[1])


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, row_id, copies: one row per distinct record."""
    rows = _canonical(spark, sf_dir)
    out = []
    for name in ("wiki_mcq_seed", "exams_mcq_seed"):
        groups, _ = copies.copies_of(rows.filter(F.col("source_table") == name).drop("source_table"))
        out.append(groups.select(F.lit(name).alias("source_table"), F.col("first_id").alias("row_id"), "copies"))
    return out[0].unionByName(out[1])


# 6 Sample


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wiki = table(spark, sf_dir, "wiki_mcq_seed").select("row_id", F.col("metadata.subject").alias("subject"), F.col("metadata.answer").alias("answer"))
    return quotas.draw_sample(wiki, table(spark, sf_dir, "sample_targets"), F.col("subject"), F.col("answer"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of the report of the drawn sample."""
    return _drawn(spark, sf_dir)[1].filter("missed = 'rows'").select("target_field", "category")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[0].select("row_id", "subject_category", "answer_category")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[1]


# 7 Tokens


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


# 8 Mixture


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan, _ = mixing.mix(documents, table(spark, sf_dir, "mix_targets"))
    return mixing.mixture(documents, plan)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


# 9 Quality


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = prose.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return q.filter("kind <> 'prose'").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = prose.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return q.select("doc_id", "word_count", "mean_word_length", "symbol_ratio", "ended_lines", "common_share")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit() and callable(f)}
