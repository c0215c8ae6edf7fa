"""Mixing sources to target shares of all tokens.

A source gets the rate at which its tokens reach its share. Each record is taken the whole
part of the rate; the fractional part is drawn by the cube method: inclusion probabilities
move along the null space of the constraints (documents and tokens of the source) until
each is 0 or 1, in blocks first and then among the few records each block leaves open. The
landing problem that stays at the end has at most two records per source.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import Encoder, rank_file
from quern.operators.materialize import broadcast_if_small, materialize

#: Records that one step of the flight holds; also how many open records end in one task.
BLOCK = 4096


def flight(tokens: list[int], prob: list[float], seed: int) -> list[float]:
    """Probabilities after the flight: at most two are neither 0 nor 1.

    The sums of the probabilities and of probability times tokens stay as they were, and
    each probability's expectation is its old value.
    """
    rng = random.Random(seed)
    p = list(prob)
    active: list[int] = []
    eps = 1e-9
    for nxt in range(len(p)):
        if eps < p[nxt] < 1 - eps:
            active.append(nxt)
        if len(active) < 3:
            continue
        a, b, c = active
        # in the null space of the rows (1, 1, 1) and (tokens)
        u = (tokens[b] - tokens[c], tokens[c] - tokens[a], tokens[a] - tokens[b])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u):
            p[i] += step * v
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1 - eps:
                p[i] = 1.0
        active = [i for i in active if 0 < p[i] < 1]
    return [0.0 if x < eps else 1.0 if x > 1 - eps else x for x in p]


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of every document; a null text has 0 tokens."""
    path = path or rank_file()

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(path)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "n_tokens": [enc.count(t) for t in part["text"]]})

    return documents.select("doc_id", "source", "text").mapInPandas(scan, "doc_id bigint, source string, n_tokens bigint")


def rates(totals: dict[str, int], weights: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Copies per record of each source: share of the mixture over tokens of the source.

    Without a total, the mixture is as large as the caps let every source that has tokens
    keep its share. With a total, a source that its cap keeps below its share stays at the cap.
    """
    have = {s: w for s, w in weights.items() if totals.get(s) and w > 0}
    whole = sum(have.values())
    if not have:
        return {}
    if total is None:
        total = min(caps[s] * totals[s] * whole / w for s, w in have.items())
    return {s: min(float(caps[s]), total * w / whole / totals[s]) for s, w in have.items()}


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(plan, report): how often each document enters the mixture, and the shares reached.

    documents: doc_id (unique), source, text; targets: source (unique), weight,
    max_repeats; there are as many targets as sources, not as rows. plan: doc_id, source,
    n_tokens, copies of at least 1. report: source, target_share, actual_share, documents,
    tokens, mixed_rows, mixed_tokens, max_repeats, met (within half a percent of all
    tokens). Texts without tokens, and sources without target, weight or documents, are not
    mixed in; targets without documents are reported with share 0. Shares are those of the
    sources that have documents: the others' weight is theirs in proportion.
    """
    spark = documents.sparkSession
    goals = {r["source"]: r for r in targets.collect()}
    counted = materialize(token_counts(documents.filter(F.col("source").isin(list(goals))), path), "token-counts")
    sums = {r["source"]: r for r in counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens")).collect()}
    totals = {s: r["tokens"] for s, r in sums.items()}
    rate = rates(totals, {s: r["weight"] or 0.0 for s, r in goals.items()}, {s: r["max_repeats"] or 0 for s, r in goals.items()}, total)
    rated = spark.createDataFrame([(s, float(v)) for s, v in rate.items()] or [("", 0.0)], "source string, rate double")
    rows = counted.filter("n_tokens > 0").join(F.broadcast(rated), "source").select("doc_id", "source", "n_tokens", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("prob"))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        return part.assign(prob=flight(part["n_tokens"].tolist(), part["prob"].tolist(), seed + int(part["block"].iloc[0])))

    def landed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id").reset_index(drop=True)
        p = flight(part["n_tokens"].tolist(), part["prob"].tolist(), seed)
        rest = [i for i, x in enumerate(p) if 0 < x < 1]
        # landing: of the at most two open records, the choice nearest to the tokens still due
        due = sum(p[i] * part["n_tokens"][i] for i in rest)
        best = min(range(1 << len(rest)), key=lambda k: abs(due - sum(part["n_tokens"][i] for n, i in enumerate(rest) if k >> n & 1)))
        for n, i in enumerate(rest):
            p[i] = float(best >> n & 1)
        return part.assign(prob=p)

    schema = "doc_id bigint, source string, n_tokens bigint, whole bigint, prob double, block bigint"
    blocks = max(1, -(-max((r["documents"] for r in sums.values()), default=0) // BLOCK))
    done: DataFrame | None = None
    open_rows = rows
    while blocks > 1:
        hashed = open_rows.drop("block").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + blocks), "doc_id"), F.lit(blocks)))
        flown = materialize(hashed.groupBy("source", "block").applyInPandas(block, schema), "flight")
        settled = flown.filter("prob in (0, 1)")
        done = settled if done is None else done.unionByName(settled)
        open_rows = flown.filter("prob not in (0, 1)")
        blocks = -(-2 * blocks // BLOCK)  # each block leaves at most two
    last = open_rows.drop("block").withColumn("block", F.lit(0).cast("bigint")).groupBy("source").applyInPandas(landed, schema)
    whole = last if done is None else done.unionByName(last)
    plan = materialize(whole.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("prob").cast("bigint")).alias("copies")).filter("copies > 0"), "mixture")
    got = {r["source"]: r for r in plan.groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    everything = sum(r["t"] for r in got.values()) or 1
    weight = sum(goals[s]["weight"] for s in rate) or 1
    report = []
    for s, g in sorted(goals.items(), key=lambda x: str(x[0])):
        want = g["weight"] / weight if s in rate else 0.0
        own = got[s]["t"] if s in got else 0
        report.append((s, want, own / everything, sums[s]["documents"] if s in sums else 0, totals.get(s) or 0, got[s]["n"] if s in got else 0, own, g["max_repeats"], s in rate and abs(own / everything - want) < 0.005))
    return plan, spark.createDataFrame(report, "source string, target_share double, actual_share double, documents bigint, tokens bigint, mixed_rows bigint, mixed_tokens bigint, max_repeats int, met boolean")


def mixture(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed documents: documents' columns, copy_no from 1 and n_tokens, one row per copy."""
    chosen = broadcast_if_small(plan.select(F.col("doc_id").alias("_id"), "n_tokens", "copies"))
    rows = documents.join(chosen, F.col("doc_id") == F.col("_id")).drop("_id")
    return rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
