"""Rates, the flight's invariants, and the mixture's shares."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing
from quern.llm.mixing import flight, rates


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_the_totals(seed):
    rng = random.Random(seed)
    tokens = [rng.choice([5, rng.randint(1, 900)]) for _ in range(500)]
    prob = [rng.choice([0.0, 1.0, rng.random(), 0.3]) for _ in tokens]
    p = flight(tokens, prob, seed)
    assert sum(0 < x < 1 for x in p) <= 2 and all(0 <= x <= 1 for x in p)
    assert sum(p) == pytest.approx(sum(prob), abs=1e-6) and sum(a * t for a, t in zip(p, tokens)) == pytest.approx(sum(a * t for a, t in zip(prob, tokens)), abs=1e-3)
    assert all(a == b for a, b in zip(p, prob) if b in (0.0, 1.0)) and flight(tokens, prob, seed) == p


def test_flight_is_fair():
    n = [0] * 6
    for seed in range(3000):
        for k, x in enumerate(flight([10, 20, 30, 40, 50, 60], [0.5] * 6, seed)):
            n[k] += x
    assert all(x / 3000 == pytest.approx(0.5, abs=0.05) for x in n)


def test_rates():
    assert rates({"a": 100, "b": 100}, {"a": 3, "b": 1, "c": 5}, {"a": 1, "b": 2, "c": 1}) == {"a": 1.0, "b": pytest.approx(1 / 3)}
    assert rates({"a": 100, "b": 10}, {"a": 1, "b": 1}, {"a": 1, "b": 2}, total=100)["b"] == 2.0
    assert rates({}, {"a": 1}, {"a": 1}) == {} and rates({"a": 0}, {"a": 1}, {"a": 1}) == {}


@pytest.mark.parametrize("block", [4096, 16])
def test_mixture(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(2)
    rows = [(n, rng.choices(["big", "mid", "small", "other"], [60, 30, 8, 2])[0], "từ " * rng.randint(1, 60)) for n in range(900)]
    rows += [(1000, "big", None), (1001, "big", ""), (1002, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("copies", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    targets = spark.createDataFrame([("big", 2.0, 1), ("mid", 1.0, 2), ("small", 1.0, 4), ("none", 1.0, 3)], "source string, weight double, max_repeats int")
    plan, report = mixing.mix(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert all(got[s].met for s in ("big", "mid", "small")) and not got["none"].met and got["none"].mixed_rows == 0
    assert plan.filter("copies > 4").count() == 0 and plan.select("doc_id").distinct().count() == plan.count()
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(r.copies <= caps[r.source] for r in plan.collect())
    mixed = mixing.mixture(docs.drop("copies", "n_tokens"), plan)
    assert mixed.count() == sum(r.copies for r in plan.collect())
    assert {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5), targets)[0].collect()} == {(r.doc_id, r.copies) for r in plan.collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    plan, report = mixing.mix(docs, targets)
    assert plan.count() == 0 and report.first().actual_share == 0.0


def test_reported_shares_are_those_of_the_mixture(spark):
    """On the real documents: shares, rows and caps of the report, counted again in the mixture."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    documents, targets = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/mix_targets.parquet")
    plan, report = mixing.mix(documents, targets)
    rows = mixing.mixture(documents.select("doc_id", "source", "text"), plan)
    got = {r.source: r for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("copy_no").alias("most")).collect()}
    whole = sum(r.t for r in got.values())
    weights = {r.source: r.weight for r in targets.collect()}
    there = {r.source for r in report.collect() if r.documents}
    for r in report.collect():
        own = got.get(r.source)
        assert (r.mixed_rows, r.mixed_tokens) == ((own.n, own.t) if own else (0, 0))
        assert abs(r.actual_share - (own.t / whole if own else 0)) < 1e-9
        assert own is None or own.most <= r.max_repeats
        if r.source in there:
            assert abs(r.actual_share - weights[r.source] / sum(weights[x] for x in there)) < 0.005 and r.met
