"""Allotment, the drawn sample and its report."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm.quotas import allot, allot_tree, category, draw_sample


def test_allot():
    assert allot({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {}, 50) == {"a": 25, "b": 25}
    assert allot({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, {}, 50) == {"a": 10, "b": 40}
    assert allot({"a": 10, "b": 5}, {"a": 1.0}, {}, 50) == {"a": 10, "b": 5}
    assert sum(allot({"a": 9, "b": 9, "c": 9}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {}, 10).values()) == 10
    assert allot({"a": 9, "b": 90}, {"a": 0.01, "b": 0.99}, {"a": 5}, 50)["a"] == 5
    assert sum(allot({"a": 9, "b": 9}, {}, {"a": 9, "b": 9}, 4).values()) == 4
    assert allot({}, {}, {}, 5) == {}


@pytest.mark.parametrize(("field", "text", "want"), [("subject", " World_History ", "world_history"), ("subject", " ", None), ("answer", " c. ", "C"), ("answer", "B", "B"), ("answer", None, None)])
def test_category(one, field, text, want):
    assert one(category(F.lit(text).cast("string"), field)) == want


TARGETS = [("subject", "x", 500, 5), ("subject", "y", 300, 5), ("subject", "z", 200, 5), ("answer", "A", 500, 5), ("answer", "B", 500, 5)]


def _frame(spark, n=1200):
    i = F.col("id")
    return spark.range(n).select(i.alias("row_id"), F.when(i % 3 == 0, "X ").when(i % 3 == 1, "y").when(i % 100 == 2, "z").when(i % 100 == 5, "").otherwise("other").alias("s"), F.when(i % 4 == 0, "a.").when(i % 4 == 1, "B").when(i % 50 == 2, None).otherwise("C").alias("a"))


def test_sample_meets_what_it_can(spark):
    df, targets = _frame(spark), spark.createDataFrame(TARGETS, "target_field string, category string, target_permille int, min_rows int")
    sample, report = draw_sample(df, targets, F.col("s"), F.col("a"))
    assert sample.count() == 600 and sample.select("row_id").distinct().count() == 600
    again = draw_sample(df.repartition(5), targets, F.col("s"), F.col("a"))[0]
    assert {r.row_id for r in again.collect()} == {r.row_id for r in sample.collect()}
    got = {(r.target_field, r.category): r for r in report.collect()}
    drawn = {(f, k): v for f, c in (("subject", "subject_category"), ("answer", "answer_category")) for k, v in {r[0]: r[1] for r in sample.groupBy(c).count().collect()}.items()}
    assert all(r.drawn == drawn.get(k, 0) for k, r in got.items())
    assert got["subject", "x"].met and got["subject", "y"].met and not got["subject", "z"].met
    assert {k for k, r in got.items() if r.missed == "rows"} == {("subject", "z")} and got["subject", "z"].drawn == df.filter("s = 'z'").count() == got["subject", "z"].records
    # the subjects that are wanted don't hold all rows of these answers
    within = {x: df.filter(F.lower(F.trim("s")).isin("x", "y", "z") & F.upper("a").startswith(x)).count() for x in "AB"}
    assert got["answer", "A"].missed == "conflict" and all(got["answer", x].drawn >= min(within[x], 240) for x in "AB")


def test_siblings_come_before_cousins():
    weights = ({"x": 0.5, "y": 0.5}, {"A": 0.5, "B": 0.5})
    # x lacks A: its sibling fills in, and y makes up for the answer, with its own totals kept
    assert allot_tree({("x", "A"): 5, ("x", "B"): 100, ("y", "A"): 100, ("y", "B"): 100}, weights, ({}, {}), 80) == {("x", "A"): 5, ("x", "B"): 35, ("y", "A"): 35, ("y", "B"): 5}
    # x lacks both: cousins of the same answer fill in
    assert allot_tree({("x", "A"): 5, ("x", "B"): 10, ("y", "A"): 100, ("y", "B"): 100}, weights, ({}, {}), 80) == {("x", "A"): 5, ("x", "B"): 10, ("y", "A"): 35, ("y", "B"): 30}
    # an absent category's quota goes to cousins, rows without one come last
    got = allot_tree({("x", "A"): 10, ("y", "A"): 50, (None, "A"): 50, ("x", None): 50}, ({"x": 0.4, "y": 0.4, "z": 0.2}, {"A": 1.0}), ({}, {}), 60)
    assert (got["x", "A"], got["x", None], got["y", "A"], got[None, "A"]) == (10, 14, 36, 0)


def test_minima_of_both_fields():
    have = {("x", "A"): 400, ("x", "B"): 30, ("y", "A"): 60, ("y", "B"): 40}
    got = allot_tree(have, ({"x": 0.99, "y": 0.01}, {"A": 0.98, "B": 0.02}), ({"y": 20}, {"B": 25}), 200)
    assert sum(got.values()) == 200
    assert got["y", "A"] + got["y", "B"] >= 20 and got["x", "B"] + got["y", "B"] >= 25


def test_random_trees():
    """All of the total is drawn, no leaf has more than its rows, and what is missed could not be met by exchange between two leaves."""
    rng = random.Random(2)
    for _ in range(300):
        tops, subs = [*"xyz"[: rng.randint(1, 3)], None], [*"ABC"[: rng.randint(1, 3)], None]
        have = {(s, b): rng.choice([0, 3, 10, 60]) for s in tops for b in subs}
        total = sum(have.values()) // 2
        w = tuple({k: rng.random() for k in keys if k} for keys in (tops, subs))
        w = tuple({k: v / sum(d.values()) for k, v in d.items()} for d in w)
        got = allot_tree(dict(have), w, ({}, {}), total)
        assert sum(got.values()) == total and all(0 <= v <= have.get(k, 0) for k, v in got.items())
        sums = {b: sum(v for (_, x), v in got.items() if x == b) for b in subs}
        goal = allot({k: total for k in w[1]}, w[1], {}, total)
        for a in subs:
            for b in subs:
                if sums[a] > goal.get(a, 0) and sums[b] < goal.get(b, 0):
                    assert not any(got[s, a] and got[s, b] < have[s, b] for s in tops)


def test_empty_tables(spark):
    targets = spark.createDataFrame(TARGETS, "target_field string, category string, target_permille int, min_rows int")
    sample, report = draw_sample(_frame(spark, 0), targets, F.col("s"), F.col("a"))
    assert sample.count() == 0 and report.count() == 5
    assert report.filter("missed = 'rows'").count() == 5
    none, _ = draw_sample(_frame(spark), targets.limit(0), F.col("s"), F.col("a"))
    assert none.count() == 600
