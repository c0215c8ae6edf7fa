"""Copies in other formatting, against brute force, through both filter ways."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import copies
from quern.llm.copies import BloomConfig, canonical, canonical_record, chat_parts, copies_of, letter, marked


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ai  là vua?", "AI LÀ “VUA”", True), ("ki-lô-gam", "ki lô gam", True), ("giá 12,5 kg", "giá 125 kg", False), ("giá -5", "giá 5", False), ("a - b", "a b", True), ("897 - 24", "897 + 24", False), ("4 5", "45", False),
        ("Câu 5. Hỏi", "câu 5 hỏi", True), ("5%", "5", False), ("1/2", "12", False), ("(chỉ) 139 mm", "chỉ 139 mm.", True), ("5$", "5", False), ("x²", "x2", False),
        ("1, 2", "12", False), ("1; 2", "12", False), ("5 %", "5", False), ("5 %", "5%", True), ("1/ 2", "12", False), ("3 : 4", "34", False), ("10 . 5", "105", False), ("1, 2", "1 2", True), ("5, -3", "5 - 3", False), ("3% 4", "3 % 4", True), ("3% 4", "34", False), ("1.5.2", "1.52", False),
    ],
)
def test_canonical(a, b, same):
    assert (canonical(a) == canonical(b)) == same


@pytest.mark.parametrize(("a", "want"), [("C", "C"), (" c. ", "C"), ("(d)", "D"), ("E", None), ("", None), ("Đáp án A", None)])
def test_letter(a, want):
    assert letter(a) == want and letter(None) is None


def test_chat_parts():
    q, c = chat_parts("Câu hỏi : một\nhai\nA: x\n (B) y\nC. z z\nz\nD) t")
    assert [x.strip() for x in (q, *c)] == ["một\nhai", "x", "y", "z z\nz", "t"]
    assert chat_parts("Câu hỏi: một\nA. x") is None and chat_parts(None) is None


def test_chat_records(spark):
    rows = [(1, "Câu hỏi: Ai?\nA. 1\nB. 2\nC. 3\nD. 4", "b."), (2, "câu hỏi : ai\nA) 4\nB) 2\nC) 1\nD) 3", " B"), (3, None, "A"), (4, "x", "A"), (5, "Câu hỏi: Ai?\nA. 1\nB. 2\nC. 3\nD. !", "A")]
    df = spark.createDataFrame(rows, "id int, t string, a string").select("id", copies.from_chat(F.col("t"), F.col("a")).alias("c"))
    got = {r.id: r.c for r in df.collect()}
    assert got[1] == got[2] is not None and got[3] is got[4] is got[5] is None


def _frame(spark):
    rng = random.Random(4)
    rows = []
    for n in range(300):
        base = rng.choice(["Ai là vua?", "Giá 12,5 kg?", "Ở đâu?", f"Số {n}?"])
        ch = ["Huế", "Hà Nội", "-5", "5"]
        order = rng.sample(range(4), 4)
        right = rng.choice([0, 1])
        q = rng.choice([base, base.upper(), base.replace(" ", "  "), f"“{base}”"])
        rows.append((n, q if n % 37 else None, [ch[i] for i in order], rng.choice(["{}", " {}.", "({})"]).format("ABCD"[order.index(right)]) if n % 41 else None, right, base))
    return rows, spark.createDataFrame([r[:4] for r in rows], "id bigint, q string, c array<string>, a string")


def test_groups_against_brute_force(spark):
    rows, df = _frame(spark)
    keyed = df.select("id", copies.from_columns(F.col("q"), [F.get("c", F.lit(n)) for n in range(4)], F.col("a")).alias("canonical"))
    groups, members = copies_of(keyed, BloomConfig(block_bits=512))
    want = defaultdict(list)
    for n, q, _, a, right, base in rows:
        want[(base, right) if q and a else n].append(n)
    assert {r.first_id: r.copies for r in groups.collect()} == {min(v): len(v) for v in want.values()}
    assert {(r.first_id, r.id) for r in members.collect()} == {(min(v), x) for v in want.values() for x in v if x != min(v)}
    empty = copies_of(keyed.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_filter_keeps_every_repeat(spark):
    df = spark.range(20_000).select((F.col("id") % 15_000).alias("k")).select("k", F.xxhash64("k").alias("h")).repartition(7)
    got = marked(df, BloomConfig(block_bits=4096)).filter("maybe")
    n = got.groupBy("k").count()
    assert n.filter("count = 2").count() == 5000 and got.count() < 12_000


def test_filter_by_shuffle_is_the_same(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2500).alias("k")).select("k", F.xxhash64("k").alias("h"))
    told = lambda: sorted((r.k, r.maybe) for r in marked(df).collect())
    a = told()
    monkeypatch.setattr(copies, "DENSE_BITS", 10)
    assert told() == a and {k for k, maybe in a if maybe} >= set(range(500)) and len(a) == 3000


def test_repeated_ids_are_separate_records(spark):
    rows = [(5, "x"), (5, "x"), (7, "x"), (5, "y"), (9, None), (9, None)]
    groups, members = copies_of(spark.createDataFrame(rows, "id bigint, canonical string"))
    assert sorted(map(tuple, groups.collect())) == [(5, 1), (5, 3), (9, 1), (9, 1)]
    assert sorted(map(tuple, members.collect())) == [(5, 5), (5, 7)]


def test_random_numbers_keep_their_values():
    """Two lists of numbers are copies exactly if their numbers are equal, however they are set."""
    rng = random.Random(8)
    number = lambda: rng.choice(["", "-"]) + rng.choice(["1", "2", "12", "1.5", "1,2", "3/4", "10:30"]) + rng.choice(["", "%"])
    lists = [[number() for _ in range(rng.randint(1, 3))] for _ in range(300)]
    shown = lambda ns: rng.choice(["{}", "({})", "“{}”."]).format(rng.choice(["; ", ", ", "  ", " ; "]).join(ns).replace("%", rng.choice(["%", " %"])))
    minus = lambda ns: [x for x in ns if x[0] == "-" and ns.index(x) > 0]
    for a in lists:
        for b in lists[:40]:
            if not minus(a) and not minus(b):  # between numbers a minus may be an operator
                assert (canonical(shown(a)) == canonical(shown(b))) == (a == b), (a, b)


def test_packed_positions():
    at = np.unique(np.random.default_rng(1).integers(0, 10**6, 1000))
    assert (copies._unpack(copies._pack(at)) == at).all() and len(copies._unpack(copies._pack(at[:0]))) == 0


def test_hot_copy(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("canonical"))
    groups, members = copies_of(df)
    assert groups.count() == 2001 and members.count() == 999 and members.filter("first_id = 0").count() == 999


def test_no_word_is_lost():
    t = "Giá trị 3,5 – “x”; (y) [z] 1.000 a/b 10:30"
    assert re.sub(r"\W", "", canonical(t)) == re.sub(r"\W", "", t.lower())


def test_missing_parts():
    four = ["a", "b", "c", "d"]
    assert canonical_record("q", four, "A") and not any((canonical_record(None, four, "A"), canonical_record("?", four, "A"), canonical_record("q", [*four[:3], None], "A"), canonical_record("q", four, None), canonical_record("q", [], "A")))
