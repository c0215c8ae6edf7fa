"""Cross-split overlaps against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import crossplit
from quern.llm.crossplit import same_choices, same_question

Q = "Trong thí nghiệm Khân Thong Thức, một vật nặng 218 g được treo vào lò xo. Độ dãn là bao nhiêu?"


@pytest.mark.parametrize(
    ("b", "want"),
    [
        (Q, True), (Q.upper(), True), ("Câu 19) " + Q, True), ("Câu hỏi 6. " + Q, True), (Q.replace("vật", "này vật"), True), (Q.replace("nặng", "nặgn"), True), (Q.replace("được", "duoc"), True), ("Em hãy cho biết: " + Q[0].lower() + Q[1:], True),
        (Q.replace("218", "219"), False), (Q.replace("218", "-218"), False), (Q.replace("Thong", "Vung"), False), (Q.replace("Khân Thong Thức", "vung vốc khài").lower(), False), ("Đâu là thủ đô?", False), ("", False),
    ],
)
def test_same_question(b, want):
    assert same_question(Q, b) == want and same_question(b, Q) == want


def test_same_choices():
    a = ["năm 1591", "năm 1515", "năm 1507", "năm 1458"]
    assert same_choices(a, a[::-1]) and same_choices(a, [x.upper() for x in a]) and not same_choices(a, [*a[:3], "năm 1459"])
    assert same_choices([None, *a[1:]], [None, *a[1:]]) and not same_choices(a, [None, *a[1:]])
    long = ["người dân vẽ bản đồ các lối mòn theo lệ xưa", "x", "y", "z"]
    assert same_choices(long, [long[0].replace("các lối", "những lối"), "z", "y", "x"])


CONTEXT = [f"Câu thứ {n} nói về làng số {n} bên bờ sông dài và có nhiều cây cổ thụ mọc quanh nhà." for n in range(9)]


def _rows():
    c = " ".join(CONTEXT)
    q = "Làng nào có nhiều cây cổ thụ?"
    return [
        (1, "train", q, c), (2, "test", q, c), (3, "validation", q.upper(), " ".join(CONTEXT[:4] + CONTEXT[5:])), (4, "test", "Sông dài bao nhiêu?", c), (5, "train", q, "Một đoạn văn khác hẳn, không liên quan gì tới làng nào cả."),
        (6, "test", None, c), (7, "test", q, None), (8, None, q, c), (9, "other", q, c), (10, "train", "Làng này nào có nhiều cây cổ thụ?", c.replace("bên bờ", "cạnh bờ", 1)), (11, "test", q, ""), (12, "train", q, ""),
    ]


@pytest.mark.parametrize("hot", [64, 0])
def test_context_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(crossplit, "HOT_QUESTIONS", hot)
    df = spark.createDataFrame(_rows(), "row_id bigint, split string, question string, context string").withColumn("u", F.lit(1)).withColumn("left", F.lit("clash"))
    got = sorted((r.id_a, r.id_b) for r in crossplit.context_pairs(df).collect())
    assert got == [(2, 1), (2, 10), (3, 1), (3, 10)]
    assert crossplit.context_pairs(df.limit(0)).count() == 0


def test_choice_pairs(spark):
    ch = ["17889", "17739", "18313,6", "18593"]
    rows = [
        (1, "train", Q, ch), (2, "test", "Câu 5: " + Q, ch[::-1]), (3, "test", Q.replace("218", "219"), ch), (4, "validation", Q.replace("nặng", "nặgn"), ch), (5, "train", Q, ch), (6, "test", None, ch), (7, "train", "Khác hẳn?", ch), (8, "test", Q, ["1", "2", "3", "4"]),
        (9, "train", "Một câu không có lựa chọn nào cả?", [None] * 4), (10, "test", "Một câu không có lựa chọn nào cả?", [None] * 4), (11, "test", Q.replace("218", "-218"), ch),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, split string, question string, choices array<string>")
    assert sorted((r.id_a, r.id_b) for r in crossplit.choice_pairs(df).collect()) == [(2, 1), (2, 5), (4, 1), (4, 5), (10, 9)]


def test_hot_record(spark):
    df = spark.range(900).select(F.col("id").alias("row_id"), F.when(F.col("id") == 1, "test").otherwise("train").alias("split"), F.when(F.col("id") % 3 == 1, F.lit(Q)).otherwise(F.concat(F.lit("Câu hỏi về số "), F.col("id").cast("string"))).alias("question"), F.array(*(F.lit(x) for x in "abcd")).alias("choices"))
    assert crossplit.choice_pairs(df).count() == 299


def test_same_questions_share_their_first_tokens(spark):
    """The bound of the token join holds for all pairs that same_question accepts, the ones with little in common included."""
    least = {r.n: r.m for r in spark.range(1, 80).select(F.col("id").alias("n"), crossplit.least_common(F.col("id")).alias("m")).collect()}
    rng = random.Random(9)
    words = ["năm", "ở", "được", "lớn", "người", "nào", "là", "gì", "sông", "17", "Huế"]
    found = 0
    for _ in range(30_000):
        a = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice(words)[: rng.randint(2, 6)] for _ in range(rng.randint(0, 2))]
        x, y = " ".join(a) + "?", rng.choice(["", "Câu hỏi 17: "]) + " ".join(b) + "?"
        if same_question(x, y):
            found += 1
            (nx, tx), (ny, ty) = crossplit.first_tokens(x), crossplit.first_tokens(y)
            assert nx == ny and len({*tx} & {*ty}) >= max(least[len(tx)], least[len(ty)]), (x, y)
    assert found > 3000
    x, y = "năm ở được lớn?", "Câu hỏi 17: nămm ở cđợư lớn?"
    assert same_question(x, y) and {*crossplit.first_tokens(x)[1]} & {*crossplit.first_tokens(y)[1]}


@pytest.mark.parametrize("bits", [1 << 28, 1 << 10])
def test_mapped_shingles_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(crossplit, "MAP_BITS", bits)
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["làng", "sông", "núi", "nhà", "cây", "bờ"]) + rng.choice("abcdefghij") for _ in range(60))
    texts = [text() for _ in range(20)]
    rows = []
    for n in range(120):
        t = rng.choice(texts).split()
        k = rng.randint(0, 50)
        rows.append((n, rng.choice(["train", "test"]), "Làng nào?", " ".join(t[:k] + t[k + rng.randint(0, 14) :])))
    df = spark.createDataFrame(rows, "row_id bigint, split string, question string, context string")
    grams = {n: {tuple(x) for x in zip(*(c.split()[i:] for i in range(5)))} for n, _, _, c in rows}
    want = {(a, b) for a, s, _, _ in rows for b, r, _, _ in rows if s == "test" and r == "train" and len(grams[a] & grams[b]) >= 0.5 * len(grams[a] | grams[b]) - 1e-9}
    assert {(r.id_a, r.id_b) for r in crossplit.context_pairs(df).collect()} == want
