"""Winnowing and its guarantee, cases and near misses, both join ways."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import leaks
from quern.llm.leaks import Batch, ItemIndex, LeakConfig, batch_leaks, gram_hashes, winnow
from quern.llm.forms import TokenHashes

Q1 = "Trong thí nghiệm Khân Thong Thức, một vật nặng 218 g được treo vào lò xo có độ cứng 42 N/m. Độ dãn của lò xo gần nhất với giá trị nào?"
Q2 = "Trong thí nghiệm Mương Lường Gẩm, một vật nặng 698 g được treo vào lò xo có độ cứng 81 N/m. Độ dãn của lò xo gần nhất với giá trị nào?"
ITEMS = [(1, Q1, {"A": "27402", "B": "27711,5", "C": "27587", "D": "27754"}), (2, Q2, {"A": "nghề chạm bạc ở Thức Xung", "B": "đàn sếu di cư ở Môn Thình", "C": "lớp trầm tích cổ ở Vạch Phình", "D": "hang động nhiều tầng ở Goan Chức"}), (3, None, None), (4, "", {"A": "1"})]
PAD = "Chiều hôm ấy bà con làng chài ngồi vá lưới bên bờ sông và kể chuyện ngày xưa. "


def test_every_long_enough_span_keeps_a_fingerprint():
    rng = np.random.default_rng(0)
    for k, w in ((3, 2), (4, 5)):
        for _ in range(200):
            span = rng.integers(0, 50, k + w - 1).astype(np.uint64)
            a, b = (np.concatenate([rng.integers(100, 200, rng.integers(0, 9)).astype(np.uint64), span, rng.integers(200, 300, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2))
            prints = [set(g[winnow(g, w)].tolist()) for g in (gram_hashes(a, k), gram_hashes(b, k))]
            assert prints[0] & prints[1]


def test_batches_winnow_like_single_texts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(50)] + [None, ""]
    th = TokenHashes()
    batch = Batch(texts, th)
    h, at = batch.grams(3)
    kept = batch.winnowed(h, at, 2)
    for n, t in enumerate(texts):
        g = gram_hashes(th.of(t), 3) if len(th.of(t)) >= 3 else np.empty(0, np.uint64)
        assert sorted(h[kept][batch.doc[at[kept]] == n].tolist()) == sorted(g[winnow(g, 2)].tolist())


CASES = [
    (Q1, {1}), (PAD + Q1.upper() + PAD, {1}), (PAD + Q1.replace(" ", "\n") + PAD, {1}), (PAD + leaks.raw_tokens(Q1)[0] + " " + Q1.replace("treo vào", "móc vô"), {1}),
    (PAD + " ".join(Q1.split()[:20]) + " " + PAD, {1}),  # more than half
    (PAD + " ".join(Q1.split()[:9]) + ". " + PAD, set()),  # less than half
    (Q1.replace("218", "219"), set()), (Q1.replace("Khân Thong Thức", "Vung Vốc Khài"), set()), (Q1.replace("42", "43"), set()),
    (PAD + "A) 27754   B) 27587  C) 27402 D) 27711,5 " + PAD, {1}), (PAD + "27754 " + PAD + "27587 27402 27711,5", set()), (PAD + "27754, 27587, 27402", set()),
    (PAD + "Hang động nhiều tầng ở Goan Chức; đàn sếu di cư ở Môn Thình; nghề chạm bạc ở Thức Xung; lớp trầm tích cổ ở Vạch Phình", {2}),
    ("Thí nghiệm Khân Thong Thức", set()), ("", set()), (None, set()), ("  ", set()), (Q1 + " " + Q2, {1, 2}), (Q1.replace("a", "а").replace("o", "ｏ"), {1}), ("<p>" + Q1.replace("vật", "<b>vật</b>") + "</p>", {1}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    index = ItemIndex(ITEMS, LeakConfig())
    assert {i for _, i, _ in batch_leaks([text], index, TokenHashes())} == want


def _ended(year):
    return f"Nghĩa quân vùng sông nước đã chọn nơi nào làm căn cứ trong những năm {year}"


def test_the_only_name_or_number_may_stand_at_the_edge():
    years = range(1800, 1900)
    index = ItemIndex([(y, _ended(y), None) for y in years], LeakConfig())
    texts = [PAD + " ".join(_ended(y).split()[-11:]) + ". " + PAD for y in years]
    assert batch_leaks(texts, index, TokenHashes()) == [(n, y, "question") for n, y in enumerate(years)]
    # a part of another name is no case
    item = (1, "Ngao Ngong được nhiều người nhớ tới nhờ điệu hò kéo lưới và tiếng chuông buổi chiều. Cuộc họp của các làng năm 1987 đã đưa đến quyết định nào?", None)
    assert not batch_leaks([PAD + item[1][:85].replace("Ngao", "Khao") + PAD], ItemIndex([item], LeakConfig()), TokenHashes())


def test_shuffle_keeps_names_at_the_edge(spark):
    items = spark.createDataFrame([(y, _ended(y), None) for y in range(1870, 1880)], "item_id bigint, question string, choices map<string,string>")
    docs = spark.createDataFrame([(y, " ".join(_ended(y).split()[-11:])) for y in range(1870, 1880)], "doc_id bigint, text string")
    got = leaks.find_leaks(docs, items, LeakConfig(index_rows=0)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(y, y) for y in range(1870, 1880)]


def _frames(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, question string, choices map<string,string>").withColumn("text", F.lit("clash"))
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(CASES)] + [(100, Q1), (101, Q1 + "x " * 200_000)], "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    return docs, items


@pytest.mark.parametrize("cfg", [LeakConfig(), LeakConfig(index_rows=0)], ids=["broadcast", "shuffle"])
def test_both_ways_find_the_same(spark, cfg):
    docs, items = _frames(spark)
    want = {(n, i) for n, (_, s) in enumerate(CASES) for i in s} | {(100, 1), (101, 1)}
    got = [(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items, cfg).collect()]
    assert sorted(got) == sorted(want)
    assert leaks.find_leaks(docs.limit(0), items, cfg).count() == 0 and leaks.find_leaks(docs, items.limit(0), cfg).count() == 0


def test_report(spark):
    docs, items = _frames(spark)
    items = items.withColumn("benchmark", F.when(F.col("item_id") < 3, "b"))
    got = {r.benchmark: (r["items"], r.leaked_items, r.pairs) for r in leaks.leak_report(leaks.find_leaks(docs, items), items).collect()}
    assert got["b"][:2] == (2, 2) and got[None] == (2, 0, 0)


@pytest.mark.parametrize("rows", [200_000, 0], ids=["broadcast", "shuffle"])
def test_short_questions_leak_as_a_whole(spark, rows):
    items = spark.createDataFrame([(1, "Ai sinh 1954?", None), (2, "Vì sao?", None), (3, "Huế", None)], "item_id bigint, question string, choices map<string,string>")
    docs = spark.createDataFrame([(1, PAD + "Ai sinh 1954? " + PAD), (2, PAD + "Ai sinh năm 1954? " + PAD), (3, PAD + "Thế thì vì sao. Ở Huế. " + PAD)], "doc_id bigint, text string")
    got = leaks.find_leaks(docs, items, LeakConfig(index_rows=rows)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (3, 2)]


@pytest.mark.parametrize("rows", [200_000, 0], ids=["broadcast", "shuffle"])
def test_choices_of_three_words_are_never_winnowed_away(spark, rows):
    four = lambda n: {x: f"{a} {b} {n}{k}" for k, (x, a, b) in enumerate(zip("ABCD", ["sông", "núi", "hồ", "đảo"], ["xanh", "cao", "rộng", "xa"]))}
    items = spark.createDataFrame([(n, None, four(n)) for n in range(40)], "item_id bigint, question string, choices map<string,string>")
    docs = spark.createDataFrame([(n, PAD + "; ".join(four(n).values()) + ". " + PAD) for n in range(40)], "doc_id bigint, text string")
    got = leaks.find_leaks(docs, items, LeakConfig(index_rows=rows)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(n, n) for n in range(40)]
