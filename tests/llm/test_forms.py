"""Visual form, search form and look-alike pairs."""

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.llm import lookalikes
from quern.llm.forms import TokenHashes, key_tokens, raw_tokens, visual_form

SAME = [
    ("Ｃầu hỏi １２", "Cầu hỏi 12"), (unicodedata.normalize("NFD", "tiếng Việt"), "tiếng Việt"), ("a​b­c⁠d﻿", "abcd"), ("a b　c d", "a b c d"),
    ("Тоаn", "Toan"), ("Ðông Ɖăng", "Đông Đăng"), ("lа̣nh", "lạnh"), ("Νội Χá", "Nội Xá"),
]
OTHER = [("x²", "x2"), ("hòa", "hoà"), ("a  b", "a b"), ("a\nb", "a b"), ("A", "a"), ("a.", "a"), ("α", "a"), ("đ", "d"), ("👨‍🌾", "👨🌾"), ("…", "..."), ("a\r\n", "a\n")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert visual_form(a) == visual_form(b) == b


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert visual_form(a) != visual_form(b)


def test_edges():
    assert visual_form(None) is None and visual_form("") == "" and visual_form("ẞ", fold_case=True) == "ss"
    t = "вода"
    assert visual_form(visual_form(t)) == visual_form(t)


def test_pairs_against_brute_force(spark):
    rng = random.Random(1)
    base = ["Cường độ  dòng điện", "Hà Nội, năm 1990", "", "x² + 1", "Đà Lạt"]
    odd = [lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace("o", "о"), lambda t: t.replace(" ", " "), lambda t: "​" + t, lambda t: t.upper(), lambda t: t]
    rows = [(n, rng.choice(odd)(rng.choice(base))) for n in range(80)] + [(80, None), (81, None)]
    df = spark.createDataFrame(rows, "id_a bigint, text string").withColumn("id_b", F.lit("clash"))
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x is not None and y is not None and x != y and visual_form(x) == visual_form(y)}
    got = [(r.id_a, r.id_b) for r in lookalikes.same_look(df, "id_a", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert lookalikes.same_look(df.limit(0), "id_a", "text").count() == 0


def test_hot_spelling(spark):
    df = spark.range(600).select("id", F.when(F.col("id") == 7, "Тên").otherwise(F.when(F.col("id") % 3 == 0, "Tên").otherwise(F.col("id").cast("string"))).alias("t"))
    assert lookalikes.same_look(df, "id", "t").count() == 200


def test_one_form_column(spark):
    rows = [(n, t) for n, t in enumerate([a for a, _ in SAME] + [a for a, _ in OTHER] + ["", None])]
    df = lookalikes.one_form(spark.createDataFrame(rows, "id int, t string"), "t", "f")
    assert all(r.f == visual_form(r.t) for r in df.collect())
    folded = lookalikes.one_form(spark.createDataFrame(rows, "id int, t string"), "t", "f", fold_case=True)
    assert all(r.f == visual_form(r.t, True) for r in folded.collect())


def test_tokens():
    assert raw_tokens("Giá <b>12,5</b> và<br/>1.000 – H<sub>2</sub>O&nbsp;x_y") == ["Giá", "12,5", "và", "1.000", "H", "2", "O", "x", "y"]
    th = TokenHashes(limit=3)
    a = th.of("Đà Nẵng, 12,5 km rất xa lắm")
    assert (a == th.of("ĐA NANG 12,5 KM RAT XA LAM")).all() and len(a) == 7
    assert len(th.of(None)) == len(th.of("  \n")) == 0


def test_key_tokens():
    t = "Sông Lám Nhốc dài 12 km. Ở đó có Hà Nội."
    assert [raw_tokens(t)[k] for k in sorted(key_tokens(t))] == ["Sông", "Lám", "Nhốc", "12", "Hà", "Nội"]
    assert [raw_tokens(t.upper())[k] for k in sorted(key_tokens(t.upper()))] == ["12"]


def test_compatibility_and_case_are_parameters(spark):
    from quern.llm.lookalikes import look_links, one_form

    assert visual_form("ﬁn Ⅳ") == "fin IV" and visual_form("x² ① ½ 𝐀 … ſ") == "x² ① ½ 𝐀 … ſ"
    assert visual_form("x² ① 𝐀 Straße", compatibility=True) == "x2 1 A Straße" and visual_form("STRASSE 𝐀", True, True) == visual_form("straße a", True, True)
    rows = [(1, "x² A"), (2, "x2 a"), (3, None), (4, ""), (5, "x2 a")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    assert [r.f for r in one_form(df, "t", "f", True, True).orderBy("id").collect()] == ["x2 a", "x2 a", None, "", "x2 a"]
    links, members = look_links(df, "id", "t", True, True)
    assert links.count() == 1 and sorted(r.id for r in members.collect()) == [1, 2, 5]
    assert look_links(df, "id", "t")[0].count() == 0


def test_spellings_of_very_many_rows(spark):
    from quern.llm.lookalikes import look_links, same_look

    df = spark.range(3000).select("id", F.when(F.col("id") == 7, "Ha\u0300 Nội").when(F.col("id") % 3 == 0, "Hà Nội").otherwise(F.col("id").cast("string")).alias("t"))
    links, members = look_links(df, "id", "t")
    assert links.count() == 1 and members.count() == 1001 and same_look(df, "id", "t").count() == 1000
