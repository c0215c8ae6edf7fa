"""Statistics by hand, kinds of texts, divergence."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import prose
from quern.llm.prose import COLUMNS, divergence, quality, statistics

COMMON = frozenset("và của là có được trong the of and".split())
PROSE = "Khi nước sông rút, bà con làng chài và các thợ đan lát đến bến để sửa lại mái đình. Đó là việc của cả làng, ai có sức đều được gọi tới."
rng = random.Random(1)

KINDS = [
    (PROSE, "prose"), (PROSE.replace(", ", ",\n").replace(" của", "\ncủa").replace(" để", "\nđể"), "prose"), ("Ngoc di cho mua ca va rau. Hom nay troi mua to nen cho vang nguoi. Ai cung ve som.", "prose"),
    ("The quick brown fox jumps over the lazy dog, and the dog sleeps on. Nobody in the village of Hill minds.", "prose"), ("Câu 1: Ai là vua đầu tiên của nước ta thời xưa?\nA. Một\nB. Hai\nC. Ba\nD. Bốn\nCâu 2: Ai là người thứ hai?\nA. Năm\nB. Sáu\nC. Bảy\nD. Tám", "prose"),
    ("Người hỏi: Hôm nay anh có đi chợ không?\nNgười đáp: Có, tôi đi từ sớm để mua cá.\nNgười hỏi: Cá hôm nay giá bao nhiêu vậy?", "prose"), (PROSE + "\n- một\n- hai\n- ba\n" + PROSE, "prose"), ("<p>" + PROSE + "</p>\n**" + PROSE + "**", "prose"),
    ("\n".join(f"- Làng {x}" for x in "abcdefghij"), "list"), ("\n".join(f"({n}) Đàn sếu di cư" for n in range(3)) + "\n" + "\n".join(f"({n}) Nghề {n}" for n in range(9)), "list"), ("Khang Nhài\nLoài lan rừng hiếm\nTrức Dương (33)\nHang động nhiều tầng\nVung Vốc;\nĐôn Sường", "list"), ("Danh sách:\n1. Hà Nội\n2. Huế\n3. Vinh\n4. Đà Lạt\n5. Cần Thơ", "list"),
    ("STT;Tên;Năm\n" + "\n".join(f"{n};Làng {n};19{n:02}" for n in range(10, 30)), "table"), ("| a | b |\n|---|---|\n" + "\n".join(f"| Làng {n} | {n * 7} |" for n in range(9)), "table"), ("\n".join(f"{n}    Trức Dương    {n * 31}" for n in range(9)), "table"), ("\n".join(f"{n}\tHuế\t{n}" for n in range(9)), "table"), ("STT,Tên,Năm\n" + "\n".join(f"{n},Làng {n},19{n:02}" for n in range(10, 30)), "table"),
    ("^%~#|<>@*" * 20, "junk"), (" ".join("".join(rng.choice("abcdefghijk0123456789") for _ in range(9)) for _ in range(60)), "junk"), ("".join(rng.choice("abcXYZ0189+/") for _ in range(400)), "junk"), ("vườn trà cổ " * 60, "junk"), (PROSE.encode().decode("latin-1"), "junk"), ("\n".join(f"{n:06x}  " + " ".join(f"{rng.randint(0, 255):02x}" for _ in range(16)) for n in range(9)), "junk"), ("".join(c if rng.random() > 0.3 else "�" for c in PROSE), "junk"),
    ("ngắn", None), ("", None), ("   ", None),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kind(text, kind):
    assert statistics(text, COMMON)[-1] == kind


def test_counts():
    n, mean, symbol, ended, common = statistics("Nó là vua.\n\nCủa ai và gì\n", COMMON)[:5]
    assert (n, mean, ended, common) == (7, pytest.approx(16 / 7), 0.5, pytest.approx(3 / 7)) and symbol == pytest.approx(1 / 17)
    assert statistics("", COMMON)[:5] == (0, 0.0, 0.0, 0.0, 0.0) and statistics(None, COMMON) == (None,) * 10


def test_divergence():
    assert divergence((1, 0), (1, 0)) == 0 and divergence((1, 0), (0, 1)) == 1
    assert divergence((0.7, 0.3), (0.2, 0.8)) == pytest.approx(divergence((0.2, 0.8), (0.7, 0.3)))


def test_words_and_characters_take_part(monkeypatch):
    # equal lines, with and without function words
    with_words, without = "Khi nước lên, bà con của làng và những người thợ đến bến.", "Sông dâng cao, dân chài, thợ đan, thợ mộc, thợ nề chạy bè."
    a, b = statistics(with_words, COMMON), statistics(without, COMMON)
    assert a[-1] == b[-1] == "prose" and a[5] != b[5]
    monkeypatch.setattr("quern.llm.prose.PROFILES", dict.fromkeys(("prose", "list", "table", "junk"), (0.25,) * 4))
    every = frozenset(w for words, _ in prose.LANGUAGES.values() for w in words)
    table = "\n".join(f"{n}\tHuế\t{n * 317}\t{n * 41}" for n in range(9))
    assert [statistics(t, every)[-1] for t in (PROSE, table, "^%~#|<>@*" * 20)] == ["prose", "table", "junk"]


def test_languages_of_the_word_list_count(spark):
    df = spark.createDataFrame([(1, "The boats of the village lay on the shore in the rain, and a dog was with the men.")], "doc_id bigint, text string")
    words = spark.createDataFrame([(w, "en") for w in ("the", "of", "and", "a", "in")], "word string, lang string")
    far = [quality(df, x).first().from_prose for x in (words, words.withColumn("lang", F.lit("vi")))]
    assert far[0] < far[1]


def test_frame(spark):
    rows = [(n, t, "clash") for n, (t, _) in enumerate(KINDS)] + [(99, None, ""), (0, KINDS[0][0], ""), (100, "x y " * 300_000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    words = spark.createDataFrame([(w, "vi") for w in COMMON] + [("VÀ", "vi"), (None, None)], "word string, lang string")
    got = quality(df, words)
    assert got.columns == ["doc_id", *COLUMNS] and got.count() == len(rows)
    assert {r.doc_id: r.kind for r in got.filter("doc_id < 90").collect()} == {n: k for n, (_, k) in enumerate(KINDS)}
    assert quality(df.limit(0), words).count() == 0 and quality(df.limit(2), words.limit(0)).count() == 2
