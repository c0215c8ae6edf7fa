"""Kinds of markup, harmless signs, and what clean text keeps."""

import os
import re

import pytest

from quern.llm.markup import clean_text, convert, kinds_of

TAIL = "\nA. 1\nB. 2\nC. 3\nD. 4"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("một <b>hai</b>", ["html"]), ("a<br/> b", ["html"]), ("<!-- x -->y", ["html"]), ("a&nbsp;b &#39;", ["html"]), ("<a href='u'>x</a>", ["html"]), ("<table><tr><td>1</td></tr></table>", ["html"]),
        ("**hai ba** bốn", ["markdown"]), ("*hai ba*", ["markdown"]), ("__hai__ x", ["markdown"]), ("~~bỏ~~ x", ["markdown"]), ("### Đề mục\n\nx", ["markdown"]), ("Câu hỏi: Đề mục\n=====\nx", ["markdown"]), ("![x](y.png)", ["markdown"]), ("[x y](https://e.test/1)", ["markdown"]), ("`mã`", ["markdown"]),
        ("x\n| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("[[x|y]] z", ["wiki"]), ("[[Thể loại:X]]", ["wiki"]), ("{{cần nguồn|2}}", ["wiki"]), ("'''đậm'''", ["wiki"]), ("''dài 680'' m", ["wiki"]), ("== Mục ==\nx", ["wiki"]),
        ("$x^2 + 7x = 8$", ["latex"]), (r"Biết \( a_{1} = 6 \).", ["latex"]), (r"\begin{align} x &= 1 \end{align}", ["latex"]), (r"\textbf{đậm}", ["latex"]), ("x^{2} + y_{3}", ["latex"]), (r"49^\circ.", ["latex"]), (r"Góc \alpha bằng", ["latex"]), ("$$\\int_0^1 x\\,dx$$", ["latex"]), (r"Với $n \geq 2", ["latex"]), ("C. $77188$", ["latex"]), (r"Lấy \sqrt{17} làm", ["latex"]),
        ("Cho biết 3 < 5 và 9 > 7.", []), ("Vé giá 5$, nước giá 2$ một chai.", []), ("Hàm f(x) = 2x + 1", []), ("Ngôn ngữ C# ra đời", []), ("Biến ten_bien_dem bằng 0", []), ("Mũi tên -> chỉ", []), ("Xem chú thích [2]", []), ("Dấu * bên cạnh tên", []), ("tính 4 * 5 * 6 ta", []), ("Toán tử == so sánh", []), ("Ổ đĩa C:\\ đã đầy", []), ("tệp C:\\Users\\ban", []), ("Tập {2, 3}", []), ("Bài #5", []), ("A&B hợp tác", []), ("948\n+ 90 x 35", []),
        ("", []), (None, []),
    ],
)
def test_kinds(text, want):
    assert kinds_of(text) == want
    if text:
        assert kinds_of("Câu hỏi: " + text + TAIL) == want or text.startswith(("Câu hỏi", "C."))


def test_plain_text_is_untouched():
    t = "Vé giá 5$, ten_bien [2] 3 < 5" + TAIL
    assert clean_text(t) == t and clean_text(None) is None and clean_text("") == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h2>Mục</h2>\nx <b>y</b>", "## Mục\n\nx y"), ("== Mục ==\nx", "# Mục\nx"), ("<ul><li>một</li><li>hai</li></ul>", "- một\n\n- hai"), ("* một\n* hai", "- một\n- hai"), ("[[x|y]] và [z](https://e.test)", "y và z"),
        ("```py\na_b = **c**\n``` **x**", "```py\na_b = **c**\n``` x"), ("<pre>a  b</pre> <i>x</i>", "```\na  b\n``` x"), ("Cho $x_1 * y_2 * z$ và **đậm**", "Cho $x_1 * y_2 * z$ và đậm"), ("<table><tr><td>8</td><td>9</td></tr></table>x", "8 | 9\nx"), ("a&nbsp;&lt;b {{mẫu}}", "a\xa0<b"), (r"\textbf{đậm} x", "đậm x"), ("<!-- ẩn -->hiện", "hiện"),
    ],
)
def test_clean(text, want):
    assert clean_text(text) == want


def test_cleaning_leaves_no_markup_but_structure():
    t = "Câu hỏi: <p>x [[a|b]] ''c'' {{d|e}}</p> <span class=\"t\">y</span>" + TAIL
    assert kinds_of(clean_text(t)) == [] and clean_text(t).endswith(TAIL.strip())


def test_long_text_is_linear():
    import time

    t = time.time()
    for x in ("*" * 50_000, "[" * 50_000, "<" * 50_000, "$" * 50_001, "_a" * 30_000, "\\" * 50_000):
        kinds_of(x)
    assert time.time() - t < 20


def test_frame(spark):
    df = spark.createDataFrame([(1, "**a b**", 0), (2, None, 0), (3, "", 0)], "row_id bigint, content string, kinds int")
    assert {r.row_id: (r.kinds, r.clean) for r in convert(df, "row_id", "content").collect()} == {1: (["markdown"], "a b"), 2: ([], None), 3: ([], "")}
    assert convert(df.limit(0), "row_id", "content").count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_why_repeated_substrings_are_not_used():
    """The named method on the real table: what stands, word for word, on two pages and would be removed is wording, not markup."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/wiki_mcq_seed.parquet").to_pylist()
    assert len({r["metadata"]["source"] for r in table}) == 1
    pages = [r["messages"][0]["content"] for r in table if r["messages"] and r["messages"][0]["content"]]
    tokens = [re.findall(r"\w+|[^\w\s]", p) for p in pages]
    k = 8
    owner: dict[tuple, int] = {}
    for n, t in enumerate(tokens):
        for i in range(len(t) - k + 1):
            g = tuple(t[i : i + k])
            owner[g] = n if owner.get(g, n) == n else -1
    plain = spoilt = 0
    for n, t in enumerate(tokens):
        covered = any(owner[tuple(t[i : i + k])] == -1 for i in range(len(t) - k + 1))
        if not kinds_of(pages[n]):
            plain, spoilt = plain + 1, spoilt + covered
    assert plain > 1500 and spoilt > 0.9 * plain
