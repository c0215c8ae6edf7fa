"""Text functions, keys, prompts and UDFs against the standard library and fixed values."""

import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import keys, mcq, pyudf, text

C = F.col


@pytest.mark.parametrize(
    ("given", "want"),
    [("  a  b\t\n c ", "a b c"), (None, ""), ("", ""), ("A　B", "A B"), ("😀  x", "😀 x")],
)
def test_clean_text(one, given, want):
    assert one(text.clean_text(C("t").cast("string")), t=given) == want


def test_hash_and_question_forms(one):
    assert one(text.hash_form("t"), t=" Đáp ÁN ") == "đáp án"
    assert one(text.question_form("t"), t="Ai,  là “ai”?") == "ai là ai"


@pytest.mark.parametrize(("given", "want"), [("A. x_y", "x y"), ("b) Hà Nội", "hà nội"), ("a - b", "b"), ("Abc", "abc")])
def test_choice_form(one, given, want):
    assert one(text.choice_form("t"), t=given) == want


def test_clean_choice_takes_one_label(one):
    assert one(text.clean_choice("t"), t=" A. B. x ") == "B. x"
    assert one(text.has_label("t"), t="B. x") and not one(text.has_label("t"), t="xB. ")


def test_clean_question_stops_at_choices(one):
    assert one(text.clean_question("t"), t="Hỏi gì?\n\n\n\nhai  dòng\nA. một\nB. hai") == "Hỏi gì?\n\nhai dòng"
    assert one(text.clean_question("t"), t="Điểm A.\nvà A.b") == "Điểm A.\nvà A.b"


@pytest.mark.parametrize(
    ("given", "want"),
    [("### Human: chào", "chào"), ("Instruction: x\nOutput: y", "x\ny"), ("nói về ### Human Rights", "nói về ### Human Rights"), (None, "")],
)
def test_without_markers(one, given, want):
    assert one(text.without_markers(C("t").cast("string")), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Chọn đáp án: B", "B"), ("đáp án đúng là c", "C"), ("Ta chọn D.", "D"), ("Đáp án A", "A"), ("không rõ", None), ("Ta chọn D. Đáp án: A", "A")],
)
def test_explained_answer(one, given, want):
    assert one(text.explained_answer("t"), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("a", "A"), ("B.", "B"), ("C)", "C"), ("0", "A"), ("3", "D"), ("4", None), ("E", None), ("AB", None)])
def test_answer_letter(one, given, want):
    assert one(text.answer_letter(C("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("1", "easy"), ("6", "easy"), ("7", "medium"), ("9", "medium"), ("10", "hard"), ("12", "hard"), ("13", "medium"), ("12.0", "medium"), ("lớp 5", "medium"), (None, "medium")])
def test_grade_difficulty(one, given, want):
    assert one(text.grade_difficulty(C("t").cast("string")), t=given) == want


def test_ngrams_and_jaccard(one):
    assert one(text.ngrams(text.words("t"), 3), t="a b") == []
    assert one(text.ngrams(text.words("t"), 2), t="a b c") == ["a b", "b c"]
    assert one(text.char_ngrams("t", 5), t="abcd") == [] and one(text.char_ngrams("t", 2), t="abab") == ["ab", "ba"]
    assert one(text.jaccard(text.words("t"), F.array().cast("array<string>")), t="a") == 0.0


def test_spans(one):
    assert one(text.span_matches(C("t"), F.lit(2), F.lit("cd")), t="abcd")
    assert not one(text.span_matches(C("t"), F.lit(-1), F.lit("d")), t="abcd")
    assert one(text.find_from(C("t"), F.lit("ab"), F.lit(1)), t="abab") == 2
    assert one(text.find_from(C("t"), F.lit("ab"), F.lit(3)), t="abab") == -1


def test_keys_have_their_fixed_values(one):
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert one(keys.qa_key(C("a"), C("b"), C("c")), a=" Ctx", b="q", c="A") == "fe930784513606ba98c0850055b91fd680e3bcd8" == sha("ctx\nq\na")
    assert one(keys.context_key(C("a")), a="ctx") == "4024700fd9f055274c529971e23ba54c20b0907c"
    four = [F.lit(x) for x in "abcd"]
    assert one(keys.choices_key(F.lit("q"), four)) == "21c67d3a2b6450c91bf591920467f1f2"
    assert one(keys.mcq_key(F.lit("ctx"), F.lit("q"), four)) == "ae82a95bc73f0fab6ce4d4f020c790b464eb0b93"
    chat = mcq.chat(F.lit("Q1"), F.lit("A1"))
    assert one(keys.record_key(chat)) == "cbe37f983bd3750f40f0f51de07a640a5bc060312e3222bc76becc842a64fe06"


@pytest.mark.parametrize("value", ['a"b', "a\\b", "x\ny\tz", "chữ 😀"])
def test_json_string(one, value):
    import json

    assert one(keys.json_string(C("t")), t=value) == json.dumps(value, ensure_ascii=False)


def test_prompts_round_trip(one):
    four = [F.lit(x) for x in ("một", "hai", "ba", "bốn")]
    p = one(mcq.parse_reading_mcq(mcq.render_reading_mcq(F.lit("dòng 1\ndòng 2"), F.lit("ai?\nai nữa?"), four)))
    assert (p.context, p.question, p.A, p.D) == ("dòng 1\ndòng 2", "ai?\nai nữa?", "một", "bốn")
    assert one(mcq.parse_reading_mcq(F.lit("Câu hỏi: x"))) is None


def test_wrapped_prompt(one):
    p = one(mcq.parse_wrapped(C("t")), t="Câu hỏi: một\nhai\nA. x\ny\nB. 2\nC. 3\nD. 4")
    assert (p.question, p.A, p.B) == ("một hai", "x y", "2")
    assert one(mcq.parse_wrapped(C("t")), t="Câu hỏi: một\nA. x\nB. 2") is None


def test_first_exchange(one):
    rows = [("system", "s"), ("user", "u1"), ("user", "u2"), ("assistant", "a"), ("user", "z")]
    messages = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in rows))
    assert tuple(one(mcq.first_exchange(messages))) == ("u2", "a")
    assert one(mcq.first_exchange(F.slice(messages, 1, 1))) is None


def test_mcq_like(one):
    listed = "Q\nA. 1\nB. 2\nC. 3\nD. 4"
    assert one(mcq.is_mcq_like(F.lit(listed), F.lit(" b. ")))
    assert one(mcq.is_mcq_like(F.lit("x"), F.lit("đáp án: C")))
    assert not one(mcq.is_mcq_like(F.lit(listed), F.lit("Vì lẽ đó nên chọn câu thứ hai.")))
    assert one(mcq.looks_like_mcq(F.lit(listed), F.lit("dài")))


def test_labels_and_places():
    assert ["".join(pyudf.shuffled_labels(s)) for s in ("raw-hash-1", "raw-hash", "seed-1", "seed-2")] == ["DBCA", "ABDC", "DCAB", "BCAD"]
    assert [pyudf.place_choices(s, "g", ["x", "y", "z"])[1] for s in ("raw-hash-1", "raw-hash", "seed-1", "seed-2")] == ["C", "A", "D", "A"]


def test_nfc_and_ratio(one):
    assert one(pyudf.nfc(C("t")), t=unicodedata.normalize("NFD", "tiếng Việt")) == "tiếng Việt"
    assert one(pyudf.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(pyudf.sequence_ratio(F.lit(""), F.lit("x"))) == 0.0


def test_literal_list_and_json(one):
    assert one(pyudf.literal_list(C("t")), t="['a', 'b']") == ["a", "b"]
    assert one(pyudf.literal_list(C("t")), t="a, b") is None
    assert one(pyudf.is_json(C("t")), t='{"a": 1}') and not one(pyudf.is_json(C("t")), t='{"a": 1} x')


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("giá $35,095 và $x$", []),
        ("$x", ["unbalanced_math_dollar"]),
        (r"\frac{1}{2} và $\sqrt{2}$", ["raw_latex_frac"]),
        ("2^{20} hay x^2", ["raw_caret_power"]),
        ("a &nbsp; b\\n", ["html_entity", "literal_backslash_n"]),
    ],
)
def test_formula_flags(given, want):
    assert pyudf.formula_flags(given) == want


def test_wrap_formulas_is_idempotent():
    t = r"Tính \frac{1}{2} + \sqrt{3} + 2^{5} và $\frac{3}{4}$"
    w = pyudf.wrap_formulas(t)
    assert w == r"Tính $\frac{1}{2}$ + $\sqrt{3}$ + $2^{5}$ và $\frac{3}{4}$"
    assert pyudf.wrap_formulas(w) == w and pyudf.formula_flags(w) == []


def test_columns_agree_with_python_on_random_text(spark):
    rng = random.Random(5)
    alphabet = "aÀđ 　\t\n\r.,A)1😀"
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.hash_form("t").alias("h"))
    for r in df.collect():
        assert r.h == " ".join(r.t.replace(" ", " ").lower().split())


def test_grams_of_a_long_text_take_time_in_proportion(spark):
    """An expression as argument is computed once, not once per position."""
    import time

    from pyspark.sql import functions as F

    from quern.functions.text import char_ngram_hashes, char_ngrams, hash_form, ngrams, words

    def took(n):
        df = spark.createDataFrame([("Xin chào các bạn, " * (n // 18),)], "t string")
        began = time.perf_counter()
        row = df.select(F.size(char_ngrams(hash_form("t"), 5)).alias("a"), F.size(ngrams(words(hash_form("t")), 2)).alias("b"), F.size(char_ngram_hashes(hash_form("t"), 5)).alias("c")).first()
        assert row.a == row.c == 18 and row.b == n // 18 * 4 - 1
        return time.perf_counter() - began

    took(2_000)
    assert took(200_000) < 10
