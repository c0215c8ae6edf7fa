"""Text normalisation and parsing as column expressions. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of n-grams.
STOPWORDS = (
    "là", "của", "và", "các", "một", "những", "cho", "trong", "với", "được", "này", "đó", "nào", "sau", "đây", "về", "khi", "có",
    "không", "từ", "theo", "để", "ở", "bởi", "như", "thì", "ra", "vào", "trên", "dưới", "nên", "rằng", "hay", "hoặc", "đã", "sẽ",
    "bị", "làm", "đến", "nhiều", "hơn", "nhất", "nếu", "vì", "do", "mà", "nó", "anh", "chị", "người", "câu", "hỏi",
)
# Phrasings of questions.
TEMPLATES = {
    "which_of_the_following_vi": "điều nào sau đây|phát biểu nào sau đây|cái nào sau đây|trong số.*sau đây",
    "true_about": "đúng về|chính xác về|phù hợp nhất",
    "not_true_except": "không đúng|ngoại trừ|ít có khả năng nhất",
    "best_explains": "giải thích tốt nhất|mô tả tốt nhất|phù hợp nhất",
}
# Untranslated phrases.
ENGLISH_LEFT = (
    r"\bI/me/my\b",
    r"\baccording to\b",
    r"\bfollowing\b",
    r"\bScenario\s*1\b",
    r"\bScenario\s*2\b",
    r"Kịch bản\s*1\s*\|",
    r"Kịch bản\s*2\s*\|",
    r"sử dụng\s+I/me/my",
)
# Where an explanation names the right answer, in order of trust.
ANSWER_PATTERNS = (
    r"Chọn\s+đáp\s+án\s*:?\s*([ABCD])\b",
    r"Đáp\s*án\s*cần\s*chọn\s*là\s*:?\s*([ABCD])\b",
    r"Đáp\s*án\s*đúng\s*là\s*:?\s*([ABCD])\b",
    r"Đáp\s*án\s*đúng\s*:?\s*([ABCD])\b",
    r"Đáp\s*án\s*:?\s*([ABCD])\b",
    r"Ta\s+chọn\s+([ABCD])\b",
)
# Fixed value: the label in front of a choice.
LABEL = r"\s*[A-Da-d]\s*[.):\-]\s*"

_ROLES = "Human|Assistant|Instruction|Response|Input|Output"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space of any kind, no-break spaces included.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_spaces(c: Column | str) -> Column:
    """White space of any kind as spaces, character by character."""
    return F.translate(_c(c), SPACES, " " * len(SPACES))


def collapse(c: Column | str) -> Column:
    """Runs of Unicode white space, no-break spaces included, as one space."""
    return F.regexp_replace(plain_spaces(c), " {2,}", " ")


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(_c(c), F.lit(SPACES))


def clean_text(c: Column | str) -> Column:
    """Collapsed and stripped; empty for null."""
    return strip(collapse(F.coalesce(_c(c), F.lit(""))))


def hash_form(c: Column | str) -> Column:
    """Lower case, collapsed, stripped; empty for null. Two texts with one form are the same for deduplication."""
    return clean_text(F.lower(_c(c)))


def question_form(c: Column | str) -> Column:
    """hash_form with punctuation as spaces."""
    return strip(collapse(F.regexp_replace(hash_form(c), r"(?U)[^\w\s]", " ")))


def choice_form(c: Column | str) -> Column:
    """A choice without its label, underscores as spaces, in lower case; empty for null."""
    bare = F.regexp_replace(F.translate(F.coalesce(_c(c), F.lit("")), "\u00a0", " "), r"(?U)\A" + LABEL, "")
    return F.lower(strip(collapse(F.translate(bare, "_", " "))))


def clean_choice(c: Column | str) -> Column:
    """A choice without one label, collapsed."""
    return strip(collapse(F.regexp_replace(strip(collapse(c)), r"(?U)\A" + LABEL, "")))


def has_label(c: Column | str) -> Column:
    """Whether a label is left in front; false for null."""
    return F.coalesce(_c(c).rlike(r"(?U)\A" + LABEL), F.lit(False))


def clean_question(c: Column | str) -> Column:
    """A question up to the first line that starts like a choice, with at most one empty line in a row."""
    t = strip(F.translate(_c(c), "\u00a0", " "))
    t = F.regexp_replace(t, r"\R", "\n")
    t = F.regexp_replace(t, r"(?ms)^[^\S\n]*[A-Da-d][^\S\n]*[.):\-][^\S\n]+.*\z", "")
    return strip(F.regexp_replace(F.regexp_replace(strip(t), r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def lines(c: Column | str) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(_c(c), r"\R"), strip), lambda x: x != "")


def strip_lines(c: Column | str) -> Column:
    """Every line stripped, line breaks as newlines; empty for null."""
    t = F.translate(F.coalesce(_c(c), F.lit("")), "\u00a0", " ")
    return strip(F.array_join(F.transform(F.split(t, r"\R"), strip), "\n"))


def without_markers(c: Column | str) -> Column:
    """Without role markers such as '### Human:' at line starts; empty for null."""
    pattern = rf"(?imuU)^\s*(?:#+\s*(?:{_ROLES})\s*:?|(?:{_ROLES})\s*:)\s*"
    return strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), pattern, ""))


def has_markers(c: Column | str) -> Column:
    """Whether a role marker with a colon is left anywhere."""
    return _c(c).rlike(rf"(?iuU)(?:{_ROLES})\s*:")


def words(c: Column | str) -> Column:
    """Pieces between white space; an empty array for null and blank."""
    return F.filter(F.split(plain_spaces(F.coalesce(_c(c), F.lit(""))), " "), lambda x: x != "")


def content_words(c: Column | str) -> Column:
    """Lower-case words of letters and digits without stop words and single characters."""
    found = F.regexp_extract_all(clean_text(F.lower(_c(c))), F.lit("[0-9a-zA-ZÀ-ỹ]+"), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS))


def alnum_count(c: Column | str) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(clean_text(F.lower(_c(c))), "[^0-9a-zA-ZÀ-ỹ]", ""))


def preview(c: Column | str, n: int = 200) -> Column:
    return F.left(_c(c), F.lit(n))


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row: a lambda's variable is never expanded where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(tokens: Column, n: int, form, empty: str) -> Column:
    """form of each n consecutive elements; an empty array of the type if there are fewer."""
    some = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: form(F.slice(t, i, n)))
    return let(tokens, lambda t: F.when(F.size(t) >= n, some(t)).otherwise(F.array().cast(empty)))


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams of an array, joined by spaces; an empty array if it is shorter."""
    return _windows(tokens, n, lambda w: F.array_join(w, " "), "array<string>")


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the distinct n-grams of an array; an empty array if it is shorter."""
    return F.array_distinct(_windows(tokens, n, lambda w: F.xxhash64(w), "array<bigint>"))


def characters(c: Column | str) -> Column:
    """Array of the characters of a text."""
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


def char_ngrams(c: Column | str, n: int) -> Column:
    """Distinct character n-grams; an empty array if the text is shorter."""
    return F.array_distinct(_windows(characters(c), n, lambda w: F.array_join(w, ""), "array<string>"))


def char_ngram_hashes(c: Column | str, n: int) -> Column:
    """64-bit hashes of the distinct character n-grams; an empty array if the text is shorter."""
    return ngram_hashes(characters(c), n)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def first_group(c: Column | str, patterns: tuple[str, ...], flags: str = "(?iuU)") -> Column:
    """First group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(_c(c), flags + p, 1), F.lit("")) for p in patterns))


def explained_answer(c: Column | str) -> Column:
    """Answer letter that an explanation names."""
    return F.upper(first_group(c, ANSWER_PATTERNS))


def answer_letter(c: Column) -> Column:
    """A to D from a letter, 'A.', 'A)' or an index 0 to 3; null otherwise."""
    t = F.upper(strip(c.cast("string")))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in zip("0123", "ABCD") for x in kv)), t), F.nullif(F.regexp_extract(t, r"\A([ABCD])[.)]?\z", 1), F.lit("")))


def ordinal_letter(c: Column) -> Column:
    """A to D from 1 to 4; null otherwise."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in zip("1234", "ABCD") for x in kv)), c.cast("string"))


def grade_difficulty(c: Column | str) -> Column:
    """easy up to grade 6, medium up to 9, hard up to 12; medium for anything else."""
    n = F.when(strip(c).rlike(r"\A[+-]?\d+\z"), strip(c).try_cast("int"))
    return F.when(n.between(1, 6), "easy").when(n.between(10, 12), "hard").otherwise("medium")


def find_from(text: Column, sub: Column, start: Column) -> Column:
    """Zero-based place of sub at or after start; -1 if there is none."""
    return F.call_function("locate", sub, text, (F.greatest(start, F.lit(0)) + 1).cast("int")) - 1


def span_matches(text: Column, start: Column, sub: Column) -> Column:
    """Whether sub stands in text at the zero-based start; false for nulls and negative starts."""
    return F.coalesce((start >= 0) & (F.substring(text, start + 1, F.length(sub)) == sub), F.lit(False))
