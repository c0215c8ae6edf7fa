"""Records of evaluation splits that recur, the same or nearly, in the training split.

Units (contexts, or question and choices of a record) are sets of shingles. Shingles are
put in one order, rarest first; a pair of units of the wanted similarity shares one within
the first few of both, so only those are indexed and probed. Length and position filters
drop pairs that cannot reach the overlap; the rest are verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import TokenHashes, fold, key_tokens, plain, raw_tokens
from quern.llm.leaks import gram_hashes
from quern.operators.materialize import broadcast_if_small, materialize, rows_of
from quern.operators.setjoin import similar_sets

EVAL_SPLITS = ("validation", "test")

#: Question classes of one context beyond which questions are joined by tokens instead of all with all. Results don't depend on it.
HOT_QUESTIONS = 64


#: Bits of the map of evaluation shingles that training shingles are held against before they are shuffled: 16 for each, up to this (32 MB).
MAP_BITS = 1 << 28


def prefix_join(units: DataFrame, t: float) -> DataFrame:
    """left, right: units of the evaluation side and of the training side with Jaccard similarity of at least t.

    units: u, is_train, is_eval, grams (distinct bigints, never null), and n if the sets
    were cut before; written already.
    """
    sized = ["n"] if "n" in units.columns else []
    return similar_sets(units.select("u", F.col("is_eval").alias("is_left"), F.col("is_train").alias("is_right"), "grams", *sized), t, ready=True)


def shingle_map(units: DataFrame) -> np.ndarray:
    """Bits that the shingles of units set, as 64-bit words: a power of two, bounded by MAP_BITS whatever the units hold."""
    n = units.select(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(10, (16 * n).bit_length()))
    g = units.select(F.explode("grams").alias("g"))
    low = F.col("g").bitwiseAND(F.lit(bits - 1))
    words = g.groupBy(F.shiftright(low, 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(g & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _mapped(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The shingles whose bit is set."""
    low = grams.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return grams[(words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)]


# Questions

_NUMBERED = re.compile(r"^\s*(?:(?:câu(?:\s+hỏi)?|bài|question|q)\s*\d{1,4}\s*[.:)\-]?|\d{1,4}\s*[.)])\s+(?=\S)", re.I)
_NUMBER = re.compile(r"(?:(?<![\w)])[-−])?\d+(?:[.,]\d+)*")


def without_number(question: str) -> str:
    """The question without a number in front of it."""
    return _NUMBERED.sub("", question, count=1)


def _whole(data: bytes) -> int:
    """A signed 64-bit hash; 0 for nothing."""
    return int.from_bytes(xxhash.xxh3_64_digest(data), "little", signed=True) if data else 0


def _numbers(question: str) -> list[str]:
    """Numbers of a plain question with their signs, in order."""
    return [n.replace("−", "-") for n in _NUMBER.findall(question)] if any(map(str.isdigit, question)) else []


def _alike(a: str, b: str) -> bool:
    """Whether one word is a misspelling of the other."""
    return sorted(a) == sorted(b) or abs(len(a) - len(b)) <= 1 and SequenceMatcher(None, a, b, False).ratio() >= 0.6 and min(len(a), len(b)) > 2


def same_question(a: str, b: str) -> bool:
    """Whether two questions are the same up to small changes; another name or number is another question.

    Case, accents, punctuation and a number in front don't count; numbers must be equal with
    their signs, names letter for letter but for case and accents.
    """
    a, b = without_number(plain(a)), without_number(plain(b))
    if _numbers(a) != _numbers(b):
        return False
    ta, tb = [fold(t) for t in raw_tokens(a)], [fold(t) for t in raw_tokens(b)]
    if ta == tb:
        return True
    n = max(len(ta), len(tb))
    if not ta or not tb or 2 * sum((Counter(ta) & Counter(tb)).values()) < 0.9 * min(len(ta), len(tb)):
        return False
    ka, kb = key_tokens(a), key_tokens(b)
    cost = 0.0
    for op, i1, i2, j1, j2 in SequenceMatcher(None, ta, tb, False).get_opcodes():
        if op == "equal":
            continue
        if any(i in ka for i in range(i1, i2)) or any(j in kb for j in range(j1, j2)):
            return False
        if op == "replace":
            if i2 - i1 == j2 - j1:
                other = [not _alike(x, y) for x, y in zip(ta[i1:i2], tb[j1:j2])]
                if sum(other) > 1:
                    return False
                cost += sum(1.0 if o else 0.5 for o in other)
            else:
                # words joined or split, or one word for two
                if not _alike("".join(ta[i1:i2]), "".join(tb[j1:j2])) and min(i2 - i1, j2 - j1) > 1:
                    return False
                cost += max(i2 - i1, j2 - j1)
        else:
            edge = i1 == 0 or i2 == len(ta)
            cost += (i2 - i1 + j2 - j1) * (0.5 if edge else 1.0)
    return cost <= max(2.5, 0.3 * n)


def first_tokens(question: str) -> tuple[int, list[int]]:
    """(hash of its numbers, hashes of its folded tokens, each numbered by its occurrence; [0] if it has none).

    Questions that are the same by same_question have the same numbers; of their tokens
    they share as many as least_common says.
    """
    clean = without_number(plain(question))
    seen: Counter = Counter()
    tokens = []
    for t in map(fold, raw_tokens(clean)):
        seen[t] += 1
        tokens.append(_whole(f"{t} {seen[t]}".encode()))
    return _whole(" ".join(_numbers(clean)).encode()), tokens or [0]


def least_common(n: Column) -> Column:
    """Least number of tokens that a question of n has in common with one that is the same.

    same_question wants 0.45 of the shorter one's tokens, and each token that only one has
    costs at least 0.5 of max(2.5, 0.3 of the longer one's), so the shorter one has at
    least min(n - 5, 0.4 n).
    """
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), F.ceil(F.least(n - 5, n * 0.4 - 1e-9))) * 0.45 - 1e-9)).cast("int")


def same_choices(a: list[str | None], b: list[str | None]) -> bool:
    """Whether two lists of choices are the same in any order, up to small changes of words; numbers must be equal."""
    fa = [" ".join(map(fold, raw_tokens(x))) if x else "" for x in a]
    fb = [" ".join(map(fold, raw_tokens(x))) if x else "" for x in b]
    ca, cb = Counter(fa), Counter(fb)
    left, right = list((ca - cb).elements()), list((cb - ca).elements())
    if len(left) != len(right):
        return False
    for x in left:
        best = max(right, key=lambda y: SequenceMatcher(None, x, y, False).ratio())
        if not x or not best or re.findall(r"\d+", x) != re.findall(r"\d+", best) or SequenceMatcher(None, x, best, False).ratio() < 0.75:
            return False
        right.remove(best)
    return True


def _sides(split: Column) -> tuple[Column, Column]:
    return split == "train", split.isin(*EVAL_SPLITS)


def _hashes(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def context_links(rows: DataFrame, t: float = 0.5, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records with same or nearly same question and context in both splits.

    rows: row_id, split, question, context. Rows with a null in these, and of other splits,
    match nothing; so do empty contexts. A context may differ in a sentence and some words:
    similarity of at least t on shingles of k words. Rows with equal context and question
    are a class: links pairs classes, (left, ql) of the evaluation and (right, qr) of the
    training side; members gives row_id, is_eval, u, q: the class each row is in.

    Shingles of the evaluation side are few; their bits are sent to the training side,
    which keeps only shingles that are there (and how many it had), so that most are never
    shuffled.
    """
    train, held = _sides(F.col("split"))
    used = rows.filter(F.col("question").isNotNull() & F.col("context").isNotNull() & (train | held))
    thin = used.select("row_id", train.alias("is_train"), held.alias("is_eval"), F.xxhash64(F.lit(2), "question").alias("q"), *_hashes(F.col("context")))
    groups = materialize(thin.groupBy("h1", "h2").agg(F.min("row_id").alias("u"), F.max("is_train").alias("is_train"), F.max("is_eval").alias("is_eval")), "contexts")
    count = rows_of(groups)
    records = materialize(thin.drop("is_train").join(broadcast_if_small(groups.select("h1", "h2", "u"), rows=count), ["h1", "h2"]).select("row_id", "is_eval", "u", "q"), "records")
    texts = used.select(F.col("row_id").alias("u"), "context").join(broadcast_if_small(groups.select("u", "is_train", "is_eval"), rows=count), "u")
    schema = "u bigint, is_train boolean, is_eval boolean, n int, grams array<bigint>"

    def shingles(parts: Iterator[pd.DataFrame], words: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        th = TokenHashes()
        for part in parts:
            grams = [np.unique(gram_hashes(th.of(x), k)).view(np.int64) for x in part["context"]]
            size = [len(g) for g in grams]
            yield part.drop(columns="context").assign(n=size, grams=grams if words is None else [_mapped(g, words) for g in grams])

    columns = ["u", "is_train", "is_eval", "context"]
    own = materialize(texts.filter("is_eval").select(columns).mapInPandas(shingles, schema).filter("n > 0"), "eval-units")
    words = rows.sparkSession.sparkContext.broadcast(shingle_map(own))
    other = materialize(texts.filter("not is_eval").select(columns).mapInPandas(lambda parts: shingles(parts, words.value), schema).filter("size(grams) > 0"), "train-units")
    near = prefix_join(own.unionByName(other), t)
    equal = own.filter("is_train").select(F.col("u").alias("left"), F.col("u").alias("right"))
    pairs = materialize(near.unionByName(equal), "context-pairs")
    # question classes within contexts
    classes = materialize(records.groupBy("u", "q", "is_eval").agg(F.min("row_id").alias("rep")), "question-classes")
    left = classes.filter("is_eval").select(F.col("u").alias("left"), F.col("q").alias("ql"), F.col("rep").alias("rep_l"))
    right = classes.filter("not is_eval").select(F.col("u").alias("right"), F.col("q").alias("qr"), F.col("rep").alias("rep_r"))
    hot = materialize(classes.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_QUESTIONS).select("u"), "hot-contexts")
    questions = used.select("row_id", "question")
    if rows_of(hot):
        small = broadcast_if_small(hot)
        paired = pairs.join(small.select(F.col("u").alias("left"), F.lit(True).alias("hl")), "left", "left").join(small.select(F.col("u").alias("right"), F.lit(True).alias("hr")), "right", "left")
        both_hot = F.coalesce("hl", F.lit(False)) & F.coalesce("hr", F.lit(False))
        met = paired.filter(~both_hot).select("left", "right").join(left, "left").join(right, "right")
        met = met.unionByName(_by_tokens(materialize(paired.filter(both_hot).select("left", "right"), "hot-pairs"), left, right, questions))
    else:
        met = pairs.join(left, "left").join(right, "right")
    met = materialize(met, "question-pairs")
    same = met.filter("ql = qr").select("left", "ql", "right", "qr")
    asked = met.filter("ql <> qr").join(questions.select(F.col("row_id").alias("rep_l"), F.col("question").alias("a")), "rep_l").join(questions.select(F.col("row_id").alias("rep_r"), F.col("question").alias("b")), "rep_r")

    @F.pandas_udf("boolean")
    def same_q(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_question(x, y) for x, y in zip(a, b)])

    return materialize(same.unionByName(asked.filter(same_q("a", "b")).select("left", "ql", "right", "qr")), "class-pairs"), records


def context_pairs(rows: DataFrame, t: float = 0.5, k: int = 5) -> DataFrame:
    """id_a, id_b (evaluation row, training row): context_links, each class as its rows."""
    links, records = context_links(rows, t, k)
    a = records.filter("is_eval").select(F.col("u").alias("left"), F.col("q").alias("ql"), F.col("row_id").alias("id_a"))
    b = records.filter("not is_eval").select(F.col("u").alias("right"), F.col("q").alias("qr"), F.col("row_id").alias("id_b"))
    return links.join(a, ["left", "ql"]).join(b, ["right", "qr"]).select("id_a", "id_b")


def _by_tokens(pairs: DataFrame, left: DataFrame, right: DataFrame, questions: DataFrame) -> DataFrame:
    """Of all question classes of the context pairs, at least those that same_question accepts.

    They have the same numbers and share one of their first tokens, rarest first, by the
    bound that least_common gives.
    """

    @F.pandas_udf("struct<nums:bigint,tokens:array<bigint>>")
    def lead(q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_tokens(x) for x in q], columns=["nums", "tokens"])

    def worded(side: DataFrame, u: str, q: str, rep: str) -> DataFrame:
        own = side.join(pairs.select(u).distinct(), u, "left_semi").join(questions.select(F.col("row_id").alias(rep), "question"), rep)
        return materialize(own.select(u, q, rep, lead("question").alias("x")).select(u, q, rep, "x.nums", "x.tokens"), "questions")

    a, b = worded(left, "left", "ql", "rep_l"), worded(right, "right", "qr", "rep_r")
    counts = a.select(F.explode("tokens").alias("token")).unionByName(b.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))
    counts = materialize(counts, "token-counts")

    def first(side: DataFrame, u: str, q: str, rep: str) -> DataFrame:
        each = side.select(u, q, rep, "nums", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(broadcast_if_small(counts), "token")
        order = each.groupBy(u, q, rep, "nums", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
        return order.select(u, q, rep, "nums", F.explode(F.slice("order", F.lit(1), F.col("n") - least_common(F.col("n")) + 1)).alias("x")).select(u, q, rep, "nums", F.col("x.token").alias("token"))

    met = pairs.join(first(a, "left", "ql", "rep_l"), "left").join(first(b, "right", "qr", "rep_r"), ["right", "nums", "token"])
    return met.select("left", "right", "ql", "rep_l", "qr", "rep_r").distinct()


def choice_links(rows: DataFrame, t: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records with same or nearly same question and choices, in any order, in both splits.

    rows: row_id, split, question, choices (array of 4, nulls allowed). Rows with a null
    question, and of other splits, match nothing. Shingles of a record are its whole choices
    and its question: choices are short, and what changes least. A choice counts together
    with the numbers of the question, which must be the same: common choices alone bring
    few records together. t admits records that have two of five in common. Rows of equal
    question and choices are a class: links pairs classes (left, right), members gives
    row_id, is_eval, u.
    """
    train, held = _sides(F.col("split"))
    used = rows.filter(F.col("question").isNotNull() & (train | held)).select("row_id", train.alias("is_train"), held.alias("is_eval"), "question", "choices")

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = TokenHashes()
        for part in parts:
            q, c = [], []
            for question, choices in zip(part["question"], part["choices"]):
                bare = without_number(plain(question))
                # a sign of a number is no token, so the numbers are added to the tokens
                nums = _whole(" ".join(_numbers(bare)).encode())
                q.append(_whole(th.packed(bare) + nums.to_bytes(8, "little", signed=True)))
                c.append([h ^ nums if h else 0 for h in sorted(_whole(th.packed(x)) for x in choices)] if choices is not None else [])
            yield pd.DataFrame({"row_id": part["row_id"], "is_train": part["is_train"], "is_eval": part["is_eval"], "q": q, "c": c})

    thin = used.mapInPandas(records, "row_id bigint, is_train boolean, is_eval boolean, q bigint, c array<bigint>")
    thin = materialize(thin, "exam-records")
    groups = thin.groupBy("q", "c").agg(F.min("row_id").alias("u"), F.max("is_train").alias("is_train"), F.max("is_eval").alias("is_eval"))
    units = materialize(groups.withColumn("grams", F.array_distinct(F.filter(F.concat(F.array("q"), "c"), lambda x: x != 0))), "exam-units")
    near = prefix_join(units.select("u", "is_train", "is_eval", "grams").filter("size(grams) > 0"), t)
    own = units.filter("is_train and is_eval").select(F.col("u").alias("left"), F.col("u").alias("right"))
    # within a class, and between near classes, texts decide: by distinct wording
    words = materialize(used.join(broadcast_if_small(units.select("u")), F.col("row_id") == F.col("u"), "left_semi").select("row_id", "question", "choices"), "exam-texts")
    pairs = materialize(near, "exam-pairs")
    asked = pairs.join(words.select(F.col("row_id").alias("left"), F.col("question").alias("qa"), F.col("choices").alias("ca")), "left").join(words.select(F.col("row_id").alias("right"), F.col("question").alias("qb"), F.col("choices").alias("cb")), "right")

    @F.pandas_udf("boolean")
    def same_record(qa: pd.Series, qb: pd.Series, ca: pd.Series, cb: pd.Series) -> pd.Series:
        return pd.Series([same_question(a, b) and same_choices(list(c), list(d)) for a, b, c, d in zip(qa, qb, ca, cb)])

    found = asked.filter(same_record("qa", "qb", "ca", "cb")).select("left", "right").unionByName(own)
    members = materialize(thin.join(units.select("q", "c", "u"), ["q", "c"]).select("row_id", "is_eval", "u"), "exam-members")
    return materialize(found, "exam-found"), members


def choice_pairs(rows: DataFrame, t: float = 0.25) -> DataFrame:
    """id_a, id_b (evaluation row, training row): choice_links, each class as its rows."""
    links, members = choice_links(rows, t)
    a = members.filter("is_eval").select(F.col("u").alias("left"), F.col("row_id").alias("id_a"))
    b = members.filter("not is_eval").select(F.col("u").alias("right"), F.col("row_id").alias("id_b"))
    return links.join(a, "left").join(b, "right").select("id_a", "id_b")
