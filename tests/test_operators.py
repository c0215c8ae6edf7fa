"""Rules, stages, deduplication, joins, splits, statistics, leakage."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import dedup, leakage, lookup, materialize, overlap, ranking, setjoin, split, stats
from quern.operators.rules import RuleSet, blank, missing
from quern.operators.setjoin import similar_sets
from quern.operators.stage import Stage, capped_rejects, expect, expect_unique


def test_first_reason_and_all_flags(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, t string")
    rules = RuleSet([("null", F.col("t").isNull()), ("missing", missing(F.col("t"))), ("blank", blank(F.col("t")))])
    got = {r.id: (r.a, r.b) for r in df.select("id", rules.first_reason().alias("a"), rules.all_flags().alias("b")).collect()}
    assert got == {1: (None, []), 2: ("missing", ["missing", "blank"]), 3: ("null", ["null", "missing", "blank"])}
    assert {r.reason: r.rows for r in rules.failures(df).collect()} == {"null": 1, "missing": 2, "blank": 2}


def test_stage_report_and_rejects(spark):
    s = Stage(spark.createDataFrame([(1, None), (2, "bad"), (3, "duplicate")], "id int, reason string"))
    assert (s.kept.count(), s.rejects.count()) == (1, 2)
    assert s.totals().first().asDict() == {"loaded": 3, "kept": 1, "rejected": 2, "kept_percent": 33.33}
    assert [r.id for r in capped_rejects(s, "id", 5).collect()] == [2]
    assert s.reject_rows({"id": F.lit("")}).first().id == "unknown"


def test_expectations(spark):
    df = spark.range(3)
    assert expect(df, F.col("id") >= 0, "no").count() == 3
    with pytest.raises(Exception, match="too large"):
        expect(df, F.col("id") < 2, "too large").collect()
    assert expect_unique(df, "id").count() == 3
    with pytest.raises(Exception, match="twice"):
        expect_unique(df.union(df), "id", "twice").collect()


@pytest.mark.parametrize("parts", [1, 7])
def test_keep_first(spark, parts):
    rows = [(1, "h1"), (2, "h2"), (3, "h1"), (4, "h3"), (5, "h2"), (6, None), (7, None)]
    df = spark.createDataFrame(rows, "p int, h string").repartition(parts)
    kept = dedup.keep_first(df, ["h"], "p").kept
    assert sorted(r.p for r in kept.collect()) == [1, 2, 4, 6]
    again = dedup.keep_first(kept, ["h"], "p")
    assert again.rejects.count() == 0


def test_keep_first_or_invalid(spark):
    df = spark.createDataFrame([(1, " "), (2, "a"), (3, "a"), (4, None)], "p int, h string")
    got = {r.p: r.reason for r in dedup.keep_first_or_invalid(df, "h", "p").rows.collect()}
    assert got == {1: "schema_error", 2: None, 3: "duplicate", 4: "schema_error"}


def test_dedup_of_empty_table(spark):
    df = spark.createDataFrame([], "p int, h string")
    assert dedup.keep_first(df, ["h"], "p").rows.count() == 0 and dedup.duplicate_groups(df, "h", "p").count() == 0


def test_hot_key(spark):
    df = spark.range(3000).select(F.col("id").alias("p"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("h"))
    assert dedup.keep_first(df, ["h"], "p").kept.count() == 2001


def test_fallback_join(spark):
    gen = spark.createDataFrame([("s1", "r1", 2), ("s1", "r2", 1), (None, "cmcq-gen-s2", 3)], "source_id string, request_id string, pos int")
    index = lookup.first_by_key(gen, [F.col("source_id"), F.col("request_id")], F.col("pos"))
    left = spark.createDataFrame([("s1",), ("s2",), ("s3",), (None,)], "sid string")
    out = lookup.fallback_join(left, index, [F.col("sid"), F.concat(F.lit("cmcq-gen-"), "sid")])
    assert {r.sid: r.match and r.match.request_id for r in out.collect()} == {"s1": "r2", "s2": "cmcq-gen-s2", "s3": None, None: None}


def test_update_and_last(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    changes = lookup.last_by_key(spark.createDataFrame([("a", 1, "n1"), ("a", 2, "n2")], "k string, p int, value string"), "k", "p")
    assert {r.k: r.v for r in lookup.update(old, changes.select("k", "value"), "k", "v").collect()} == {"a": "n2", "b": "y"}


def test_batches(spark):
    df = spark.range(5).select(F.col("id").alias("p"))
    assert {r.batch: len(r.rows) for r in lookup.batches(df, "p", 2).collect()} == {0: 2, 1: 2, 2: 1}


@pytest.mark.parametrize(("n", "sizes"), [(1, (0, 0, 1)), (7, (6, 0, 1)), (10, (9, 0, 1)), (19, (17, 0, 2)), (20, (18, 1, 1)), (100, (90, 5, 5))])
def test_three_way_sizes(spark, n, sizes):
    df = spark.range(n).select(F.lit("t").alias("task"), "id")
    got = {r.split: r["count"] for r in split.split_groups(df, "task", F.sha1(F.col("id").cast("string")), (("train", 0.9), ("val", 0.05)), "shadow").groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "shadow")) == sizes


def test_split_follows_the_order_of_the_key(spark):
    df = spark.range(500).select(F.lit("t").alias("task"), F.sha1(F.col("id").cast("string")).alias("k"))
    rows = sorted(split.split_groups(df, "task", F.col("k"), (("train", 0.95),), "probe").collect(), key=lambda r: r.k)
    assert [r.split for r in rows] == ["train"] * 475 + ["probe"] * 25


@pytest.mark.parametrize("parts", [1, 5])
def test_accepted_prefix(spark, parts):
    df = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") % 3 == 0).alias("ok")).repartition(parts)
    got = sorted(r.p for r in split.accepted_prefix(df, F.col("ok"), "p", 100).collect())
    assert got == list(range(298))
    assert split.accepted_prefix(df, F.col("ok"), "p", 10_000).count() == 1000


def test_rank_percentiles(spark):
    df = spark.range(1, 11)
    assert stats.rank_percentiles(df, F.col("id")).first().asDict() == {"p50": 6, "p90": 10, "p99": 10, "max_value": 10}
    assert stats.rank_percentiles(df.filter("id > 99"), F.col("id")).first().p50 is None


def test_longest_label_ties(one):
    assert one(stats.longest_label({"A": F.lit(2), "B": F.lit(5), "C": F.lit(5), "D": F.lit(1)})) == "B"


def test_take_by_permutation(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("b").alias("g"))
    quotas = spark.createDataFrame([("hot", 100), (None, 3), ("b", 10**6), ("none", 5)], "g string, quota int")
    got = ranking.take_by_permutation(df, ["g"], "id", quotas)
    n = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert n["hot"] == 100 and n[None] == 3 and n["b"] == df.filter("g = 'b'").count()
    first = sorted((r.k, r.id) for r in df.filter("g = 'hot'").select(F.xxhash64(F.lit(42), "id").alias("k"), "id").collect())
    # permuted order: the key, read without sign
    want = [i for _, i in sorted((k % 2**64, i) for k, i in first)][:100]
    assert sorted(r.id for r in got.filter("g = 'hot'").collect()) == sorted(want)


@pytest.mark.parametrize("step", [64, 2])
def test_similar_sets_against_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(setjoin, "STEP", step)
    rng = random.Random(3)
    sets = [sorted({rng.randint(0, 40) for _ in range(rng.randint(0, 12))}) for _ in range(120)]
    sets += [s[:-1] for s in sets[:40] if len(s) > 4]
    rows = [(n, n % 3 == 0, n % 3 != 0, s) for n, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "u bigint, is_left boolean, is_right boolean, grams array<bigint>")
    for t in (0.25, 0.5, 0.8):
        want = {(a, b) for a, l, _, x in rows for b, _, r, y in rows if l and r and a != b and x and y and len(set(x) & set(y)) >= t * len(set(x) | set(y)) - 1e-9}
        assert {(r.left, r.right) for r in similar_sets(df, t).collect()} == want



def test_similar_sets_shuffle_no_pairs_that_share_late_elements(spark):
    """400 x 400 sets share 24 of their 40 elements, too few, and 5 of these lie within the elements that are joined."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        every = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(every.apply, range(every.size()))}

    common = F.sequence(F.lit(0), F.lit(23))
    own = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.col("id") * 16 + i + 1000)
    df = spark.range(800).select(F.col("id").alias("u"), (F.col("id") % 2 == 0).alias("is_left"), (F.col("id") % 2 == 1).alias("is_right"), F.concat(F.transform(common, lambda x: x.cast("bigint")), own).alias("grams"))
    near = df.filter("u = 0").select(F.lit(801).cast("bigint").alias("u"), F.lit(False).alias("is_left"), F.lit(True).alias("is_right"), F.slice("grams", 11, 30).alias("grams"))
    before = written()
    assert {(r.left, r.right) for r in similar_sets(df.unionByName(near), 0.5).collect()} == {(0, 801)}
    assert sum(n for k, n in written().items() if k not in before) < 100_000


def _leak_frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, question string, choices array<string>, context string, answer_text string")


def test_leak_rules(spark):
    bench = _leak_frame(spark, [
        (1, "Ai là vua đầu tiên của nước ta?", ["Một", "Hai", "Ba", "Bốn"], "Đoạn văn dài về lịch sử nước ta thời xưa kia", "đáp số"),
        (2, "Thủ đô ở đâu, hỡi bạn?", ["x1", "x2", "x3", "x4"], None, None),
    ])
    cand = _leak_frame(spark, [
        (10, "ai là vua đầu tiên của nước ta", ["a", "b", "c", "d"], None, None),
        (11, "Của nước ta ai là vua đầu tiên?", None, None, None),
        (12, "Khác hẳn", ["A. x1", "x2", "x3", "x4"], None, None),
        (13, "Câu nữa", None, "đoạn văn dài về lịch sử nước ta thời xưa kia!", None),
        (14, "Không liên quan", ["x4", "x3", "x2", "x1"], "một điều khác", "Đáp số"),
        (15, None, None, None, None),
    ])
    got = {r.id: (r.reason, r.benchmark_id) for r in leakage.first_leak(cand, bench).collect()}
    assert got == {10: ("exact_question_match", 1), 11: ("near_duplicate_question", 1), 12: ("same_choices_pattern", 2), 13: ("high_context_overlap", 1), 14: (None, None), 15: (None, None)}
    facts = {r.id: r.reason for r in leakage.first_leak(cand, bench, facts="text").collect()}
    assert facts[14] == "same_answer_fact_pattern"


def test_leak_ratio(spark):
    a, b = "ai là vua đầu tiên của nước ta ngày xưa", "ai là vua đầu tiêng của nước ta ngày xưaa"
    assert SequenceMatcher(None, a, b).ratio() >= 0.88
    cand, bench = _leak_frame(spark, [(1, a, None, None, None)]), _leak_frame(spark, [(2, b, None, None, None)])
    assert leakage.first_leak(cand, bench, ratio=False).first().reason is None
    assert leakage.first_leak(cand, bench).first().reason == "near_duplicate_question"


def test_leak_contexts_by_containment_and_ratio(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnopqrstuvxy") for _ in range(6))
    inner = " ".join(word() for _ in range(12))
    typed = " ".join(w[:2] + "z" + w[3:] if n % 2 else w for n, w in enumerate(inner.split()))  # one letter in every other word
    joined = "ai là vua đầu tiên của nước ta ngày xưa kia"
    assert SequenceMatcher(None, typed, inner).ratio() >= 0.86
    bench = _leak_frame(spark, [(1, None, None, inner, None), (2, joined, None, None, None), (3, None, None, "xyz", None)])
    cand = _leak_frame(spark, [
        (10, None, None, " ".join(word() for _ in range(60)) + " " + inner + " " + " ".join(word() for _ in range(60)), None), (11, None, None, inner[20:60], None),
        (12, None, None, typed, None), (13, joined.replace(" ", "", 7), None, None, None), (14, None, None, "khác hẳn, uxyzo", None), (15, None, None, "khác hẳn", None),
    ])
    got = {r.id: (r.reason, r.benchmark_id) for r in leakage.first_leak(cand, bench).collect()}
    context = "high_context_overlap"
    ratio = SequenceMatcher(None, joined.replace(" ", "", 7), joined).ratio()
    assert ratio >= 0.88 and got == {10: (context, 1), 11: (context, 1), 12: (context, 1), 13: ("near_duplicate_question", 2), 14: (context, 3), 15: (None, None)}


def test_materialize_uses_the_shared_folder(spark):
    folder = materialize.shared_dir(spark)
    again = materialize.materialize(spark.range(5), "t")
    assert again.count() == 5 and folder.split("/")[-1] in again.inputFiles()[0]
    assert "broadcast" in materialize.broadcast_if_small(again)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in materialize.broadcast_if_small(again, limit=2)._jdf.queryExecution().logical().toString().lower()


def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def _grams(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def _leaks_by_brute_force(cand, bench, facts):
    """Each candidate with each record in order, by the rules as they are defined."""

    def form(x):
        return " ".join((x or "").lower().split())

    def asked(x):
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in form(x)).split())

    def words(x, n):
        w = x.split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def rule(c, b):
        p, q = asked(c[1]), asked(b[1])
        if p and p == q:
            return 0
        if p and q and (sorted(p.split()) == sorted(q.split()) or _jaccard(set(p.split()), set(q.split())) >= 0.8 or _ratio(p, q) >= 0.88):
            return 1
        if c[2] and [form(x) for x in c[2]] == [form(x) for x in b[2] or []]:
            return 2
        x, y = form(c[3]), form(b[3])
        if x and y and (x in y or y in x or _ratio(x, y) >= 0.86 or _jaccard(words(x, 3) or words(x, 2), words(y, 3) or words(y, 2)) >= 0.5 or _jaccard(_grams(x, 5), _grams(y, 5)) >= 0.45):
            return 3
        if facts and form(c[4]) and form(c[4]) == form(b[4]):
            return 4
        return None

    out = {}
    for c in cand:
        hits = ((b[0], rule(c, b)) for b in sorted(bench))
        bid, found = next(((i, r) for i, r in hits if r is not None), (None, None))
        out[c[0]] = (None if found is None else leakage.RULES[found], bid)
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["vua", "nước", "sông", "núi", "làng", "năm", "đời", "trần", "lê", "a", "ở", "hà", "nội", "huế,", "1873"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))

    def changed(x):
        x = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 8))):
            k = rng.randrange(len(x)) if x else 0
            x[k : k + rng.randint(0, 1)] = rng.choice(["z", " ", "", "q"])
        return "".join(x)

    bench = [(n, rng.choice([None, text(rng.randint(1, 8))]), [text(1), text(1), "x", "y"], rng.choice([None, "", "ng", text(rng.randint(1, 25))]), rng.choice([None, text(1)])) for n in range(40)]
    cand = []
    for n in range(160):
        b = rng.choice(bench)
        context = rng.choice([None, changed(b[3]) if b[3] else text(9), text(4) + " " + (b[3] or "") + " " + text(3), (b[3] or text(5))[2:20], text(12)])
        cand.append((100 + n, rng.choice([None, changed(b[1]) if b[1] else text(3), text(6)]), rng.choice([None, b[2], [text(1), "x", "y", "z"]]), context, rng.choice([None, text(1)])))
    got = {r.id: (r.reason, r.benchmark_id) for r in leakage.first_leak(_leak_frame(spark, cand), _leak_frame(spark, bench), facts="text").collect()}
    assert got == _leaks_by_brute_force(cand, bench, True)


def test_leaks_of_records_and_labels(spark):
    prompt = "Đọc đoạn văn sau và chọn đáp án đúng.\n\nĐoạn văn: {}\n\nCâu hỏi: {}\nA. {}\nB. {}\nC. {}\nD. {}"
    schema = "id bigint, messages array<struct<role:string,content:string>>, metadata struct<answer:string,gold_answer_text:string>"
    cand = spark.createDataFrame([(1, [("user", prompt.format("Một chuyện", "Câu nào?", *"abcd"))], ("c", None)), (2, [("user", "không phải")], ("A", None)), (3, None, None)], schema)
    bench = spark.createDataFrame([(9, [("user", prompt.format("Việc khác hẳn", "Điều gì lạ?", *"wxyz"))], ("C ", "ba")), (8, [("user", "hỏng")], ("C", None))], schema)
    a, b = leakage.records(cand, F.col("id")), leakage.records(bench, F.col("id"))
    first = lambda facts: {r.id: (r.reason, r.benchmark_id) for r in leakage.first_leak(a, b, facts).collect()}
    bad = (leakage.INVALID, None)
    assert first("reference") == {1: ("same_answer_fact_pattern", 9), 2: bad, 3: bad}
    assert first("text") == {1: (None, None), 2: bad, 3: bad}


def test_leaks_of_empty_tables(spark):
    one = _leak_frame(spark, [(1, "Ai?", None, "xyz", None)])
    none = one.limit(0)
    assert leakage.first_leak(none, one).count() == 0 and leakage.first_leak(one, none).first().reason is None


def test_hot_elements_are_salted(spark):
    left, right = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("l")), spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("r"))
    want = left.join(right, "k").count()
    got = materialize.salted_join(left, right, "k", "r", chunk=100)
    assert got.count() == want == got.distinct().count()


def test_slices_do_not_change_results(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"), F.sha1(F.col("id").cast("string")).alias("k"))

    def results():
        return [
            sorted(map(tuple, dedup.duplicate_groups(df, "g", "id").collect())),
            sorted(map(tuple, split.split_groups(df, "g", F.col("k"), (("train", 0.9), ("val", 0.05)), "rest").collect())),
            stats.rank_percentiles(df, F.col("id") * F.col("id")).first(),
            sorted(map(tuple, split.accepted_prefix(df, F.col("id") % 7 == 0, "id", 50).collect())),
            sorted(map(tuple, ranking.take_by_permutation(df, ["g"], "id", spark.createDataFrame([("hot", 77)], "g string, quota int")).collect())),
        ]

    want = results()
    for module in (ranking, split):
        monkeypatch.setattr(module, "SLICE", 40)
    assert results() == want
    ranks = {r.id: r["rank"] for r in dedup.duplicate_groups(df, "g", "id").collect()}
    hot = sorted(i for i in range(3000) if i % 3)
    assert [ranks[i] for i in hot] == list(range(2000))


def test_split_keeps_equal_keys_together(spark):
    df = spark.range(40).select(F.lit(None).cast("string").alias("g"), F.sha1((F.col("id") % 5).cast("string")).alias("k"))
    got = split.split_groups(df, "g", F.col("k"), (("train", 0.5),), "rest").groupBy("k").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows"))
    assert {(r.n, r.rows) for r in got.collect()} == {(1, 8)}


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        materialize.shared_dir(Session())


def test_contexts_that_share_sentences_are_not_shuffled_by_gram(spark):
    """200 x 200 contexts share half of their words, too few: a join of their 5-grams would shuffle each pair many times, or the grams at least."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        every = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(every.apply, range(every.size()))}

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiklmnopqrstuvxy") for _ in range(6))
    common = " ".join(word() for _ in range(12))
    texts = [f"{' '.join(word() for _ in range(10))} {common} {' '.join(word() for _ in range(10))}" for _ in range(400)]
    rows = [(n, None, None, x, None) for n, x in enumerate(texts)]
    near = (999, None, None, texts[3][:-30] + "một câu khác hẳn ở cuối đoạn", None)
    before = written()
    got = {r.id: r.benchmark_id for r in leakage.first_leak(_leak_frame(spark, [*rows[200:], near]), _leak_frame(spark, rows[:200]), ratio=False).collect() if r.reason}
    assert got == {999: 3}
    assert sum(n for k, n in written().items() if k not in before) < 10_000


def test_first_overlaps_in_blocks_against_brute_force(monkeypatch):
    for name in ("ROWS", "COLUMNS", "PLACES", "FREQUENT_CHARS"):
        monkeypatch.setattr(overlap, name, 7)
    rng = random.Random(8)
    vocabulary = ["vua", "nước", "sông", "núi", "làng", "năm", "đời", "trần", "a", "ở", "hà", "𝒳y", "1873"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(3 * n + 1, text(rng.randint(1, 30))) for n in range(60)]
    cand = [rng.choice([text(rng.randint(1, 30)), rng.choice(rows)[1] + " " + text(6), rng.choice(rows)[1][2:]]) or "a" for _ in range(150)]
    upto = [rng.choice([2**63 - 1, 60]) for _ in cand]

    def match(x, y):
        grams = lambda s, n: {tuple(s[k : k + n]) for k in range(len(s) - n + 1)}
        a, b = x.split(" "), y.split(" ")
        return x in y or y in x or _jaccard(grams(x, 5), grams(y, 5)) >= 0.45 or _jaccard(grams(a, 3) or grams(a, 2), grams(b, 3) or grams(b, 2)) >= 0.5

    want = {k: i for k, (x, u) in enumerate(zip(cand, upto)) if (i := next((i for i, y in rows if i <= u and match(x, y)), None)) is not None}
    assert dict(overlap.Overlaps(rows[::-1], 0.45, 0.5).firsts(cand, np.array(upto))) == want and 20 < len(want) < 150


def test_first_questions_with_similar_words_against_brute_force():
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("a b c d e f g h i k l m".split()) for _ in range(rng.randint(1, 9)))
    rows, cand = [(n, text()) for n in range(80)], [text() for _ in range(200)]
    want = {k: i for k, x in enumerate(cand) if (i := next((i for i, y in rows if _jaccard(set(x.split()), set(y.split())) >= 0.8), None)) is not None}
    assert dict(overlap.WordSets(rows, 0.8).firsts(cand, np.full(len(cand), 2**63 - 1))) == want and 20 < len(want) < 200
