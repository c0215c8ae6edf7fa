"""Encoding against the tokenizer's own library, whole, in halves and in parts."""

import os
import random

import pytest

from quern.llm.tokens import TOKENIZER_FOLDER, Encoder, encode, parts_of, rank_file

pytestmark = pytest.mark.skipif(not os.path.exists(rank_file()), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def _texts():
    rng = random.Random(9)
    alphabet = "aàá  \n\n\t\r  'sđx1239.,!…😀 ‍　—"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    return out + ["a" * 3000, " " * 2000 + "x", "=" * 999, "đ" * 700 + "😀" * 400, "\n" * 999 + "  y", "1234567890" * 80, "<|endoftext|>", "".join(rng.choice("abcdefgh") for _ in range(2000))]


@pytest.mark.parametrize("long_run", [256, 5])
def test_same_ids(reference, long_run):
    e, texts = Encoder(rank_file(), long_run=long_run, limit=500), _texts()
    assert [e.ids(t) for t in texts] == reference(texts)
    assert e.ids("") == [] and e.ids(None) is None and e.count(None) == 0 and e.count(texts[0]) == len(reference(texts[:1])[0])


@pytest.mark.parametrize("size", [20, 300])
def test_parts_are_put_together(reference, size):
    e, texts = Encoder(rank_file(), long_run=16), _texts()
    for t, want in zip(texts, reference(texts)):
        out, run = [], []
        parts = list(parts_of(t, size))
        assert "".join(p for _, p in parts) == t
        for free, p in parts:
            if free:
                out, run = out + run, e.ids(p)
            else:
                run = e.join(run, e.by_halves(p))
        assert out + run == want


def test_frame(spark, reference):
    texts = ["Một câu ngắn.", "", None, "x" * 4000, "từ " * 900, "Một câu ngắn."]
    df = spark.createDataFrame([(n % 5, t, n) for n, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    for long_text in (1_000_000, 1000):
        got = sorted(((r.doc_id, r.ids) for r in encode(df, long_text=long_text).collect()), key=str)
        want = sorted(((n % 5, reference([t])[0] if t else []) for n, t in enumerate(texts)), key=str)
        assert got == want
    assert encode(df.limit(0)).count() == 0


def test_parts_are_put_together_as_a_tree():
    import random

    enc = Encoder(rank_file(), long_run=16)
    rng = random.Random(3)
    for _ in range(200):
        run = "".join(rng.choice(["a", "ab", "the", "ố", "ng", "x"]) for _ in range(rng.randint(1, 80)))
        cuts = sorted({0, len(run), *(rng.randint(0, len(run)) for _ in range(rng.randint(0, 9)))})
        parts = [enc.by_halves(run[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert enc.put(parts) == enc.bpe.encode_ordinary(run)
    assert enc.put([]) == []
