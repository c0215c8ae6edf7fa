"""Records that differ only in formatting, collapsed into one each.

Every record gets a canonical text without white space, case and punctuation. The hash of
each sets bits in two Bloom filters, of canonical texts seen at least once and at least
twice; the filters of all partitions are merged block by block. Only records that the
second filter calls possible repeats are shuffled for exact grouping; the rest are single.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.materialize import BROADCAST_ROWS, broadcast_if_small, materialize, rows_of, salted_join


@dataclass(frozen=True)
class BloomConfig:
    """bits_per_record and hashes size the filters for the counted records; block_bits is
    the part of a filter that one task holds at a time."""

    bits_per_record: int = 16
    hashes: int = 2
    block_bits: int = 1 << 22


# Signs that may belong to a number; all other punctuation is dropped.
_OF_NUMBERS = ".,/:%-−"
_PUNCTUATION = "".join(re.escape(chr(c)) for c in range(0x21, 0x10000) if unicodedata.category(chr(c))[0] == "P" and chr(c) not in _OF_NUMBERS)
_MINUS = re.compile(r"(?<=\d)\s*([-−])\s*(?=\d)")
_PERCENT = re.compile(r"(?<=\d)\s+%")
_BETWEEN = re.compile(rf"(?<=[\d%])[\s.,/:{_PUNCTUATION}]+(?=[-−]?\d)")
_DROP = re.compile(rf"[\s{_PUNCTUATION}]+|(?<!\d)[.,/:]|[.,/:](?!\d)|(?<!\d)%|(?<=[^\W\d_])[-−]|[-−](?!\d)")
_CHAT = re.compile(r"\A(.*?)\n" + r"\n".join(r"\s*[(\[]?" + x + r"\s*[.):\]\-–—/]+(.*?)" for x in "ABCD") + r"\Z", re.S)
_ASKED = re.compile(r"\A\s*câu\s+hỏi\s*:", re.I)


def _apart(m: re.Match) -> str:
    """A separator right between two digits belongs to their number; anything else keeps two numbers apart."""
    return m[0] if m[0] in (".", ",", "/", ":") and m.string[m.start() - 1] != "%" and m.string[m.end()] not in "-−" else "\u0001"


def canonical(text: str) -> str:
    """Text without case, white space and punctuation; signs and separators of numbers stay.

    A point, comma, slash or colon belongs to a number if digits stand right before and
    behind it, a percent sign if a number stands before it, a minus if a number follows and
    no letter stands before it. Neighbouring numbers stay apart, whatever stands between
    them: '1, 2' is '1 2' and neither '1,2' nor '12'.
    """
    t = text.lower()
    if "-" in t or "−" in t:
        t = _MINUS.sub(r"\1", t)
    if "%" in t:
        t = _PERCENT.sub("%", t)
    return _DROP.sub("", _BETWEEN.sub(_apart, t))


def letter(answer: str | None) -> str | None:
    """Answer letter A to D out of its spellings ('c', ' C.', '(C)'); None for anything else."""
    t = re.sub(r"[\W_]+", "", answer or "").upper()
    return t if t in ("A", "B", "C", "D") else None


def chat_parts(content: str | None) -> tuple[str, list[str]] | None:
    """Question and four choices of a rendered multiple-choice prompt; None where a label is missing.

    The question may span lines; labels A to D start lines, in order, followed by
    punctuation.
    """
    m = _CHAT.match(content or "")
    return (_ASKED.sub("", m[1]), [m[2], m[3], m[4], m[5]]) if m else None


def canonical_record(question: str | None, choices: list[str | None], answer: str | None) -> str | None:
    """One text per record: question, choices in any order, and the text of the right choice.

    None if the question, a choice or the answer is missing or without letters and digits.
    """
    right = letter(answer)
    if right is None or question is None or None in choices or len(choices) != 4:
        return None
    q, c = canonical(question), [canonical(x) for x in choices]
    if not q or not all(c):
        return None
    return "\u0002".join([q, "\u0003".join(sorted(c)), c["ABCD".index(right)]])


def from_columns(question: Column, choices: list[Column], answer: Column) -> Column:
    """canonical_record of columns, Arrow-batched."""

    @F.pandas_udf("string")
    def record(q: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([canonical_record(x[0], list(x[1:5]), x[5]) for x in zip(q, a, b, c, d, answers)], dtype=object)

    return record(question, *choices, answer)


def from_chat(content: Column, answer: Column) -> Column:
    """canonical_record of rendered prompts."""

    @F.pandas_udf("string")
    def record(contents: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([canonical_record(*parts, a) if (parts := chat_parts(t)) else None for t, a in zip(contents, answers)], dtype=object)

    return record(content, answer)


def _positions(h: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    a = h.view(np.uint64)
    b = (a >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(n)]


def _pack(positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(positions, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64))


def repeated_positions(hashes: DataFrame, cfg: BloomConfig, bits: int) -> DataFrame:
    """block, bits: filter of what is seen more than once, as packed positions per block.

    hashes: h (bigint). Each partition builds its two filters and sends them sparsely;
    a task merges one block after another, holding two bitmaps of block_bits.
    """

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for part in _ended(parts):
            if part is not None:
                held.append(part["h"].to_numpy(np.int64))
                size += len(held[-1])
            if held and (part is None or size > 2_000_000):
                # a record sets each of its bits once, even if two of its hashes agree
                rows = np.sort(np.stack(_positions(np.concatenate(held), cfg.hashes, bits), axis=1), axis=1)
                first = np.ones(rows.shape, bool)
                first[:, 1:] = rows[:, 1:] != rows[:, :-1]
                at, n = np.unique(rows[first], return_counts=True)
                held, size = [], 0
                block = at // cfg.block_bits
                cuts = np.flatnonzero(np.diff(block)) + 1
                out = []
                for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
                    local = at[a:b] - block[a] * cfg.block_bits
                    out.append((int(block[a]), _pack(local), _pack(local[n[a:b] > 1])))
                yield pd.DataFrame(out, columns=["block", "once", "twice"])

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, once, twice = None, None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame([(now, _pack(np.flatnonzero(twice)))], columns=["block", "bits"])

        for part in parts:
            for block, a, b in part.itertuples(index=False):
                if block != now:
                    if now is not None:
                        yield done()
                    now, once, twice = block, np.zeros(cfg.block_bits, bool), np.zeros(cfg.block_bits, bool)
                seen = _unpack(a)
                twice[seen[once[seen]]] = True
                twice[_unpack(b)] = True
                once[seen] = True
        if now is not None:
            yield done()

    built = hashes.mapInPandas(build, "block int, once binary, twice binary")
    return built.repartition("block").sortWithinPartitions("block").mapInPandas(merge, "block int, bits binary")


def _ended(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from parts
    yield None


def _position(k: int, cfg: BloomConfig, bits: int):
    """UDF: place in the filter of a hash's k-th bit."""

    @F.pandas_udf("bigint")
    def position(h: pd.Series) -> pd.Series:
        return pd.Series(_positions(h.to_numpy(np.int64), cfg.hashes, bits)[k])

    return position


#: Bits up to which the filter is sent to every executor, unpacked (32 MB).
DENSE_BITS = 1 << 28


def marked(rows: DataFrame, cfg: BloomConfig = BloomConfig(), n: int | None = None) -> DataFrame:
    """rows (with a bigint column h) and a boolean column maybe: false only if no other row has their h.

    The filter is sent to the executors while its bits, unpacked, are at most DENSE_BITS.
    Beyond, its filled positions are joined with the distinct hashes, of which the map
    side sends each once; only the hashes that are left meet the rows again.
    """
    n = rows.count() if n is None else n
    bits = max(1024, n * cfg.bits_per_record)
    merged = materialize(repeated_positions(rows.select("h"), cfg, bits), "bloom")
    if bits <= DENSE_BITS:
        filled = np.zeros(bits // 8 + 1, np.uint8)
        for block, data in merged.toLocalIterator():
            at = _unpack(data) + block * cfg.block_bits
            np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))
        shared = rows.sparkSession.sparkContext.broadcast(filled)

        @F.pandas_udf("boolean")
        def repeated(h: pd.Series) -> pd.Series:
            ok = np.ones(len(h), bool)
            for at in _positions(h.to_numpy(np.int64), cfg.hashes, bits):
                ok &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            return pd.Series(ok)

        return rows.withColumn("maybe", repeated("h"))

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for block, data in part.itertuples(index=False):
                yield pd.DataFrame({"at": _unpack(data) + block * cfg.block_bits})

    filled = merged.mapInPandas(unpack, "at bigint")
    left = rows.select("h").distinct()
    for k in range(cfg.hashes):
        left = left.withColumn("at", _position(k, cfg, bits)("h")).join(filled, "at", "left_semi").drop("at")
    left = materialize(left.select(F.col("h").alias("_h"), F.lit(True).alias("_maybe")), "repeated-hashes")
    return rows.join(broadcast_if_small(left), F.col("h") == F.col("_h"), "left").withColumn("maybe", F.coalesce("_maybe", F.lit(False))).drop("_h", "_maybe")


def copies_of(records: DataFrame, cfg: BloomConfig = BloomConfig()) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of records: id (bigint), canonical (string).

    groups: first_id, copies, of each distinct record, singles included. members: first_id,
    id, of each further copy. Records whose canonical text is null are single, each its own
    group. Rows with the same id are separate records: of a group whose smallest id comes
    several times, the further ones are members too. Empty input gives empty results.

    Records that the filter tells to be single leave without being shuffled or compared.
    """
    thin = materialize(records.select("id", "canonical", F.xxhash64("canonical").alias("h")), "canonical")
    known = thin.filter("canonical is not null")
    told = marked(known, cfg)
    repeats = materialize(told.filter("maybe").drop("maybe"), "repeats")
    groups = materialize(repeats.groupBy("canonical").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")), "groups")
    # a group may hold a third of all rows: its rows are salted, the groups sent to each salt
    several = groups.filter("copies > 1").select("canonical", "first_id")
    if rows_of(groups) <= BROADCAST_ROWS // 10:
        joined = repeats.join(F.broadcast(several), "canonical")
    else:
        joined = salted_join(several, repeats, "canonical", "id", rows_of(repeats))
    further = joined.filter("id <> first_id").select("first_id", "id")
    again = joined.filter("id = first_id").groupBy("h", "first_id").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    again = again.select("first_id", F.explode(F.expr("array_repeat(first_id, n - 1)")).alias("id"))
    single = told.filter("not maybe").select("id").unionByName(thin.filter("canonical is null").select("id")).select(F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("copies"))
    return groups.select("first_id", "copies").unionByName(single), further.unionByName(again)
