"""Encoding texts with a public tokenizer.

A text is cut where the tokenizer's own pattern always cuts, and pieces met before are
looked up. A piece without such places is encoded in halves, and the halves are joined by
encoding a growing window around the join again until its first and last tokens agree with
both sides.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenizing pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENIZER_FOLDER = "/opt/tokenizers"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoder of a rank file; no special tokens, their strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("quern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER) -> str:
    return f"{folder}/{name}.tiktoken"


_SPACES = re.compile(r" \s")


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """Encodes texts; remembers pieces. long_run: pre-tokens of more characters are encoded in halves."""

    def __init__(self, path: str, long_run: int = 256, limit: int = 300_000):
        self.bpe, self.long_run, self.limit = encoder(path), long_run, limit
        self.known: dict[str, bytes] = {}
        self._long = re.compile(r"\S{%d}|\s{%d}" % (long_run, long_run))

    def packed(self, text: str) -> bytes:
        """Token ids of a text as 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if _SPACES.search(text):
            # white space in a row belongs to one piece; the others start at a single space
            pieces, now = [], first
            for p in rest:
                if not p or p[0].isspace():
                    now += " " + p
                else:
                    pieces.append(now)
                    now = p
            first, *rest = [*pieces, now]
        found = list(map(self.known.get, rest))
        if None in found:
            found = [self._learn(p) if t is None else t for p, t in zip(rest, found)]
        return _pack(self._encode(first)) + b"".join(found)

    def ids(self, text: str | None) -> list[int] | None:
        """Token ids; an empty list for an empty text, None for None."""
        return None if text is None else list(memoryview(self.packed(text)).cast("i"))

    def count(self, text: str | None) -> int:
        """Number of tokens; 0 for None."""
        return len(self.packed(text)) // 4 if text else 0

    def _learn(self, piece: str) -> bytes:
        ids = _pack(self._encode(" " + piece))
        if len(piece) <= 64:
            if len(self.known) > self.limit:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _encode(self, piece: str) -> list[int]:
        if len(piece) <= self.long_run or not self._long.search(piece):
            return self.bpe.encode_ordinary(piece)
        import regex

        return list(chain.from_iterable(self.by_halves(m[0]) for m in regex.finditer(PATTERN, piece)))

    def by_halves(self, run: str) -> list[int]:
        """Tokens of one pre-token, by a tree of halves."""
        if len(run) <= self.long_run:
            return self.bpe.encode_ordinary(run)
        half = len(run) // 2
        return self.join(self.by_halves(run[:half]), self.by_halves(run[half:]))

    def put(self, parts: list[list[int]]) -> list[int]:
        """Tokens of consecutive parts of one pre-token, joined two by two and level by level: each token is copied once per level."""
        while len(parts) > 1:
            parts = [self.join(*parts[n : n + 2]) if n + 1 < len(parts) else parts[n] for n in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the bytes of left and right together, both being the tokens of one side.

        The window grows by token on each side until encoding it again gives its first and
        last token unchanged; what lies outside then has the neighbours it was encoded with.
        """
        if not left or not right:
            return left or right
        a = b = 4
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.bpe.decode_bytes([*left[len(left) - a :], *right[:b]])
            try:
                again = self.bpe.encode_ordinary(window.decode())
            except UnicodeDecodeError:  # a token may end within a character
                again = None
                if a == len(left) and b == len(right):
                    raise
            if again is not None and (a == len(left) or again[0] == left[-a]) and (b == len(right) or again[-1] == right[b - 1]):
                return [*left[: len(left) - a], *again, *right[b:]]
            a, b = a * 2, b * 2


def encode(documents: DataFrame, path: str | None = None, long_text: int = 1_000_000) -> DataFrame:
    """doc_id, ids: every document's token ids, without special tokens.

    Null and empty texts give an empty list: every document has a list. Repeated doc_ids are separate rows.
    Texts of up to long_text characters are encoded where they are read. Longer ones are
    cut in parts that are encoded in parallel, cut where the pattern cuts if there is such a
    place, and put together by join otherwise.
    """
    path = path or rank_file()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                packed = [enc.packed(t or "") for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    docs = documents.select("doc_id", "text")
    short = docs.filter(f"text is null or length(text) <= {long_text}").mapInArrow(scan, "doc_id bigint, ids array<int>")
    return short.unionByName(_encode_long(docs.filter(f"length(text) > {long_text}"), path, long_text))


def parts_of(text: str, size: int) -> Iterator[tuple[bool, str]]:
    """(free, part): parts of about size characters; free if the pattern cuts before it, else it goes on with a run.

    No part ends in white space unless it has to: the pattern takes the last of several
    white space characters apart only if a word follows.
    """
    import regex

    held, n = [], 0
    for m in regex.finditer(PATTERN, text):
        run = m[0]
        if len(run) > size:
            if held:
                yield True, "".join(held)
            held, n = [], 0
            for at in range(0, len(run), size):
                yield at == 0, run[at : at + size]
            continue
        if n + len(run) > size and held and not held[-1][-1].isspace():
            yield True, "".join(held)
            held, n = [], 0
        held.append(run)
        n += len(run)
    if held:
        yield True, "".join(held)


def _encode_long(docs: DataFrame, path: str, size: int) -> DataFrame:
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, doc_id, text in part.itertuples(index=False):
                for n, (free, t) in enumerate(parts_of(text, size)):
                    yield pd.DataFrame([(key, doc_id, n, free, t)], columns=["key", "doc_id", "n", "free", "part"])

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(path)
        for part in parts:
            # a part that the pattern cuts before is a text of its own; what goes on with a run is encoded as a run
            yield part.assign(ids=[enc.ids(t) if free else enc.by_halves(t) for free, t in zip(part["free"], part["part"])])[["key", "doc_id", "n", "free", "ids"]]

    def put(part: pd.DataFrame) -> pd.DataFrame:
        enc = Encoder(path)
        rows = part.sort_values("n")
        runs: list[list[list[int]]] = []
        for free, ids in zip(rows["free"], rows["ids"]):
            if free or not runs:
                runs.append([])
            runs[-1].append(list(ids))
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "ids": [list(chain.from_iterable(enc.put(run) for run in runs))]})

    # repeated ids are kept apart by a key
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    cuts = keyed.mapInPandas(cut, "key bigint, doc_id bigint, n int, free boolean, part string").repartition("key", "n")
    coded = cuts.mapInPandas(scan, "key bigint, doc_id bigint, n int, free boolean, ids array<int>")
    return coded.groupBy("key").applyInPandas(put, "doc_id bigint, ids array<int>")
