"""Evaluation items inside training documents, found by winnowing.

Every k-gram of tokens in search form is hashed; of each window of w neighbouring
hashes the smallest is kept. Two texts that share k + w - 1 tokens in a row keep at least
one fingerprint in common, so no such span is missed. Document fingerprints are joined
with those of the items, and hits are extended to the stretch they belong to.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import TokenHashes, key_tokens, raw_tokens
from quern.operators.materialize import materialize, rows_of, salted_join

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


#: Documents whose tokens are held at a time.
BATCH = 500


@dataclass(frozen=True)
class LeakConfig:
    """k, window: of the winnowing. share: least share of the question in one stretch. kept:
    share of the fingerprints of such a stretch, and of a choice, that a few changed words
    leave; kept_choices: of the four choices together. index_rows: items with more tokens
    than this, those of their choices included, are joined by shuffle instead of broadcast
    (an index of so many takes about 30 MB).
    """

    k: int = 3
    window: int = 2
    share: float = 0.5
    kept: float = 0.4
    kept_choices: float = 0.7
    index_rows: int = 200_000


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a token hash array; of the whole, if it is shorter."""
    n = len(tokens)
    k = min(k, n)
    if not k:
        return np.empty(0, np.uint64)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out ^ tokens[i : n - k + 1 + i]) * _M1
        out ^= out >> np.uint64(29)
    return out * _M2 ^ (out >> np.uint64(32)) * _M3


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the kept hashes: the rightmost smallest of each window; all, if there are fewer than window."""
    n = len(hashes)
    if n < window:
        return np.arange(n)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - views.argmin(axis=1))


class Batch:
    """Token hashes of several documents in one array."""

    def __init__(self, texts: Iterable[str | None], token_hash: TokenHashes):
        parts = [token_hash.of(t) for t in texts]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(parts)), self.size)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position) of the k-grams that lie within a document."""
        if len(self.tokens) < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :])
        return gram_hashes(self.tokens, k)[at], at

    def winnowed(self, h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
        """Indices of the grams that winnowing keeps: the rightmost smallest of each window; all of a document with fewer."""
        doc = self.doc[at]
        keep = np.zeros(len(h), bool)
        if len(h) >= window:
            starts = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
            low, best = h[starts], starts.copy()
            for i in range(1, window):
                less = h[starts + i] <= low
                low, best = np.where(less, h[starts + i], low), np.where(less, starts + i, best)
            keep[best] = True
        few = np.bincount(doc, minlength=len(self.size)) < window
        return np.flatnonzero(keep | few[doc])


    def prints(self, cfg: LeakConfig, short: Iterable[int], may: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash, position) of the winnowed k-grams, and of all grams of each short length; of these only what may, by its top bits, be looked for."""
        h, at = self.grams(cfg.k)
        kept = self.winnowed(h, at, cfg.window)
        yield h[kept], at[kept]
        for n in short:
            one, place = (h, at) if n == cfg.k else self.grams(n)
            if may is not None:
                some = np.flatnonzero(may[one >> np.uint64(44)])
                one, place = one[some], place[some]
            yield one, place


class Item:
    """One evaluation item in search form."""

    def __init__(self, question: str | None, choices: dict | None, token_hash: TokenHashes):
        q = question or ""
        self.tokens = token_hash.of(q).tolist()
        self.keys = key_tokens(q)
        grams = gram_hashes(np.array(self.tokens, np.uint64), 3)
        keyed = np.array([not self.keys or any(k in self.keys for k in range(n, n + 3)) for n in range(len(grams))], bool)
        self.place = np.argsort(grams, kind="stable")
        self.grams, self.keyed = grams[self.place], keyed[self.place]
        self.is_key = np.isin(np.arange(len(self.tokens) + 2), list(self.keys))
        texts = [v for v in (choices or {}).values() if v and raw_tokens(v)]
        self.choices = [token_hash.of(v).tolist() for v in texts]
        self.choice_keys = [key_tokens(v) for v in texts]
        if len(self.choices) != 4:
            self.choices = []

    def fingerprints(self, cfg: LeakConfig) -> Iterator[tuple[int, int]]:
        """(hash, part) with part 0 for the question and 1 to 4 for the choices."""
        for part, tokens in enumerate([self.tokens, *self.choices]):
            h = gram_hashes(np.array(tokens, np.uint64), cfg.k)
            for p in winnow(h, cfg.window):
                yield int(h[p]), part

    def short(self, cfg: LeakConfig) -> set[int]:
        """Lengths of its parts that are shorter than what winnowing guarantees to keep a fingerprint of: they are looked for whole, at every place."""
        return {n for n in (len(self.tokens), *map(len, self.choices)) if 0 < n < cfg.k + cfg.window - 1}

    def least(self, cfg: LeakConfig) -> float:
        """Number of fingerprints of the question that a stretch of share of it has wherever it stands, less those that changed words cost; 1 at least."""
        h = gram_hashes(np.array(self.tokens, np.uint64), cfg.k)
        # what a stretch keeps whatever stands around it: the smallest of each window that lies within
        low = [int(h[p : p + cfg.window].min()) for p in range(len(h) - cfg.window + 1)]
        n = max(1, math.ceil(cfg.share * len(self.tokens)) - cfg.k - cfg.window + 2)
        return max(1.0, cfg.kept * min((len(set(low[p : p + n])) for p in range(max(1, len(low) - n + 1))), default=0))


class ItemIndex:
    """Sorted fingerprints of the items, for lookups of many hashes at once."""

    def __init__(self, rows: list[tuple[int, str | None, dict | None]], cfg: LeakConfig):
        self.cfg, th = cfg, TokenHashes()
        self.ids = [r[0] for r in rows]
        self.items = [Item(r[1], r[2], th) for r in rows]
        prints = sorted({(h, i, part) for i, item in enumerate(self.items) for h, part in item.fingerprints(cfg)})
        self.hash = np.array([p[0] for p in prints], np.uint64)
        self.slot = np.array([p[1] * 5 + p[2] for p in prints], np.int64)
        self.least = np.array([item.least(cfg) for item in self.items])
        self.size = np.bincount(self.slot, minlength=5 * len(self.items))
        self.distinct = np.unique(self.hash)
        gram = np.concatenate([item.grams for item in self.items] or [np.empty(0, np.uint64)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner = gram[order], np.repeat(np.arange(len(self.items)), [len(item.grams) for item in self.items])[order]
        self.place, self.keyed = (np.concatenate([getattr(item, x) for item in self.items] or [np.empty(0, np.int64)])[order] for x in ("place", "keyed"))
        self.need = np.array([cfg.share * len(item.tokens) - 1 for item in self.items])
        self.may_gram = np.zeros(1 << 20, bool)
        self.may_gram[self.gram >> np.uint64(44)] = True
        self.may = np.zeros(1 << 20, bool)  # by the top bits, to pass over most hashes cheaply
        self.may[self.distinct >> np.uint64(44)] = True
        self.first = np.searchsorted(self.hash, self.distinct, "left")
        self.last = np.searchsorted(self.hash, self.distinct, "right")
        self.short = sorted({n for item in self.items for n in item.short(cfg)})
        self.may_short = np.zeros(1 << 20, bool)
        for item in self.items:
            for tokens in (item.tokens, *item.choices):
                if len(tokens) in self.short:
                    self.may_short[gram_hashes(np.array(tokens, np.uint64), cfg.k) >> np.uint64(44)] = True
        self.whole = np.array([0 < len(item.tokens) < cfg.k + cfg.window - 1 for item in self.items], bool)

    def candidates(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Rows (document, item) whose question, and rows whose choices, may stand in the document.

        Question: the least number of fingerprints that a stretch of share of it keeps, with
        or without a name or number in them, since winnowing may keep none that has one.
        Choices: such a number of each of the four.
        """
        none = np.empty((0, 2), np.int64)
        if not len(self.distinct) or not len(batch.tokens):
            return none, none
        hashes, docs = [], []
        for h, at in batch.prints(self.cfg, self.short, self.may_short):
            hashes.append(h)
            docs.append(batch.doc[at])
        found, doc = np.concatenate(hashes), np.concatenate(docs)
        may = np.flatnonzero(self.may[found >> np.uint64(44)])
        found, doc = found[may], doc[may]
        at = np.searchsorted(self.distinct, found)
        at[at == len(self.distinct)] = 0
        hit = self.distinct[at] == found
        one = np.unique(doc[hit] * len(self.distinct) + at[hit])
        doc, at = one // len(self.distinct), one % len(self.distinct)
        if not len(at):
            return none, none
        first, n = self.first[at], self.last[at] - self.first[at]
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        slots = len(self.size)
        pair, count = np.unique(np.repeat(doc, n) * slots + self.slot[rows], return_counts=True)
        share, part = count / self.size[pair % slots], pair % slots % 5
        asked = pair[part == 0] // 5
        asked = asked[count[part == 0] >= self.least[asked % (slots // 5)]]
        brief = self.whole[asked % (slots // 5)]
        asked = np.sort(np.concatenate([asked[brief], self._in_step(asked[~brief], batch)]))
        chosen, who = (part > 0) & (share >= self.cfg.kept), pair // 5
        ids, of = np.unique(who[chosen], return_inverse=True)
        all4 = ids[(np.bincount(of, minlength=len(ids)) == 4) & (np.bincount(of, share[chosen], minlength=len(ids)) >= 4 * self.cfg.kept_choices)] if len(ids) else ids
        return tuple(np.stack([x // (slots // 5), x % (slots // 5)], axis=1) for x in (asked, all4))


    def _in_step(self, pairs: np.ndarray, batch: Batch) -> np.ndarray:
        """Of the (document, item) pairs, those that have a part as _regions wants it, but for its share of names and numbers."""
        h, at = batch.grams(3)
        may = np.flatnonzero(self.may_gram[h >> np.uint64(44)])
        h, at = h[may], at[may]
        lo, hi = np.searchsorted(self.gram, h, "left"), np.searchsorted(self.gram, h, "right")
        n = hi - lo
        if not len(pairs) or not n.sum():
            return pairs[:0]
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair = np.repeat(batch.doc[at], n) * len(self.items) + self.owner[rows]
        own = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        ok = np.flatnonzero(pairs[own] == pair)
        own, shift, rows = own[ok], np.repeat(at, n)[ok] - self.place[rows[ok]], rows[ok]
        order = np.lexsort((shift, own))
        own, shift, rows = own[order], shift[order], rows[order]
        if not len(own):
            return pairs[:0]
        cuts = np.r_[0, np.flatnonzero((np.diff(own) != 0) | (np.diff(shift) > 3)) + 1]
        count, place = np.diff(np.r_[cuts, len(own)]), self.place[rows]
        span = np.maximum.reduceat(place, cuts) - np.minimum.reduceat(place, cuts) + 3
        need = self.need[pairs[own[cuts]] % len(self.items)]
        fit = (count >= 0.3 * need) & (span >= need - 2) & np.logical_or.reduceat(self.keyed[rows], cuts)
        return pairs[np.unique(own[cuts][fit])]


def _clusters(at: np.ndarray, gap: int) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(at) > gap) + 1
    return [(int(c[0]), int(c[-1])) for c in np.split(at, cuts)]


def _regions(item: Item, grams: np.ndarray, need: float) -> Iterator[tuple[int, int]]:
    """Parts of a document whose grams meet the question's grams nearly in step, a name or number among them."""
    lo, hi = np.searchsorted(item.grams, grams, "left"), np.searchsorted(item.grams, grams, "right")
    n = hi - lo
    at = np.repeat(np.arange(len(grams)), n)
    if not len(at):
        return
    rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    shift = at - item.place[rows]
    order = np.lexsort((at, shift))
    at, shift, keyed, place = at[order], shift[order], item.keyed[rows][order], item.place[rows][order]
    for a, b in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(at)]))(np.flatnonzero(np.diff(shift) > 3) + 1)):
        if b - a < max(1, 0.3 * need) or not keyed[a:b].any():
            continue
        met = np.zeros(len(item.is_key), bool)
        for i in range(3):
            met[np.minimum(place[a:b] + i, len(met) - 1)] = True
        span = item.is_key[place[a:b].min() : place[a:b].max() + 3]
        # most names and numbers of the stretch must be there; a question of the same pattern has others
        if len(span) >= need - 2 and (item.is_key & met).sum() >= 0.6 * span.sum():
            for start, end in _clusters(np.sort(at[a:b]), 8):
                if end - start + 3 >= need - 2:
                    yield start, end


def _replaced(item: Item, doc: list[int], i: int, j: int, step: int, span: int) -> bool:
    """Whether the text goes on beside item position i, document position j, with another name or number in the item's place."""
    n = len(item.tokens)
    far = i
    while 0 <= far < n and far in item.keys:
        far += step
    if far == i:
        return False
    if not 0 <= far < n:
        # or the stretch holds only a part of the name
        return span >= 0.75 * n or (0 <= j < len(doc) and i - step in item.keys)
    # the name there may be a syllable longer or shorter, or partly the same
    return any(0 <= p < len(doc) and doc[p] == item.tokens[far] for p in range(j, j + (far - i) + 2 * step, step))


def question_leaks(item: Item, doc: list[int], grams: np.ndarray, share: float) -> bool:
    """Whether one stretch of the document reproduces enough of the question, its names and numbers included."""
    n = len(item.tokens)
    if n < 4:
        # too short to be known by a part of it: it has to be there as a whole; a single word is no more than a mention
        return n > 1 and len(doc) >= n and bool((gram_hashes(np.array(doc, np.uint64), n) == gram_hashes(np.array(item.tokens, np.uint64), n)).any())
    need = share * n - 1
    for lo, hi in _regions(item, grams, need):
        start = max(0, lo - 4)
        part = doc[start : hi + 8]
        blocks = [b for b in SequenceMatcher(None, item.tokens, part, False).get_matching_blocks() if b.size]
        runs: list[list] = []
        for b in blocks:
            if runs:
                last = runs[-1][-1]
                lost = range(last.a + last.size, b.a)
                if len(lost) <= 4 and b.b - last.b - last.size <= 6 and not item.keys.intersection(lost):
                    runs[-1].append(b)
                    continue
            runs.append([b])
        for run in runs:
            i0, i1 = run[0].a, run[-1].a + run[-1].size
            j0, j1 = run[0].b + start, run[-1].b + run[-1].size + start
            matched = sum(b.size for b in run)
            if i1 - i0 < need or matched < 0.7 * (i1 - i0):
                continue
            if item.keys and not any(k for k in item.keys if i0 <= k < i1):
                continue
            if _replaced(item, doc, i1, j1, 1, i1 - i0) or _replaced(item, doc, i0 - 1, j0 - 1, -1, i1 - i0):
                continue
            return True
    return False


def _places(choice: list[int], keys: set[int], doc: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Where a choice stands in doc[low:high]: letter for letter, or with a few changed words if it is long."""
    part = doc[low:high]
    n = len(choice)
    at = np.flatnonzero(part == np.uint64(choice[0])) if n == 1 else np.flatnonzero(gram_hashes(part, n) == gram_hashes(np.array(choice, np.uint64), n)[0]) if len(part) >= n else np.empty(0, int)
    out = [(low + int(a), low + int(a) + n) for a in at]
    if not out and n >= 5:
        blocks = [b for b in SequenceMatcher(None, choice, part.tolist(), False).get_matching_blocks() if b.size]
        hit = {i for b in blocks for i in range(b.a, b.a + b.size)}
        if blocks and len(hit) >= 0.7 * n and keys <= hit and blocks[-1].b + blocks[-1].size - blocks[0].b <= n + 3:
            out = [(low + blocks[0].b, low + blocks[-1].b + blocks[-1].size)]
    return out


def choices_leak(item: Item, doc: np.ndarray, kept: float) -> bool:
    """Whether all four choices stand side by side, in any order."""
    if not item.choices:
        return False
    total = sum(map(len, item.choices))
    near, least = [], []
    for tokens in item.choices:
        own = np.unique(gram_hashes(np.array(tokens, np.uint64), 3))
        near.append(np.flatnonzero(np.isin(gram_hashes(doc, min(3, len(tokens))), own)))
        least.append(kept * len(own))
        if len(near[-1]) < least[-1]:
            return False
    # regions where enough of each choice stands close together
    first = min(range(4), key=lambda c: len(near[c]))
    for lo, hi in _clusters(near[first], len(item.choices[first]) + 3):
        low, high = max(0, lo - total - 16), min(len(doc), hi + total + 16)
        within = [np.searchsorted(a, high) - np.searchsorted(a, low) for a in near]
        if any(n < m for n, m in zip(within, least)) or sum(within) < 1.5 * sum(least):
            continue
        spots = []
        for c, k in zip(item.choices, item.choice_keys):
            spots.append(_places(c, k, doc, low, high))
            if not spots[-1]:
                break
        if len(spots) < 4 or not spots[-1]:
            continue
        # each choice's place nearest to the anchor; apart from each other; close together
        for first in spots[0]:
            used = [first]
            for s in spots[1:]:
                free = [p for p in s if all(p[1] <= u[0] or p[0] >= u[1] for u in used)]
                if not free:
                    break
                used.append(min(free, key=lambda p: min(max(p[0] - u[1], u[0] - p[1]) for u in used)))
            if len(used) == 4:
                used.sort()
                if all(b[0] - a[1] <= 5 for a, b in zip(used, used[1:])):
                    return True
    return False


def batch_leaks(texts: Iterable[str | None], index: ItemIndex, token_hash: TokenHashes) -> list[tuple[int, int, str]]:
    """(row of the text, item id, how) of the items that documents leak; how is question or choices. None and blank texts leak none."""
    batch = Batch(texts, token_hash)
    asked, offered = index.candidates(batch)
    out: dict[tuple[int, int], str] = {}
    now, doc, grams = -1, [], None
    for d, i in asked.tolist():
        if d != now:
            arr = batch.tokens[batch.start[d] : batch.start[d + 1]]
            now, doc, grams = d, arr.tolist(), gram_hashes(arr, 3)
        if question_leaks(index.items[i], doc, grams, index.cfg.share):
            out[d, i] = "question"
    for d, i in offered.tolist():
        if (d, i) not in out and choices_leak(index.items[i], batch.tokens[batch.start[d] : batch.start[d + 1]], index.cfg.kept):
            out[d, i] = "choices"
    return [(d, index.ids[i], how) for (d, i), how in sorted(out.items())]


#: Bits of the map of item fingerprints that document fingerprints are held against before they are shuffled (8 MB).
MAP_BITS = 1 << 26


def _prints(rows: Iterator[pd.DataFrame], cfg: LeakConfig, short: list[int], seen: np.ndarray) -> Iterator[pd.DataFrame]:
    """doc_id, print of the document fingerprints that an item may have."""
    th, mask = TokenHashes(), np.uint64(MAP_BITS - 1)
    for whole in rows:
        for first in range(0, len(whole), BATCH):
            part = whole.iloc[first : first + BATCH]
            batch, ids = Batch(part["text"], th), part["doc_id"].to_numpy()
            for h, at in batch.prints(cfg, short):
                low = h & mask
                may = (seen[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)
                yield pd.DataFrame({"doc_id": ids[batch.doc[at[may]]], "print": h[may].view(np.int64)}).drop_duplicates()


def find_leaks(documents: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, how: the documents that reproduce evaluation items.

    documents: doc_id, text. items: item_id, question, choices (map or null). Other columns
    are ignored. Null, empty and blank texts leak nothing; an item with null or empty
    question can leak by its choices only, one without four choices by its question only.
    A question of two or three words leaks where it stands as a whole, one of a single word
    never. Repeated documents and repeated items each get their rows. Empty tables give no
    rows.

    The items are an index of bounded size (index_rows): it is sent to every executor, and
    documents are scanned once, without a shuffle. Beyond the bound, fingerprints of
    documents that an item may have are joined with those of the items by shuffle, seeds
    are counted per pair, and only the candidate pairs meet their texts again.
    """
    docs = documents.select("doc_id", "text")
    own = items.select("item_id", "question", "choices")
    # by their lengths first: not more than a driver can hold are collected
    chars = F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.aggregate(F.map_values("choices"), F.lit(0), lambda n, x: n + F.coalesce(F.length(x), F.lit(0))), F.lit(0))
    size = own.select(F.coalesce(F.sum(chars + 1), F.lit(0)).alias("n")).first()["n"]
    if size <= 8 * cfg.index_rows:
        head = own.collect()
        words = sum(len(raw_tokens(x)) for r in head for x in (r["question"], *(r["choices"] or {}).values()) if x)
        if words <= cfg.index_rows:
            return _find_by_scan(docs, ItemIndex([(r["item_id"], r["question"], r["choices"]) for r in head], cfg))
    return _find_by_shuffle(docs, own, cfg)


def _find_by_scan(docs: DataFrame, index: ItemIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = TokenHashes()
        for whole in parts:
            for at in range(0, len(whole), BATCH):
                part = whole.iloc[at : at + BATCH]
                ids = part["doc_id"].to_numpy()
                yield pd.DataFrame([(ids[d], i, how) for d, i, how in batch_leaks(part["text"], shared.value, th)], columns=["doc_id", "item_id", "how"])

    return docs.mapInPandas(scan, "doc_id bigint, item_id bigint, how string")


def _find_by_shuffle(docs: DataFrame, items: DataFrame, cfg: LeakConfig) -> DataFrame:
    """find_leaks for item tables of any size."""

    def item_prints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = TokenHashes()
        for part in parts:
            out = []
            for i, q, c in zip(part["item_id"], part["question"], part["choices"]):
                item = Item(q, dict(c) if c is not None else None, th)
                prints, least = set(item.fingerprints(cfg)), item.least(cfg)
                size, short = Counter(p for _, p in prints), sorted(item.short(cfg))
                out += [(i, int(np.uint64(h).view(np.int64)), p, size[p], least if p == 0 else cfg.kept * size[p], short) for h, p in prints]
            yield pd.DataFrame(out, columns=["item_id", "print", "part", "size", "least", "short"])

    prints = materialize(items.mapInPandas(item_prints, "item_id bigint, print bigint, part int, size int, least double, short array<int>"), "item-prints")
    short = sorted(r["n"] for r in prints.select(F.explode("short").alias("n")).distinct().collect())  # at most k + window - 2 lengths
    low = F.col("print").bitwiseAND(F.lit(MAP_BITS - 1))
    words = prints.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(print & 63 as int))")).alias("bits"))
    seen = np.zeros(MAP_BITS // 64, np.uint64)
    for r in words.toLocalIterator():
        seen[r["at"]] = np.uint64(r["bits"] % (1 << 64))
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    doc_prints = docs.mapInPandas(lambda parts: _prints(parts, cfg, short, shared.value), "doc_id bigint, print bigint")
    own = prints.select("item_id", "print", "part", "size", "least")
    # per part of an item first, so that only counts are shuffled on; rows of a frequent fingerprint are salted
    hits = salted_join(doc_prints, own, "print", "item_id", rows_of(prints), chunk=1000).groupBy("doc_id", "item_id", "part").agg(F.countDistinct("print").alias("n"), F.first("size").alias("size"), F.first("least").alias("least"))
    hits = hits.withColumn("left", F.col("n") / F.col("size")).withColumn("ok", F.col("n") >= F.col("least"))
    pairs = (
        hits.groupBy("doc_id", "item_id")
        .agg(F.max((F.col("part") == 0) & F.col("ok")).alias("asked"), F.count(F.when((F.col("part") > 0) & F.col("ok"), 1)).alias("offered"), F.sum(F.when(F.col("part") > 0, F.col("left"))).alias("left"))
        .filter(f"asked or (offered = 4 and left >= {4 * cfg.kept_choices})")
        .select("doc_id", "item_id")
    )
    joined = materialize(pairs, "pairs").join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "question", "choices")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = TokenHashes()
        for whole in parts:
            for at in range(0, len(whole), BATCH):
                rows = list(whole.iloc[at : at + BATCH].itertuples(index=False))
                # one index of the batch's items and one scan of its texts; of what they find, only its own pairs count
                known: dict[tuple, int] = {}
                own = [known.setdefault((r.item_id, r.question, tuple(sorted(dict(r.choices or {}).items()))), len(known)) for r in rows]
                index = ItemIndex([(n, q, dict(c)) for (_, q, c), n in known.items()], cfg)
                found = {(d, n): how for d, n, how in batch_leaks([r.text for r in rows], index, th)}
                out = [(r.doc_id, r.item_id, found[d, n]) for d, (r, n) in enumerate(zip(rows, own)) if (d, n) in found]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "how"])

    return joined.mapInPandas(verify, "doc_id bigint, item_id bigint, how string")


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """benchmark, items, leaked_items, leaking_documents, pairs: what leaked, per benchmark; null benchmarks are one group."""
    named = items.select("item_id", "benchmark")
    per = leaks.join(named, "item_id").groupBy("benchmark").agg(F.countDistinct("item_id").alias("leaked_items"), F.countDistinct("doc_id").alias("leaking_documents"), F.count("*").alias("pairs"))
    sizes = named.groupBy("benchmark").agg(F.count("*").alias("items"))
    return sizes.join(per, sizes["benchmark"].eqNullSafe(per["benchmark"]), "left").select(sizes["benchmark"], "items", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leaked_items", "leaking_documents", "pairs")))
