"""Text forms shared by the operators: the visual form, the search form and its tokens.

The visual form maps texts that look the same to one string and keeps what a reader
can tell apart. The search form goes further: it drops case, accents, punctuation and
tags, for finding passages again that were changed on the way.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Һ": "H",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o",
    # Latin letters with a bar
    "Ð": "Đ", "Ɖ": "Đ",
}

#: Joiner and variation selectors stay beside pictographs, whose look they change.
_JOINERS = "‍︎️"
_PICTO = "←-⯿\U0001f000-\U0001faff"


@lru_cache(maxsize=1)
def visual_map() -> dict[int, str | None]:
    """Code point to replacement, made by rule from the character database."""
    out: dict[int, str | None] = {}
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c in _JOINERS:
            continue
        if kind == "Zs":
            out[cp] = " "
        elif kind == "Cf" and not 0x600 <= cp <= 0x8E2:
            out[cp] = None
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            out[cp] = unicodedata.normalize("NFKC", c)
        elif unicodedata.decomposition(c).startswith("<compat>") and kind[0] in "LN" and cp != 0x17F:
            # ligatures, letter pairs, Roman numerals: drawn as the letters they stand for; a long s isn't
            whole = unicodedata.normalize("NFKC", c)
            if all(unicodedata.category(x)[0] in "LM" for x in whole):
                out[cp] = whole
    for cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE0E), *range(0xE0000, 0xE01F0)):
        out[cp] = None
    out |= {ord(a): b for a, b in LOOKALIKES.items()}
    return out


_LOOSE_JOINER = re.compile(f"(?<![{_PICTO}{_JOINERS}])[{_JOINERS}]+|[{_JOINERS}]+$")


def visual_form(text: str | None, fold_case: bool = False, compatibility: bool = False) -> str | None:
    """One form for all texts that look the same; None stays None.

    Composed characters; full-width and half-width forms as the ordinary ones; every
    unusual space as one ordinary space; invisible characters gone; ligatures and Roman
    numerals as their letters; look-alike letters as the Latin ones. What a reader can tell
    apart is kept: raised and circled signs, fractions, letters of another style, ordinary
    white space, punctuation and letter case. With compatibility, these signs, fractions
    and styles are resolved too (compatibility normalisation, composed form); with
    fold_case, case is (full case folding).
    """
    if text is None:
        return None
    if compatibility:
        text = unicodedata.normalize("NFKC", text)
    t = unicodedata.normalize("NFD", text).translate(visual_map())
    if any(c in t for c in _JOINERS):
        t = _LOOSE_JOINER.sub("", t)
    t = unicodedata.normalize("NFC", t)
    if fold_case:
        t = t.casefold()
        t = unicodedata.normalize("NFKC" if compatibility else "NFC", t)
    return t


@lru_cache(maxsize=1)
def plain_class() -> str:
    """A character class, for Java and Python alike, of characters that visual_form never changes in any company."""
    kept, run = [], []
    for cp in (*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028), *range(0x2030, 0x205F)):
        c = chr(cp)
        if visual_form(c) == c and not unicodedata.combining(c):
            if run and run[-1] == cp - 1:
                run.append(cp)
            else:
                run = [cp]
                kept.append(run)
    return r"[\t\n\r" + "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in kept) + "]"


# Search form

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|<!--.*?-->", re.S)
_INLINE = frozenset("a abbr b big code em font i mark s small span strong sub sup u".split())
_ODD = re.compile(f"[^{plain_class()[1:]}")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")


def without_tags(text: str) -> str:
    """HTML tags and entities resolved: inline tags vanish, others become a space."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[2] and m[2].lower() in _INLINE else " ", text)
    return html.unescape(text) if "&" in text else text


def plain(text: str) -> str:
    """The text without tags and with odd characters made plain."""
    text = without_tags(text)
    return unicodedata.normalize("NFKC", visual_form(text)) if _ODD.search(text) else text


def raw_tokens(text: str) -> list[str]:
    """Words and numbers of a text as written, after tags are taken out and odd characters made plain.

    A number with its inner points and commas is one token.
    """
    return _TOKEN.findall(plain(text))


def fold(token: str) -> str:
    """A token without case and accents."""
    t = unicodedata.normalize("NFD", token.casefold())
    return "".join(c for c in t if not unicodedata.combining(c)).replace("đ", "d")


class TokenHashes:
    """Hashes of the folded tokens of texts, remembered per piece without white space; the memory is bounded by a clear."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.known = limit, {}

    def _learn(self, piece: str) -> bytes:
        if len(self.known) > self.limit:
            self.known.clear()
        h = self.known[piece] = b"".join(xxhash.xxh3_64_intdigest(fold(t)).to_bytes(8, "little") for t in _TOKEN.findall(piece))
        return h

    def packed(self, text: str | None) -> bytes:
        """Hashes of raw_tokens(text), folded, 8 bytes each; empty for None."""
        if not text:
            return b""
        pieces = plain(text).split()
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self._learn(p) if h is None else h for p, h in zip(pieces, found)]
        return b"".join(found)

    def of(self, text: str | None) -> np.ndarray:
        """packed as an array."""
        return np.frombuffer(self.packed(text), np.uint64)


def sentence_starts(text: str) -> set[int]:
    """Indices, among raw_tokens, of tokens that begin a sentence, a line or a quotation."""
    clean = plain(text)
    starts, before = set(), None
    for n, m in enumerate(_TOKEN.finditer(clean)):
        gap = clean[before : m.start()] if before is not None else "."
        if any(c in ".!?:;“”\"'\n(…)" for c in gap):
            starts.add(n)
        before = m.end()
    return starts


def key_tokens(text: str) -> set[int]:
    """Indices of the tokens that name something: numbers, and capitalised words that case marks as names.

    A capitalised word at the start of a sentence counts only if a capitalised word
    follows it. A text all in capitals, or all in small letters, has number keys only.
    """
    tokens = raw_tokens(text)
    digits = {n for n, t in enumerate(tokens) if t[0].isdigit()}
    words = [t for t in tokens if not t[0].isdigit()]
    upper = sum(t[0].isupper() and (len(t) == 1 or t[1:].isupper()) for t in words)
    if upper > 0.7 * max(1, len(words)):
        return digits
    starts, names = sentence_starts(text), set()
    capital = [t[0].isupper() for t in tokens]
    for n, t in enumerate(tokens):
        if capital[n] and (n not in starts or (n + 1 < len(tokens) and capital[n + 1] and n + 1 not in starts)):
            names.add(n)
    return digits | names
