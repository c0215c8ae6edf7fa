"""Statistics of each text that tell natural prose from lists, tables and junk.

Besides counts, the classes of a text's lines and characters and its function words are
compared with profiles by the Jensen-Shannon divergence; a text is of the kind whose
structural profile is nearest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
_BULLET = re.compile(r"^\s*(?:[-*+•–—·▪●◦‣]|\(?\d{1,4}[.)]|\(\d{1,4}\)|\(?[a-z][.)]|[ivxIVX]{1,4}[.)])\s+")
_CHOICE = re.compile(r"(?:^|\s)\(?[A-D][.):]\s")
_ENUM_CHOICE = re.compile(r"^\s*\(?[A-Da-d][.):]\s*\S")
_QUESTION = re.compile(r"^\s*(?:câu|bài|câu hỏi|question)?\s*\d{1,4}\s*[.):]|\?\s*$", re.I)
_SPEAKER = re.compile(r"^\s*[^\W\d_][\w ]{0,30}:\s")
_CELL_CUTS = ("\t", "|", ";", ",", "    ")  # the last: columns set off by spaces
_END = frozenset(".!?…。！？\"”»)'’:;")
_STOP = frozenset(".!?…。！？")
_SCRIPTS = re.compile(r"[Â-ï][\u0080-¿]")
_ODD = frozenset("�□¿ß¤¶§")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")

# Line profiles of natural prose, lists, tables and junk: shares of long sentences, short
# entries, rows of cells, and lines of symbols or random characters.
PROFILES = {
    "prose": (0.90, 0.06, 0.02, 0.02),
    "list": (0.08, 0.88, 0.02, 0.02),
    "table": (0.04, 0.06, 0.88, 0.02),
    "junk": (0.04, 0.04, 0.04, 0.88),
}

# Language profiles of prose: function words, per mille of all words, and shares of the
# character classes white space, letter, number, sign, sign of damage. Measured on the
# documents at sf0.01 that the line classes call prose, by their lang (vi 761, en 38).
LANGUAGES = {
    "vi": (
        {"và": 14.4, "các": 11.0, "được": 10.8, "ở": 10.5, "người": 9.7, "những": 9.0, "trong": 8.9, "khi": 8.8, "đến": 8.5, "năm": 7.0, "làng": 6.3, "của": 6.1, "lại": 5.9, "có": 5.7, "nước": 5.3, "còn": 5.2, "vẫn": 5.1, "sau": 5.1, "vì": 4.9, "nhiều": 4.9, "một": 4.7, "về": 4.5, "với": 4.5, "không": 4.3, "để": 3.9, "nhất": 3.8, "từ": 3.8, "theo": 3.6, "hai": 3.3, "cũng": 3.3, "mỗi": 3.2, "là": 3.2, "trên": 2.8, "nào": 2.8, "vào": 2.7, "ai": 2.7, "cho": 2.6, "ngày": 2.4, "giữa": 2.3, "ba": 1.9, "đó": 1.9, "hơn": 1.8, "thì": 1.7, "trước": 1.7, "như": 1.6, "dưới": 1.3, "ra": 1.3, "do": 1.0, "bao": 1.0, "mà": 0.9, "rất": 0.8, "bên": 0.8, "bởi": 0.8, "nhiêu": 0.7, "rồi": 0.3, "gì": 0.3, "này": 0.3, "nên": 0.2, "đang": 0.2, "đã": 0.2, "đây": 0.1, "sẽ": 0.1, "chỉ": 0.1},
        (0.2241, 0.7344, 0.0135, 0.0279, 0.0001),
    ),
    "en": (
        {"the": 101.7, "a": 37.1, "in": 22.4, "of": 20.9, "with": 17.9, "on": 12.0, "was": 11.6, "an": 7.2, "for": 6.7, "as": 6.2, "to": 4.2, "it": 4.2},
        (0.1808, 0.7829, 0.0171, 0.0191, 0.0001),
    ),
}
#: The same of the other kinds: share of function words, in any language, and character classes (61, 59 and 56 documents).
OTHERS = {
    "list": (0.055, (0.2227, 0.6225, 0.0685, 0.0862, 0.0001)),
    "table": (0.019, (0.2462, 0.4023, 0.2807, 0.0707, 0.0001)),
    "junk": (0.019, (0.1287, 0.4213, 0.1184, 0.2978, 0.0338)),
}
#: Weight of the divergences of function words and of characters beside that of the lines.
WORDS_WEIGHT = CHARS_WEIGHT = 0.25
PRIOR = 50


def divergence(p: Iterable[float], q: Iterable[float]) -> float:
    """Jensen-Shannon divergence in bits of two distributions over the same classes: 0 for equal ones, 1 for disjoint ones."""
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return max(0.0, total)


def _columns(line: str) -> dict[str, int]:
    return {c: line.strip(" |").count(c) + 1 if c != "    " else len(re.split(r" {3,}", line.strip())) for c in _CELL_CUTS if c in line}


def line_classes(text: str, signs: bool = True) -> list[float]:
    """Shares, by characters and by lines, of lines that read as sentences, as short entries, as rows of cells, as junk.

    Without signs, no line is looked at for too many of them.
    """
    if "<" in text:
        text = _TAGS.sub("", text)
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return [0.0, 0.0, 0.0, 0.0]
    # rows of cells: the same separator cuts most lines into the same number of short cells
    cells, best = set(), 0
    counts = [_columns(x) for x in lines]
    for cut in _CELL_CUTS:
        n = Counter(c.get(cut, 0) for c in counts if c.get(cut, 0) > 1)
        if not n:
            continue
        width, rows = n.most_common(1)[0]
        own = {k for k, c in enumerate(counts) if abs(c.get(cut, 0) - width) <= (1 if width > 3 else 0) and c.get(cut, 0) > 1}
        size = sum(len(lines[k]) for k in own) / max(1, len(own)) / width
        if rows >= 3 and len(own) > best and size <= (30 if cut != "," else 22):
            numbers = sum(any(ch.isdigit() for ch in lines[k]) for k in own)
            if cut not in ",;" or (numbers >= 0.5 * len(own) and (width > 2 or cut == ";")):
                cells, best = own, len(own)
    if best < 3 or best < 0.3 * len(lines):
        cells = set()
    # consecutive lines that break a sentence are one sentence
    weight, number = [0.0] * 4, [0] * 4
    answers = {k for k, x in enumerate(lines) if _ENUM_CHOICE.match(x)}
    asked = len(answers) >= 3 and len({lines[k].strip(" (")[0].upper() for k in answers}) >= 3
    bullets = [bool(_BULLET.match(x)) for x in lines]
    words = [len(x.split()) for x in lines]
    for k, x in enumerate(lines):
        n = len(x.strip())
        if signs and k not in cells and not any(c.isdigit() for c in x) and sum(c.isalpha() or c.isspace() for c in x) < 0.5 * len(x):
            kind = 3
        elif k in cells:
            kind = 2
        elif asked and (k in answers or _CHOICE.search(x) or _QUESTION.search(x)):
            kind = 0
        elif _SPEAKER.match(x) and words[k] >= 5:
            kind = 0
        elif words[k] <= 12 and (bullets[k] or not _continues(lines, words, k)):
            kind = 1
        else:
            kind = 0
        weight[kind] += n
        number[kind] += 1
    # half by characters, half by lines: a list stays one under a long first sentence, prose with a short list inside
    total = sum(weight) or 1.0
    return [(w / total + n / len(lines)) / 2 for w, n in zip(weight, number)]


def _continues(lines: list[str], words: list[int], k: int) -> bool:
    """Whether a short line is part of a sentence that is broken over lines, or a sentence of its own."""
    x = lines[k].strip()
    if x[-1] in _STOP and words[k] >= 5 and x[0].isupper() and not _BULLET.match(x):
        return True
    if k + 1 < len(lines):
        nxt = lines[k + 1].strip()
        if x[-1] not in _STOP and nxt[:1].islower() and words[k] >= 4:
            return True
    if k and x[:1].islower() and lines[k - 1].strip()[-1] not in _STOP and (words[k] >= 4 or x[-1] in _STOP) and words[k - 1] >= 4:
        return True
    return False


class _Remembered(dict):
    """Values of a function, bounded by a clear."""

    def __init__(self, f, limit: int = 200_000):
        self.f, self.limit = f, limit

    def __missing__(self, key):
        if len(self) > self.limit:
            self.clear()
        v = self[key] = self.f(key)
        return v


def _char_class(c: str) -> int:
    """0 white space, 1 letter, 2 digit or other number, 3 sign, 4 a sign that shows damage, 5 a letter that does."""
    if c in _ODD or "\x7f" <= c <= "\x9f":
        return 5 if c.isalnum() else 4
    if "\udc00" <= c <= "\udfff":  # second half of a character that its first half stands for
        return 0
    return 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isalnum() else 3


_CLASSES = np.array([_char_class(chr(c)) for c in range(0x10000)], np.uint8)


def char_counts(text: str) -> list[int]:
    """Numbers of characters by class."""
    return np.bincount(_CLASSES[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)], minlength=6).tolist()


def _word_class(w: str) -> int:
    """Bits: 1 letters and digits mixed, 2 hexadecimal digits, 4 no vowel, 8 capitals within, 16 hexadecimal letters."""
    digit, alpha, low = any(c.isdigit() for c in w), any(c.isalpha() for c in w), w.lower()
    hexed = len(w) in (2, 4, 6, 8) and bool(_HEX.match(w))
    plain = w.isascii() and w.isalpha() and len(w) > 3
    return (
        (digit and alpha)
        | hexed << 1
        | (plain and not set(low) & set("aeiouy")) << 2
        | (w.isalpha() and len(w) > 3 and not (w.islower() or w.isupper() or w.istitle())) << 3
        | (hexed and alpha) << 4
    )


_WORDS = _Remembered(_word_class)


def junk_share(text: str, words: list[str], chars: list[int]) -> float:
    """How far a text is nothing written to be read, from 0 to 1. chars: numbers of characters by class."""
    solid = sum(chars[1:])
    if not solid:
        return 1.0
    letters, digits = (chars[1] + chars[5]) / solid, chars[2] / solid
    symbols = 1 - letters - digits
    if chars[4] + chars[5] > 0.04 * len(text) or len(_SCRIPTS.findall(text)) > 0.02 * len(text):
        return 1.0
    score = min(1.0, symbols / 0.7) if symbols > 0.55 else 0.0
    if not words:
        return score
    n = len(words)
    kinds = Counter(map(_WORDS.__getitem__, words))
    having = lambda bit: sum(v for k, v in kinds.items() if k & bit) / n
    if having(1) > 0.3 or having(4) > 0.25 or having(8) > 0.4:
        return 1.0
    # dumps of bytes
    if n > 20 and having(2) > 0.8 and letters + digits > 0.9 and having(16):
        return 1.0
    # runs of characters without white space that no language writes
    if sum(len(w) for w in text.split() if len(w) > 40 and "/" not in w[:8]) > 0.5 * solid and max(map(len, words)) >= 15:
        return 1.0
    # the same words over and over
    if n >= 20 and len(set(words)) < 0.25 * n:
        distinct = len(set(zip(words, words[1:], words[2:]))) / (n - 2)
        if distinct < 0.25:
            score = max(score, 1.0 if distinct < 0.2 else 0.7)
    return score


class Languages:
    """Function-word distributions of the languages of a word list, for divergences of texts from them.

    words: word to language. A word without a measured frequency has the mean one of its
    language, or of all languages if none of its words is measured.
    """

    def __init__(self, words: Iterable[tuple[str, str]]):
        rates: dict[str, dict[str, float]] = {}
        whole = [v for known, _ in LANGUAGES.values() for v in known.values()]
        for w, lang in words:
            rates.setdefault(lang, {})[w] = LANGUAGES.get(lang, ({}, ()))[0].get(w)
        self.own = []
        for lang, of in sorted(rates.items()):
            known = [v for v in of.values() if v is not None] or whole
            of = {w: (v if v is not None else sum(known) / len(known)) / 1000 for w, v in of.items()}
            share = sum(of.values())
            most = min(share, 0.5)
            chars = LANGUAGES[lang][1] if lang in LANGUAGES else tuple(sum(c) / len(LANGUAGES) for c in zip(*(x for _, x in LANGUAGES.values())))
            self.own.append(({w: v / share for w, v in of.items()}, most, chars))

    def far(self, counts: Counter, n: int, chars: list[float]) -> dict[str, float]:
        """Weighted divergences of function words and characters from each kind, in the language nearest to it.

        counts: of the words of the text that are in the list, of n words in all.
        """
        return {
            kind: min(
                (
                    WORDS_WEIGHT * _word_divergence(counts, n, rates, OTHERS[kind][0] if kind in OTHERS else share) + CHARS_WEIGHT * divergence(chars, OTHERS[kind][1] if kind in OTHERS else own)
                    for rates, share, own in self.own
                ),
                default=0.0,
            )
            for kind in PROFILES
        }


def _half(a: float, b: float) -> float:
    """What one class adds to a divergence."""
    m = (a + b) / 2
    return ((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)) / 2


def _word_divergence(counts: Counter, n: int, rates: dict[str, float], share: float) -> float:
    """divergence of a text's words from function words of these rates that make up a share of all words; all others are one class.

    The text counts as if PRIOR more function words of these rates stood in it, in the same
    share of its words: else few words would be far from any profile.
    """
    if not n:
        return 1.0
    own = [(v, rates[w]) for w, v in counts.items() if w in rates]
    used, met = sum(v for v, _ in own), sum(r for _, r in own)
    f = used / n
    total = sum(_half(f * (v + PRIOR * r) / (used + PRIOR), share * r) for v, r in own)
    # the words that the text lacks are in the profile's proportions
    total += max(0.0, 1 - met) * _half(f * PRIOR / (used + PRIOR), share)
    return max(0.0, total + _half(1 - f, 1 - share))


_MEASURED = Languages((w, lang) for lang, (known, _) in LANGUAGES.items() for w in known)


def statistics(text: str | None, common: frozenset[str], languages: Languages = _MEASURED) -> tuple:
    """(words, mean word length, symbol ratio, share of lines ending in punctuation, share of common words, divergences from the four profiles, kind).

    A null text has null statistics; an empty or blank one 0 words, shares of 0 and kind
    null, like every text of less than 30 characters.
    """
    if text is None:
        return (None,) * 10
    words = _WORD.findall(text)
    lines = [x.rstrip() for x in text.splitlines() if x.strip()]
    n = len(words)
    counts = Counter(filter(common.__contains__, map(str.lower, words)))
    share = sum(counts.values()) / n if n else 0.0
    chars = char_counts(text)
    solid = sum(chars[1:])
    symbol = (chars[3] + chars[4]) / solid if solid else 0.0
    ended = sum(x[-1] in _END for x in lines) / len(lines) if lines else 0.0
    mean = sum(map(len, words)) / n if n else 0.0
    if len(text) < 30:
        return (n, mean, symbol, ended, share, None, None, None, None, None)
    classes = line_classes(text, chars[1] < 0.8 * solid)
    junk = junk_share(text, words, chars)
    if junk:
        classes = [c * (1 - junk) for c in classes]
        classes[3] += junk
    # function words mark prose: their usual share moves weight from the entries to the sentences
    if share > 0.2 and classes[0] < 0.5 and not junk and not classes[2] > 0.5:
        moved = classes[1] * min(1.0, (share - 0.2) / 0.1) * 0.5
        classes = [classes[0] + moved, classes[1] - moved, classes[2], classes[3]]
    all_chars = sum(chars)
    spoken = languages.far(counts, n, [c / all_chars for c in (*chars[:4], chars[4] + chars[5])])
    far = {k: divergence(classes, p) + spoken[k] for k, p in PROFILES.items()}
    kind = min(far, key=lambda k: (far[k], k != "prose"))
    return (n, mean, symbol, ended, share, far["prose"], far["list"], far["table"], far["junk"], kind)


COLUMNS = ["word_count", "mean_word_length", "symbol_ratio", "ended_lines", "common_share", "from_prose", "from_list", "from_table", "from_junk", "kind"]


def quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id and the columns of COLUMNS for every document; statistics says what they hold.

    common_words: word, lang; a word list of fixed size, sent to the executors. Case is ignored.
    """
    listed = sorted({(r["word"].lower(), r["lang"] or "") for r in common_words.select("word", "lang").distinct().collect() if r["word"]})
    words, languages = frozenset(w for w, _ in listed), Languages(listed)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = pd.DataFrame([statistics(t, words, languages) for t in part["text"]], columns=COLUMNS)
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            out["word_count"] = out["word_count"].astype("Int64")
            yield out

    schema = "doc_id bigint, word_count bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_share double, from_prose double, from_list double, from_table double, from_junk double, kind string"
    return documents.select("doc_id", "text").mapInPandas(scan, schema)
