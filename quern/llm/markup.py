"""Markup left in texts: which kinds there are, and clean text that keeps the structure.

The texts are short records of one table, not pages of a host: what repeats across them is
their wording, and most markup occurs once. So markup is recognised by its grammar instead
of by long repeated substrings (README, problem 3).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element names of HTML that occur in texts.
_ELEMENTS = (
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em "
    "figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark "
    "meta nav nowiki ol option p pre q ref s samp script section select small span strike strong style sub summary sup "
    "table tbody td textarea tfoot th thead title tr tt u ul var video"
)

HTML = re.compile(
    rf"</?(?:{'|'.join(_ELEMENTS.split())})(?:\s+[^<>]*)?/?>|<!--|-->|<!doctype\b|&(?:#\d{{1,6}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z][a-zA-Z0-9]{{1,15}});",
    re.I,
)
_ENTITY = re.compile(r"&(#\d{1,6}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,15});")

_WORDY = r"(?:[^\W_]|[\"'“”‘’(){}$\\<>&;:.,!?%/+\-=~^ ])"
WIKI = re.compile(
    r"\[\[[^\[\]\n]+(?:\]\]|$)"  # links, files, categories
    r"|\[\[[^\[\]]+\]\]"
    r"|\{\{[^{}\n]*[^\W\d_][^{}\n]*\}\}"  # templates
    r"|(?<!')'{2,5}(?!')[^'\n]+(?:'[^'\n]+)*'{2,5}(?!')"  # bold and italics
    r"|(?m:^\s*(?:Câu hỏi\s*:\s*)?(={2,6})[^=\n]+\1\s*$)"  # headings
    r"|(?m:^\s*\{\||^\s*\|\}|^\s*\|-+\s*$)"  # tables
    r"|</?(?:ref|nowiki|gallery)\b[^<>]*>|__(?:TOC|NOTOC|FORCETOC)__"
    r"|\[https?://[^\s\]]+\s+[^\]\n]+\](?!\()"
)

MARKDOWN = re.compile(
    r"(?m:^\s*(?:Câu hỏi\s*:\s*)?\#{1,6}[ \t]+\S)"  # headings
    r"|(?m:^(?:Câu hỏi\s*:\s*)?[^\s\n|=#][^\n]*\n(?:={3,}|-{3,})[ \t]*$)"  # underlined headings
    r"|(?m:^[ \t]*(?:={4,}|\*{3,}|_{3,}|-{3,}|(?:\* ){2,}\*)[ \t]*$)"
    r"|(?<![*\w\\])\*\*(?=\S)[^*\n]*?\S\*\*(?!\*)"  # strong, emphasis
    r"|(?<![*\w\\])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![*\w])"
    r"|(?<![\w_\\{}$])__(?=[^\s_])[^\n]*?\S__(?![\w_])"
    r"|(?<![\w_\\{}$^])_(?=[^\s_{])[^_\n]*?[^\s_]_(?![\w_{])"
    r"|~~(?=\S)[^~\n]+\S~~"
    r"|!\[[^\]\n]*\]\([^()\n]*\)|\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]"  # images, links
    r"|(?m:^\s*```|^\s*~~~)|```"  # code
    r"|(?<!`)`[^`\n]+`(?!`)"
    r"|(?m:^[ \t]*(?:Câu hỏi\s*:\s*)?>[ \t]+\S)"  # quotations
    r"|(?m:^[ \t]*(?:Câu hỏi\s*:\s*)?[-*+][ \t]+\S[^\n]*\n[ \t]*[-*+][ \t]+\S)"  # lists
    r"|(?m:^\s*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$)"  # tables
    r"|(?m:^[ \t]*[-*+][ \t]\[[ xX]\][ \t])|<https?://[^\s<>]+>"
)

LATEX = re.compile(
    r"\\(?:begin|end)\s*\{[^{}]*\}"
    r"|\\[()\[\]](?=[^\n])"
    r"|\\[a-zA-Z]{2,}(?![a-zA-Z]*[\\:]\w)(?=[\s{}\[\]()^_.,;:$=+\-*/<>|&0-9\\]|\W|$)"
    r"|\$\$"
    r"|(?<![\w$\\])\$(?=[^\s$])[^$\n]*?[^\s$\\]\$(?![\w$])"
    r"|(?<![\w\\])\$[^$\n]*[\\^_={][^$\n]*(?:\$|$)"
    r"|[\w)}\]][\^_]\{[^{}\n]*\}"
    r"|\^\s*\\?circ\b|\^\\"
    r"|\\[,;!](?=\s*\w)"
)
_PATH = re.compile(r"\b[A-Za-z]:\\[^\s]*|\\\\[\w.-]+\\\S*")
_SET_BRACE = re.compile(r"\{\s*-?\w+(?:\s*[,;]\s*-?\w+)*\s*\}")

KINDS = ("html", "markdown", "wiki", "latex")


def _without_choices_labels(text: str) -> str:
    return re.sub(r"(?m)^([ \t]*[A-D])[.)]", r"\1", text)


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup in a text, in the order of KINDS; none for None and for plain text."""
    if not text or not _ANY.search(text):
        return []
    t = _without_choices_labels(text)
    paths = _PATH.sub(" ", t)
    formulas = _FORMULA.sub(" ", paths)
    out = []
    if any(_is_html(m[0]) for m in HTML.finditer(paths)):
        out.append("html")
    tagless = re.sub(r"<[^<>\n]+>", "", formulas)
    if MARKDOWN.search(_WIKI_HEAD.sub(" ", WIKI.sub(" ", tagless))):
        out.append("markdown")
    if WIKI.search(formulas) or WIKI.search(paths):
        out.append("wiki")
    if LATEX.search(paths):
        out.append("latex")
    return out


_ANY = re.compile(r"[<&\\$*_`~#|\[\]{}^>]|''|==|(?m:^\s*[-+=]{3,}|^[ \t]*[-+] )")
_FORMULA = re.compile(r"\$\$.*?\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*?[^\s$\\]\$(?![\w$])|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\s*\{(\w+\*?)\}.*?\\end\s*\{\1\}|\\[a-zA-Z]+(?:\{[^{}]*\})*|\w[\^_]\{[^{}]*\}", re.S)
_WIKI_HEAD = re.compile(r"(?m)^\s*(?:Câu hỏi\s*:\s*)?(={2,6})[^=\n]+\1\s*$")


def _is_html(found: str) -> bool:
    m = _ENTITY.fullmatch(found)
    return not m or m[1].startswith("#") or f"{m[1]};" in html.entities.html5


# Clean text

_BLOCK_CODE = re.compile(r"```[^\n]*\n(.*?)```|<pre[^>]*>(.*?)</pre>", re.S | re.I)


def _rows(m: re.Match) -> str:
    rows = re.findall(r"<tr[^>]*>(.*?)(?=</tr>|<tr|\Z)", m[1], re.S | re.I)
    return "\n" + "\n".join(" | ".join(re.sub(r"\s+", " ", c).strip() for c in re.findall(r"<t[dh][^>]*>(.*?)(?=</t[dh]>|<t[dh]|\Z)", r, re.S | re.I)) for r in rows) + "\n"


_STEPS: list[tuple[re.Pattern, object]] = [
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), ""),
    (re.compile(r"<(script|style)\b[^>]*>.*?</\1>", re.S | re.I), ""),
    (re.compile(r"\[\[(?:Tập tin|Hình|File|Image|Category|Thể loại):[^\[\]]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"(?m)^((?:Câu hỏi\s*:\s*)?)\s*(={2,6})[ \t]*([^=\n]+?)[ \t]*\2[ \t]*$"), lambda m: f"{m[1]}{'#' * (len(m[2]) - 1)} {m[3]}"),
    (re.compile(r"(?m)^((?:Câu hỏi\s*:\s*)?)([^\s\n|=#][^\n]*)\n={3,}[ \t]*$"), lambda m: f"{m[1]}# {m[2]}"),
    (re.compile(r"<table[^>]*>(.*?)</table>", re.S | re.I), _rows),
    (re.compile(r"<h([1-6])[^>]*>\s*(.*?)\s*</h\1>", re.S | re.I), lambda m: f"\n{'#' * int(m[1])} {m[2]}\n"),
    (re.compile(r"<li[^>]*>\s*", re.I), "\n- "),
    (re.compile(r"<br\s*/?>|</?(?:p|div|tr|ul|ol|dl|dd|dt|blockquote|section|article|table|tbody|thead)\b[^<>]*>|</li>", re.I), "\n"),
    (re.compile(r"<sup[^>]*>(.*?)</sup>", re.S | re.I), r"^\1"),
    (re.compile(r"<code[^>]*>(.*?)</code>", re.S | re.I), r"`\1`"),
    (re.compile(rf"</?(?:{'|'.join(_ELEMENTS.split())})(?:\s+[^<>]*)?/?>", re.I), ""),
    (re.compile(r"!\[([^\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"(?<!!)\[([^\[\]\n]+)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\n?"), ""),
    (re.compile(r"(?m)^[ \t]*\|[ \t]*(.*?)[ \t]*\|[ \t]*$"), r"\1"),
    (re.compile(r"(?<![*\w\\])(\*{1,3})(?=\S)([^*\n]*?\S)\1(?!\*)"), r"\2"),
    (re.compile(r"(?<![\w_\\{}$^])(_{1,2})(?=[^\s_{])([^_\n]*?[^\s_])\1(?![\w_{])"), r"\2"),
    (re.compile(r"~~(?=\S)([^~\n]+)~~"), r"\1"),
    (re.compile(r"(?m)^([ \t]*)[*+][ \t]+(?=\S)"), r"\1- "),
    (re.compile(r"\\(?:text|textbf|textit|mathrm|emph)\s*\{([^{}]*)\}(?![^$\n]*\$)"), r"\1"),
]


def clean_text(text: str | None) -> str | None:
    """Text without markup; None stays None, a text without markup stays as it is.

    Headings become lines that start with #, list entries lines with -, table rows cells
    between |, and code blocks keep their fences and what is in them; formulas in $, \\( or
    environments are kept as they are. Links keep their words, images their description,
    comments, templates and category links go. Lines A to D stay lines.
    """
    if not text or not kinds_of(text):
        return text
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\ue000{len(kept) - 1}\ue001"

    def code(m: re.Match) -> str:
        kept.append(m[0] if m[0].startswith("```") else f"```\n{(m[2] or '').strip(chr(10))}\n```")
        return f"\ue000{len(kept) - 1}\ue001"

    t = _BLOCK_CODE.sub(code, text)
    t = re.sub(r"\$\$.+?\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*?[^\s$\\]\$(?![\w$])|\\\(.+?\\\)|\\\[.+?\\\]|\\begin\s*\{(\w+\*?)\}.*?\\end\s*\{\1\}", keep, t, flags=re.S)
    for pattern, by in _STEPS:
        t = pattern.sub(by, t)
    if "&" in t:
        t = _ENTITY.sub(lambda m: html.unescape(m[0]), t)
    t = re.sub(r"[ \t]*\n[ \t]*\n(?:[ \t]*\n)*", "\n\n", re.sub(r"[ \t\xa0]+\n", "\n", t))
    t = re.sub(r"\n+(?=[A-D][.)] )", "\n", t)
    for n in range(len(kept) - 1, -1, -1):
        t = t.replace(f"\ue000{n}\ue001", kept[n])
    return t.strip()


def convert(df: DataFrame, id_column: str, column: str, clean: bool = True) -> DataFrame:
    """id, kinds (array of string) and, unless it isn't wanted, clean of every row; null text gives an empty array and null."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = {id_column: part[id_column], "kinds": [kinds_of(t) for t in part["text"]]}
            if clean:
                out["clean"] = [clean_text(t) if kinds else t for t, kinds in zip(part["text"], out["kinds"])]
            yield pd.DataFrame(out)

    return df.select(id_column, F.col(column).alias("text")).mapInPandas(scan, f"{id_column} bigint, kinds array<string>" + (", clean string" if clean else ""))
