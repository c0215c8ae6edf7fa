"""Pieces of SQL shared by the twins."""

from __future__ import annotations

from quern.functions.text import STOPWORDS

#: White space as the column functions see it.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def clean(x: str) -> str:
    return strip(collapse(f"coalesce({x}, '')"))


def hash_form(x: str) -> str:
    return clean(f"lower({x})")


def question_form(x: str) -> str:
    punct = r"[^\pL\pN_\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\pM\x{200C}\x{200D}]"
    return strip(collapse(f"regexp_replace({hash_form(x)}, '{punct}', ' ', 'g')"))


def choice_form(x: str) -> str:
    bare = f"regexp_replace(replace(coalesce({x}, ''), chr(160), ' '), '^{WS}*[A-Da-d]{WS}*[.):\\-]{WS}*', '')"
    return f"lower({strip(collapse(f'replace({bare}, {chr(39)}_{chr(39)}, {chr(39)} {chr(39)})'))})"


def blank(x: str) -> str:
    return f"({x} is null or regexp_full_match({x}, '{WS}*'))"


def missing(x: str) -> str:
    return f"({x} is null or {x} = '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({clean(x)}, ' '), lambda w: w <> '')"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def user(messages: str = "messages") -> str:
    return f"list_filter({messages}, lambda m: m.role = 'user')[1].content"


def assistant(messages: str = "messages") -> str:
    return f"list_filter({messages}, lambda m: m.role = 'assistant')[1].content"


#: Line breaks as the column functions see them.
BREAK = r"\r\n|[\n\x0B\x0C\r\x85\x{2028}\x{2029}]"


def answer_letter(x: str) -> str:
    t = f"upper({strip(x)})"
    return f"case {t} when '0' then 'A' when '1' then 'B' when '2' then 'C' when '3' then 'D' else nullif(regexp_extract({t}, '^([ABCD])[.)]?$', 1), '') end"


def clean_question(x: str) -> str:
    t = f"regexp_replace({strip(f'replace({x}, chr(160), chr(32))')}, '{BREAK}', chr(10), 'g')"
    t = strip(f"regexp_replace({t}, '(?ms)^[^\\S\\n]*[A-Da-d][^\\S\\n]*[.):\\-][^\\S\\n]+.*\\z', '')")
    return strip(f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


def clean_choice(x: str) -> str:
    return strip(collapse(f"regexp_replace({strip(collapse(x))}, '^{WS}*[A-Da-d]{WS}*[.):\\-]{WS}*', '')"))


def difficulty(x: str) -> str:
    n = f"case when regexp_full_match({strip(x)}, '[+-]?\\d+') then try_cast({strip(x)} as int) end"
    return f"case when {n} between 1 and 6 then 'easy' when {n} between 10 and 12 then 'hard' else 'medium' end"


def strip_lines(x: str) -> str:
    t = f"replace(coalesce({x}, ''), chr(160), ' ')"
    return strip(f"array_to_string(list_transform(regexp_split_to_array({t}, '{BREAK}'), lambda l: {strip('l')}), chr(10))")


def without_markers(x: str) -> str:
    roles = "Human|Assistant|Instruction|Response|Input|Output"
    return strip(f"regexp_replace({x}, '(?im)^{WS}*(?:#+{WS}*(?:{roles}){WS}*:?|(?:{roles}){WS}*:){WS}*', '', 'g')")


def word_grams(w: str, n: int) -> str:
    return f"list_distinct(list_transform(generate_series(1, len({w}) - {n - 1}), lambda i: array_to_string({w}[i : i + {n - 1}], ' ')))"


def char_grams(t: str, n: int) -> str:
    return f"list_distinct(list_transform(generate_series(1, length({t}) - {n - 1}), lambda i: substring({t}, i, {n})))"
