"""Text expressions: white space, cleaning, tokens, headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.config import Cleaning, IndexRules

# Unicode White_Space. Java's \s knows only the ASCII part.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_WS_CHARS = "".join(
    map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Unicode word segmentation as one pattern. Han, Hiragana and the South East Asian scripts
# break between characters; Katakana stays in runs; inner punctuation joins only between
# letters or only between digits. Possessive, so the time is linear and nothing piles up on the stack.
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[\p{{L}}\p{{M}}\p{{N}}_&&[^{_SINGLE}\p{{No}}]]"
WORD_RE = (
    rf"(?:[{_SINGLE}&&[\p{{L}}\p{{N}}]]|\p{{No}})\p{{M}}*"
    rf"|{_WORD}++(?:(?:(?<=[\p{{L}}\p{{M}}])[.:'\x{{2019}}\x{{2018}}\x{{b7}}](?=[\p{{L}}&&[^{_SINGLE}]])"
    rf"|(?<=\p{{N}})[.,;'\x{{2019}}\x{{2018}}](?=\p{{Nd}})){_WORD}++)*+"
)

# Words left out of the index.
STOPWORDS = (
    "및 의 를 을 가 이 은 는 에서 으로 로 와 과 "
    "the a an is are was were be been being have has had do does did will would could should "
    "may might can must shall of to in for on with at by from as or and but if then so than "
    "http https www com kr html php asp"
).split()


def strip_ws(text: Column) -> Column:
    """Both ends without Unicode white space."""
    return F.btrim(text, F.lit(_WS_CHARS))


def normalize_ws(text: Column) -> Column:
    """Each white-space run becomes one space, ends stripped."""
    return F.trim(F.regexp_replace(text, rf"{WS}+", " "))


def _remove_and_replace(
    text: Column, removals: Sequence[str], replacements: Sequence[tuple[str, str]]
) -> Column:
    result = normalize_ws(text)
    for pattern in removals:
        result = F.replace(result, F.lit(pattern), F.lit(""))
    for old, new in replacements:
        result = F.replace(result, F.lit(old), F.lit(new))
    return strip_ws(result)


def clean_title(text: Column, rules: Cleaning) -> Column:
    return _remove_and_replace(text, rules.title_removals, ())


def clean_date(text: Column, rules: Cleaning) -> Column:
    return _remove_and_replace(text, rules.date_removals, rules.date_replacements)


def has_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")) != ""


def clean_header(text: Column, cuts: Sequence[str]) -> Column:
    """Header text up to the first of each cut word, in the order of the cuts."""
    for word in cuts:
        text = F.substring_index(text, word, 1)
    return strip_ws(text)


def college_header(text: Column, suffix: str) -> Column:
    """``struct(college, department)`` of a seed-page header.

    "<college> <rest>" gives both, "<college>" alone gives a NULL department, other text gives
    a NULL college. College names lose their inner white space.
    """
    letters = "[가-힣A-Za-z]"
    spaced = rf"(?:{letters[:-1]}{WS[1:]}*{letters})?"
    name = rf"{letters}{spaced}{suffix}"
    with_rest = rf"^({name}){WS}+([^\n]+)\z"
    alone = rf"^{name}{WS}*\z"
    college = F.when(text.rlike(with_rest), F.regexp_extract(text, with_rest, 1)).when(
        text.rlike(alone), text
    )
    return F.struct(
        F.regexp_replace(college, rf"{WS}+", "").alias("college"),
        F.when(text.rlike(with_rest), strip_ws(F.regexp_extract(text, with_rest, 2))).alias(
            "department"
        ),
    )


def tokenize(text: Column, min_bytes: int = 2) -> Column:
    """Lowercased words in text order, duplicates kept, short words and stop words left out.

    The length counts bytes, so one Hangul syllable (three bytes) is long enough.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_RE), F.lit(0))
    return F.filter(
        words,
        lambda w: (F.octet_length(w) >= min_bytes) & ~w.isin(STOPWORDS) & w.rlike(r"[\p{L}\p{N}]"),
    )


def index_tokens(
    title: Column,
    campus: Column,
    department: Column,
    board: Column,
    college: Column,
    rules: IndexRules = IndexRules(),
) -> Column:
    """Tokens of a notice, title first, then the metadata fields; all, or the first ``max_tokens``."""
    fields = [title] + ([campus, department, board, college] if rules.metadata else [])
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(tokenize(f, rules.min_token_bytes), empty) for f in fields]
    tokens = F.concat(*lists)
    return tokens if rules.max_tokens is None else F.slice(tokens, 1, rules.max_tokens)
