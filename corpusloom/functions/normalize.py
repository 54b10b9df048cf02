"""Text normalisation as column expressions (NFKC alone needs Python)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Replacements of Unicode punctuation, and the marks that some pipelines keep as they are.
PUNCT = {
    "，": "、", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"', "》": '"', "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!",
    "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
}
KEPT_MARKS = "。、"
CHAT_PUNCT = {"，": ",", "。": ".", "、": ","}
CONTROL = r"[\x00-\x09\x0B-\x1F\x7F-\x9F]"
DROPPED = rf"[{''.join(PUNCT)}{KEPT_MARKS}\x00-\x09\x0B-\x1F\x7F-\x9F]"
PUNCT_CLASSES = r"[\p{P}\p{C}\p{S}]+"


#: Unicode white space, that which trimming takes away at both ends.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` alone takes U+0020 only)."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def replace_chars(c: Column, table: dict[str, str]) -> Column:
    """Single characters by ``translate``, others by ``replace``."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def replace_unicode_punct(c: Column, table: dict[str, str] | None = None) -> Column:
    return replace_chars(c, PUNCT if table is None else table)


def remove_unicode_punct(c: Column, table: dict[str, str] | None = None) -> Column:
    return F.translate(c, "".join(PUNCT if table is None else table) + (KEPT_MARKS if table is None else ""), "")


def remove_control(c: Column) -> Column:
    """Drop U+0000-001F but the line feed, and U+007F-009F."""
    return F.regexp_replace(c, CONTROL, "")


def mask_digits(c: Column, unicode: bool = True) -> Column:
    return F.regexp_replace(c, r"(?U)\d" if unicode else "[0-9]", "0")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFKC without combining marks."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKC", x) if unicodedata.category(ch) != "Mn"))


def normalize(c: Column, accent: bool = True, case: bool = False, numbers: bool = False, punct: int = 0) -> Column:
    """Trim, then in this order: lower case, accents, digits to 0, punctuation (1 replace, 2 remove), control characters."""
    out = strip(c)
    out = F.lower(out) if case else out
    out = strip_accents(out) if accent else out
    out = mask_digits(out) if numbers else out
    out = {0: lambda x: x, 1: replace_unicode_punct, 2: remove_unicode_punct}[punct](out)
    return remove_control(out)


def normalize_for_dedup(c: Column) -> Column:
    """Lower case, digits to 0, no punctuation of the table and no control characters; line feeds stay."""
    return F.regexp_replace(mask_digits(F.lower(strip(c))), DROPPED, "")


def slow_normalize_for_dedup(c: Column) -> Column:
    """The same by the steps of ``normalize``, one after the other."""
    return normalize(c, accent=False, case=True, numbers=True, punct=2)


def normalize_classes(c: Column) -> Column:
    """Lower case, digits (of any script) to 0, no punctuation, symbols or control characters at all (lines are glued)."""
    return F.regexp_replace(mask_digits(F.lower(strip(c))), PUNCT_CLASSES, "")


def unescape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def unescape_wrapped(c: Column) -> Column:
    """A literal \\n behind a line feed is dropped with it kept; other literal ones vanish."""
    return F.replace(F.replace(c, F.lit("\n\\n"), F.lit("\n")), F.lit("\\n"), F.lit(""))


def feature_text(c: Column) -> Column:
    """Lower case without ASCII punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""), f"[{SPACES}]+", " "))


# Spacing rules for tokenisation, literal ones in order, then by language.
SPACING = [("\r", ""), ("(", " ("), (")", ") ")]
SPACING_AFTER = [("( ", "("), (" )", ")")]
SPACING_QUOTES = [(" :", ":"), (" ;", ";"), ("`", "'"), ("''", ' " '), ("„", '"'), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - ")]
SPACING_MARKS = [
    ("´", "'"), ("‘", '"'), ("‚", '"'), ("’", '"'), ("''", '"'), ("…", "..."), (" « ", ' "'), ("« ", '"'), ("«", '"'), (" » ", '" '), (" »", '"'), ("»", '"'), (" %", "%"), (" :", ":"), (" ?", "?"), (" !", "!"), (" ;", ";"),
]
SPACING_LAST = [("．", ". ")]
COMMA_LANGUAGES = ("de", "es", "cz", "cs", "fr")


def normalize_spacing(c: Column, language: str = "en", as_written: bool = False) -> Column:
    """Spacing around brackets, quotes and marks; runs of blanks become one; digits parted by a blank one number.

    ``as_written``: only a blank before a plus sign is merged, and a backslash stays in front of what three of the rules
    put in, as some pipelines have it.
    """

    def apply(col: Column, rules: list[tuple[str, str]]) -> Column:
        for a, b in rules:
            col = F.replace(col, F.lit(a), F.lit(b))
        return col

    def collapse(col: Column) -> Column:
        return F.replace(col, F.lit(" +"), F.lit(" ")) if as_written else F.regexp_replace(col, " +", " ")

    mark = r"\\" if as_written else ""
    out = F.regexp_replace(collapse(apply(c, SPACING)), r"\) ([.!:?;,])", mark + ")$1")
    out = F.regexp_replace(apply(out, SPACING_AFTER), r"(?U)(\d) %", f"$1{mark}%")
    out = collapse(apply(collapse(apply(out, SPACING_QUOTES)), SPACING_MARKS))
    out = apply(out, SPACING_LAST)
    if language == "en":
        out = F.regexp_replace(out, r'"([,.]+)', '$1' + mark + '"')
    elif language not in ("cs", "cz"):
        out = F.regexp_replace(F.replace(out, F.lit(',"'), F.lit('",')), r'(\.+)"(\s*[^<])', mark + '"$1$2')
    return F.regexp_replace(out, r"(?U)(\d) (\d)", "$1,$2" if language in COMMA_LANGUAGES else "$1.$2")


@F.pandas_udf(T.BooleanType())
def is_simplified_chinese(s: pd.Series) -> pd.Series:
    """Whether a character is lost on the way through Shift-JIS."""
    return s.map(lambda x: None if x is None else x.encode("shift_jis", "ignore").decode("shift_jis") != x)


def latin_count(c: Column) -> Column:
    """Characters of the Basic Latin and Latin-1 blocks."""
    return F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\xFF]", ""))


def map_variants(c: Column, table: dict[str, str]) -> Column:
    """Old and variant forms of characters (such as kanji) by their usual form; the table is the caller's."""
    return replace_chars(c, table)

