"""N-grams, shingles and simple tokenisation as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.normalize import SPACES, strip
from corpusloom.plans.storage import Stash, spread


def bound(value: Column, make) -> Column:
    """``make`` of a value that is computed once; an outer expression inside a lambda is computed for every element."""
    return F.transform(F.array(value), make)[0]


def gram_stats(docs: DataFrame, grams: Column, id_col: str = "doc_id") -> DataFrame:
    """id, n, n_distinct, least, most: the number of grams of an id, of distinct ones, and the least and greatest MD5.

    The grams of a row are counted in their row, so what is shuffled is a row of figures per document and no gram. Ids that
    several rows share are counted once more, gram by gram, since the distinct grams of two rows do not add up.
    """

    def of(x: Column) -> Column:
        figures = lambda d, h: F.struct(F.size(x).cast("long").alias("n"), F.size(d).cast("long").alias("n_distinct"), F.array_min(h).alias("least"), F.array_max(h).alias("most"))
        return bound(F.filter(F.array_distinct(x), lambda g: g.isNotNull()), lambda d: bound(F.transform(d, lambda g: F.md5(g)), lambda h: figures(d, h)))

    docs = spread(docs)
    rows = docs.select(id_col, F.inline(F.array(bound(grams, of)))).where("n > 0")
    sums = rows.groupBy(id_col).agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"), F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("rows"))
    held = Stash(sums, "grams").df
    again = held.where("rows > 1").select(F.col(id_col).alias("__id"))
    done = held.drop("rows")
    if again.isEmpty():
        return done
    shared = docs.join(again, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").select(F.col(id_col).alias("__id"), F.explode(grams).alias("x"))
    exact = shared.groupBy("__id").agg(F.count_distinct("x").alias("__d"), F.lit(True).alias("__found"))
    joined = done.join(exact, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return joined.select(id_col, "n", F.when(F.col("__found"), F.col("__d")).otherwise(F.col("n_distinct")).alias("n_distinct"), "least", "most")


def _slide(text: Column, gram: str, step: str) -> Column:
    """Every overlapping match of ``gram``, in one pass: what lies ahead is captured, then ``step`` is consumed."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(?=({gram})){step}"), F.lit(1)), F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int, short: str = "none") -> Column:
    """N-grams of code points. Of a shorter text: ``none``, or the text ``whole``."""
    grams = _slide(text, f".{{{n}}}", ".")
    return F.when(F.length(text) < n, F.array(text)).otherwise(grams) if short == "whole" else grams


def byte_ngrams(text: Column, n: int = 3) -> Column:
    """N-grams of UTF-8 bytes in hexadecimal; a shorter text is one gram, an empty one none."""
    data = F.hex(F.encode(text, "UTF-8"))
    grams = _slide(data, f".{{{2 * n}}}", "..")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.octet_length(text) < n, F.array(data)).otherwise(grams)


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda x: x != "")


def ascii_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda x: x != "")


def nonword_split(text: Column) -> Column:
    """Split at every single non-word character; empty strings stay."""
    return F.split(text, r"(?U)\W", -1)


def token_ngrams(tokens: Column, n: int, least: int = 1, glue: str = " ") -> Column:
    """No grams of fewer than ``least`` tokens; fewer than n tokens are one gram."""
    none = F.array().cast("array<string>")

    def of(t: Column) -> Column:
        size = F.size(t)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), glue))
        return F.when((size < least) | (size == 0), none).when(size < n, F.array(F.array_join(t, glue))).when(size >= n, grams).otherwise(none)

    return bound(tokens, of)


def word_shingles(text: Column, n: int) -> Column:
    """Shingles of white-space words; of fewer than n words, the words themselves."""
    words = whitespace_words(text)
    return F.when(F.size(words) < n, words).otherwise(token_ngrams(words, n))


def spaced_chars(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, ""), lambda x: x != ""), " ")


def lm_chunks(text: Column, least: int = 3) -> Column:
    """Chunks between white space (Unicode's) of at least ``least`` characters."""
    return F.filter(F.split(text, f"[{SPACES}]+", -1), lambda x: F.length(x) >= least)


def sentences(text: Column, marks: str = "。.!?！？") -> Column:
    """Cut behind runs of sentence marks and at line feeds; blank pieces go."""
    cut = F.split(F.regexp_replace(text, f"([{marks}]+)", "$1\n"), "\n", -1)
    return F.filter(F.transform(cut, strip), lambda x: x != "")


#: Runs of one kind of script, or of a single mark: Latin and other letters, digits, hiragana, katakana, kanji.
SCRIPT_RUNS_RE2 = r"[\p{Hiragana}]+|[\p{Katakana}ー]+|[\p{Han}々]+|[\p{Latin}\p{M}]+|\p{Nd}+|[^\s\p{Hiragana}\p{Katakana}ー\p{Han}々\p{Latin}\p{M}\p{Nd}]"
SCRIPT_RUNS = r"\p{IsHiragana}+|[\p{IsKatakana}ー]+|[\p{IsHan}々]+|[\p{IsLatin}\p{M}]+|\p{Nd}+|[^\s\p{IsHiragana}\p{IsKatakana}ー\p{IsHan}々\p{IsLatin}\p{M}\p{Nd}]"


def script_runs(text: Column) -> Column:
    """A text cut where the script changes; white space goes. A segmenter for languages without blanks."""
    return F.regexp_extract_all(text, F.lit(SCRIPT_RUNS), F.lit(0))


def segmented(segmenter):
    """A UDF from a text to its tokens by any function from str to a list of str, such as a morphological tagger's. It is
    sent to the executors, so it must be picklable; one that holds a model should open it when first called there."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else list(segmenter(t)))

    return run


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda c: F.ascii(c))


def drop_tokens(tokens: Column, unwanted: Column) -> Column:
    return F.filter(tokens, lambda x: ~F.array_contains(unwanted, x))
