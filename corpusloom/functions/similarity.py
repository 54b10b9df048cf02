"""Similarities of sets, signatures and strings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _ratio(a: Column, b: Column, value: Column, both_empty: float, one_empty: float = 0.0) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(one_empty)).otherwise(value)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    return _ratio(a, b, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), both_empty)


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct members that b has; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def dice(a: Column, b: Column) -> Column:
    return _ratio(a, b, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))), 1.0)


def matches(a: Column, b: Column) -> Column:
    """Equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(matches(a, b) / F.size(a))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / most)


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of strings; null for unequal lengths."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, F.lit(0)).otherwise(differ))


def hamming_similarity(a: Column, b: Column) -> Column:
    return F.when(F.length(a) != F.length(b), F.lit(-1.0)).when(F.length(a) == 0, F.lit(1.0)).otherwise(1.0 - hamming(a, b) / F.length(a))


def osa_distance(a: str | list, b: str | list) -> int:
    """Edits and swaps of neighbours, no part edited twice."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def edit_distance(a: str | list, b: str | list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def common_subsequence(a: str | list, b: str | list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _pairwise(f: Callable, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x if isinstance(x, str) else list(x), y if isinstance(y, str) else list(y)) for x, y in zip(a, b, strict=True)])

    return run


def _similar(d: Callable, complement: bool) -> Callable:
    def f(a, b):
        most = max(len(a), len(b))
        return 1.0 if not most else 1 - d(a, b) / most if complement else d(a, b) / most

    return f


damerau = _pairwise(osa_distance, T.LongType())
damerau_similarity = _pairwise(_similar(osa_distance, True), T.DoubleType())
lcs_length = _pairwise(common_subsequence, T.LongType())
lcs_similarity = _pairwise(_similar(common_subsequence, False), T.DoubleType())
token_edit_distance = _pairwise(edit_distance, T.LongType())
