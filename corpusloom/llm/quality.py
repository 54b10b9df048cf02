"""Quality by ordinal regression with a cumulative link.

A text becomes hashed features: its tokens (split at white space, as they are), their shapes (runs of upper case, lower
case, digits and other characters) and a few of its figures written as text. One weight vector is shared by all
grades; ordered thresholds cut its value: P(grade <= k) = logistic(threshold_k - value). That gives an expected grade
and the probability of the best grades, for selection at any level. Features are square roots of relative
frequencies, so a text's length plays no part and a text of any length is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import values
from corpusloom.llm.keys import text_of
from corpusloom.llm.toxicity import GRADES, held_out, labelled_sample

BUCKETS = 1 << 18
#: Bounds of the training sample: texts of each grade, and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 48 << 20
#: A bucket met in n training texts keeps n / (n + SUPPORT) of its weight.
SUPPORT = 5
_RUNS = re.compile(r"(.)\1+")
_CLASSES = {c: "9" if chr(c).isdigit() else "X" if chr(c).isupper() else "x" if chr(c).isalpha() else chr(c) for c in range(0x250)}


def shape(token: str) -> str:
    """Every letter and digit as its class, runs of one character as that character."""
    return _RUNS.sub(r"\1", token.translate(_CLASSES))


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) % BUCKETS


def figures(text: str, tokens: Counter, n: int) -> list[str]:
    """Coarse figures of a text: distinct tokens, repeated lines, length of a token, number of tokens."""
    lines = text.split("\n")
    return [f"distinct {10 * len(tokens) // n}", f"lines {10 * len(set(lines)) // len(lines)}", f"letters {min(len(text) // n, 30)}", f"size {n.bit_length()}"]


class Features:
    """Buckets and values of a text; remembers the buckets of tokens."""

    def __init__(self, entries: int = 300_000):
        self.entries, self.known = entries, {}

    def __getstate__(self):
        return {"entries": self.entries, "known": {}}

    def pair(self, token: str) -> tuple[int, int]:
        found = self.known.get(token)
        if found is None:
            found = (_bucket("token", token), _bucket("shape", shape(token)))
            if len(self.known) > self.entries:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter((text or "").split())
        n = sum(counts.values())
        if not n:
            return np.array([_bucket("figure", "empty")]), np.ones(1)
        pairs = np.array([self.pair(t) for t in counts], "i8")
        freq = np.fromiter(counts.values(), "f8", len(counts)) / n
        shapes, at = np.unique(pairs[:, 1], return_inverse=True)
        extra = [_bucket("figure", x) for x in figures(text, counts, n)]
        return np.r_[pairs[:, 0], shapes, extra], np.r_[np.sqrt(freq), np.sqrt(np.bincount(at, weights=freq)), np.full(len(extra), 0.5)]


@dataclass
class QualityModel:
    """grades in ascending order, one threshold fewer, a weight for each bucket."""

    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray
    features: Features

    def value(self, text: str | None) -> float:
        buckets, x = self.features(text)
        return float(self.weights[buckets] @ x)

    def probabilities(self, text: str | None) -> np.ndarray:
        """Of each grade."""
        below = np.r_[0, 1 / (1 + np.exp(-np.clip(self.thresholds - self.value(text), -40, 40))), 1]
        return np.diff(below)


def train(texts: list[str | None], labels: list[int], steps: int = 250, decay: float = 1e-3) -> QualityModel:
    """Fit by Adam on the likelihood, grades weighted alike. With one grade, or none, every text gets that grade (0)."""
    grades = sorted(set(labels)) or [0]
    features = Features()
    if len(grades) < 2:
        return QualityModel(grades, np.zeros(0), np.zeros(BUCKETS, "f4"), features)
    y = np.searchsorted(grades, labels)
    rows = [features(t) for t in texts]
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    used, col = np.unique(np.concatenate([b for b, _ in rows]), return_inverse=True)
    x = np.concatenate([v for _, v in rows])
    met = np.bincount(np.unique(row * len(used) + col) % len(used), minlength=len(used))
    x = x * (met / (met + SUPPORT))[col]
    weight = (1 / np.bincount(y))[y] / len(grades)
    k = len(grades) - 1
    p = np.r_[np.zeros(len(used)), np.linspace(-1, 1, k)[:1], np.full(k - 1, np.log(1.0))]  # weights, first threshold, log gaps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, cuts = p[: len(used)], np.cumsum(np.r_[p[len(used)], np.exp(p[len(used) + 1 :])])
        s = np.bincount(row, weights=w[col] * x, minlength=len(y))
        edge = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -30, 30)))
        edge = np.c_[np.zeros(len(y)), edge, np.ones(len(y))]
        slope = edge * (1 - edge)
        i = np.arange(len(y))
        hi, lo = slope[i, y + 1], slope[i, y]
        prob = np.maximum(edge[i, y + 1] - edge[i, y], 1e-12)
        gs = weight * (hi - lo) / prob  # of -log(prob) by s
        gc = np.zeros(k)
        for j in range(k):
            gc[j] = -(weight * hi / prob)[y == j].sum() + (weight * lo / prob)[y == j + 1].sum()
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.r_[np.bincount(col, weights=gs[row] * x, minlength=len(used)) + decay * w / 100, tail[0], tail[1:] * np.exp(p[len(used) + 1 :])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights = np.zeros(BUCKETS, "f4")
    weights[used] = p[: len(used)] * met / (met + SUPPORT)
    return QualityModel(grades, np.cumsum(np.r_[p[len(used)], np.exp(p[len(used) + 1 :])]), weights, features)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", best: int = 1, cut: float = 0.5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, expected_grade, tail_probability, selected.

    tail_probability is that of the ``best`` highest grades together; a row is selected if it reaches ``cut``. The model
    is fitted on at most ``sample_rows`` labelled rows of each grade and ``sample_bytes`` of text, never on held-out ids.
    Null and empty texts are read as empty. Repeated rows each keep their row; a null id stays null. Null labels are
    ignored; without two grades nothing can be learnt and all texts get the one there is; more than GRADES grades raise
    ValueError. An empty table gives an empty result. Columns other than id and text are not looked at.
    """
    grades = [r[0] for r in labels.where(F.col(label).isNotNull()).select(F.col(label).cast("int")).distinct().limit(GRADES + 1).collect()]
    rows = labelled_sample(docs, labels, label, dict.fromkeys(grades, sample_rows), sample_bytes, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in rows], [y for _, y in rows]))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grades = np.array(model.grades, "f8")
        for b in batches:
            p = np.array([model.probabilities(t) for t in values(b.column(1))]).reshape(-1, len(grades))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p @ grades), pa.array(p[:, -best:].sum(axis=1))], names=["doc_id", "expected_grade", "tail_probability"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= cut).alias("selected"))
