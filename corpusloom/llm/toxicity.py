"""Toxicity by subword-bag embeddings.

A word is the mean of the embeddings of its character n-grams (3 to 5, with the word's ends marked) and of itself, all
hashed into one table; a window of consecutive words is the mean of its words, and a linear softmax over two classes
reads it. Embeddings and softmax are trained jointly in numpy. A text's score is the softmax's probability for its most
toxic window, so a few words count in a text of any length: in training, toxic texts give those windows that the model
of the moment finds most toxic, and clean texts give windows as negatives (see NEGATIVES).

Two things are done to the trained model before it scores. A bucket that few training texts had is shrunk towards no
opinion (see SUPPORT). Then the last layer is calibrated: the softmax's logits are scaled by one number and shifted by
another, both fitted on a fifth of the training texts that the embeddings have not seen, since the most toxic of many
windows looks more toxic than a window drawn at random. The score is the probability that this calibrated softmax gives.

A misspelling that training never saw shares most of its n-grams with the word it stands for, and so its vector.

Since the model is linear from the embeddings on, a word contributes one number. Executors get one number per bucket
(a fixed size) and remember those of the words they meet.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusloom.llm.batches import values
from corpusloom.llm.keys import text_of
from corpusloom.llm.words import words
from corpusloom.plans.storage import Stash

BUCKETS, DIM, WINDOW = 1 << 18, 8, 3
SHORTEST, LONGEST = 3, 5
#: A bucket met in n training texts keeps n / (n + SUPPORT) of its value, one never met none.
SUPPORT = 30
#: A round of training sees so many negative windows per positive one, drawn at random, and as many hard ones as
#: positives: those that look most toxic at that time.
NEGATIVES = 8
#: Words whose value a worker remembers (about 150 bytes each).
WORDS_KEPT = 400_000
#: Bounds of the training sample, in texts of each class and in bytes of text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 4000, 48 << 20
CUT = 0.7
#: Labels have at most so many different values.
GRADES = 1000


def subwords(word: bytes) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    text = word.decode("utf-8", "replace")
    marked = f"<{text}>"
    n = len(marked)
    grams = [marked[i : i + k] for k in range(SHORTEST, min(LONGEST, n - 1) + 1) for i in range(n - k + 1)]
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams)]


@dataclass
class ToxicityModel:
    """values[b]: what bucket b adds to a word's difference of the two logits; slope and intercept are the calibration
    of the last layer, under which ``score`` is the softmax's probability of label 1."""

    values: np.ndarray
    bias: float
    slope: float
    intercept: float

    def __post_init__(self):
        self._known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def word(self, word: bytes) -> float:
        value = self._known.get(word)
        if value is None:
            value = float(self.values[subwords(word)].mean())
            if len(self._known) >= WORDS_KEPT:
                self._known.clear()
            if len(word) <= 64:
                self._known[word] = value
        return value

    def logit(self, text: str | None) -> float:
        """The greatest value of a window; a text without words has the bias alone."""
        tokens = words(text)
        if not tokens:
            return self.bias
        known, word = self._known.get, self.word
        each = np.array([v if (v := known(w)) is not None else word(w) for w in tokens])
        if len(each) <= WINDOW:
            return float(each.mean() + self.bias)
        sums = np.cumsum(np.r_[0.0, each])
        return float((sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW + self.bias)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(text) + self.intercept, -50, 50))))


class _Bags:
    """Windows of word numbers, and the buckets of each word, as flat arrays. Texts without words are left out."""

    def __init__(self, texts: Iterable[str | None]):
        number: dict[bytes, int] = {}
        ids, begins, sizes, text_of, self.kept = array("i"), [], [], [], []
        for k, text in enumerate(texts):
            own = [number.setdefault(w, len(number)) for w in words(text)]
            if not own:
                continue
            # Windows side by side; the last one ends with the text, so every word is in a window of full size.
            at = np.unique(np.minimum(np.arange(0, len(own), WINDOW), max(0, len(own) - WINDOW)))
            begins.append((at + len(ids)).astype("i4"))  # the sample's bytes are bounded, so there are far fewer words
            sizes.append(np.minimum(WINDOW, len(own) - at).astype("i1"))
            text_of.append(np.full(len(at), len(self.kept), "i4"))
            self.kept.append(k)
            ids.extend(own)
        self.ids = np.frombuffer(ids, "i4") if ids else np.zeros(0, "i4")
        none = [np.zeros(0, "i8")]
        self.begins, self.sizes, self.text_of = np.concatenate(begins or none), np.concatenate(sizes or none), np.concatenate(text_of or none)
        subs, counts = array("i"), array("i")
        for w in number:
            own = subwords(w)
            subs.extend(own)
            counts.append(len(own))
        self.subs, self.counts = np.frombuffer(subs or array("i", [0]), "i4"), np.frombuffer(counts or array("i", [0]), "i4").astype("i8")
        self.starts = np.cumsum(np.r_[0, self.counts])[:-1]

    def __len__(self) -> int:
        return len(self.begins)

    def flat(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the chosen windows: words that occur, the place of each token's word among them, its window, sizes."""
        sizes = self.sizes[chosen].astype("i8")
        at = np.repeat(self.begins[chosen] - np.cumsum(np.r_[0, sizes])[:-1], sizes) + np.arange(sizes.sum())
        used, place = np.unique(self.ids[at], return_inverse=True)
        return used, place, np.repeat(np.arange(len(chosen)), sizes), sizes

    def buckets(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[used]
        at = np.repeat(self.starts[used] - np.cumsum(np.r_[0, counts])[:-1], counts) + np.arange(counts.sum())
        return self.subs[at], counts

    def met(self) -> np.ndarray:
        """In how many texts each bucket occurs."""
        out = np.zeros(BUCKETS)
        edges = np.flatnonzero(np.r_[True, self.text_of[1:] != self.text_of[:-1]])
        for a, b in zip(self.begins[edges], [*self.begins[edges[1:]], len(self.ids)], strict=True):
            out[np.unique(self.buckets(np.unique(self.ids[a:b]))[0])] += 1
        return out


def _sum_rows(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1)


class _Trainer:
    """Adagrad on the cross-entropy of windows."""

    def __init__(self, bags: _Bags, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bags, self.random = bags, r
        self.e = r.normal(0, 0.3 / DIM, (BUCKETS, DIM))
        self.w, self.b = r.normal(0, 0.3, (DIM, 2)), np.zeros(2)
        self.ge, self.gw, self.gb = np.full((BUCKETS, 1), 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)

    def _vectors(self, chosen: np.ndarray):
        used, place, window, sizes = self.bags.flat(chosen)
        subs, counts = self.bags.buckets(used)
        word = np.add.reduceat(self.e[subs], np.cumsum(np.r_[0, counts])[:-1]) / counts[:, None]
        return used, place, window, sizes, subs, counts, _sum_rows(window, word[place], len(chosen)) / sizes[:, None]

    def logits(self) -> np.ndarray:
        out = np.zeros(len(self.bags))
        for i in range(0, len(out), 4096):
            chosen = np.arange(i, min(i + 4096, len(out)))
            z = self._vectors(chosen)[-1] @ self.w + self.b
            out[chosen] = z[:, 1] - z[:, 0]
        return out

    def epoch(self, chosen: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float, steps: int = 150) -> None:
        size = int(np.clip(len(chosen) / steps, 16, 512))
        order = self.random.permutation(len(chosen))
        for i in range(0, len(order), size):
            k = order[i : i + size]
            used, place, window, sizes, subs, counts, v = self._vectors(chosen[k])
            z = v @ self.w + self.b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(k)), label[k]] -= 1
            p *= weight[k][:, None]
            gw, gb, gv = v.T @ p, p.sum(0), (p @ self.w.T) / sizes[:, None]
            word = _sum_rows(place, gv[window], len(used)) / counts[:, None]
            touched, at = np.unique(subs, return_inverse=True)
            ge = _sum_rows(at, np.repeat(word, counts, axis=0), len(touched))
            self.ge[touched] += (ge * ge).mean(1, keepdims=True)
            self.e[touched] -= rate * ge / np.sqrt(self.ge[touched])
            self.gw += gw * gw
            self.w -= rate * gw / np.sqrt(self.gw)
            self.gb += gb * gb
            self.b -= rate * gb / np.sqrt(self.gb)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic map by Newton steps, both classes weighted alike, with a light prior."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b, centre, spread = 1.0, 0.0, x.mean(), max(x.std(), 1e-6)
    x = (x - centre) / spread
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a / spread), float(b - a * centre / spread)


def train(texts: list[str | None], labels: list[int], rounds: int = 6, rate: float = 0.25, seed: int = 1) -> ToxicityModel:
    """Fit on texts with labels 0 and 1. Without both classes every text scores the share of label 1."""
    y = np.array(labels, "i8")
    if len(np.unique(y)) < 2:
        return ToxicityModel(np.zeros(BUCKETS, "f4"), 0.0, 0.0, 20.0 * (2 * y.mean() - 1) if len(y) else -20.0)
    order = np.random.default_rng(seed).permutation(len(y))
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        own = order[y[order] == c]
        held[own[: len(own) // 5]] = True
    fit = np.flatnonzero(~held)
    bags = _Bags(texts[i] for i in fit)
    yt = y[fit][bags.kept]
    trainer, negative = _Trainer(bags, seed), np.flatnonzero(yt[bags.text_of] == 0)
    positive = np.flatnonzero(yt[bags.text_of] == 1)
    chosen = positive
    for k in range(rounds):
        if k:
            logit = trainer.logits()
            best = np.full(len(yt), -np.inf)
            np.maximum.at(best, bags.text_of, logit)
            chosen = positive[(logit[positive] >= best[bags.text_of[positive]] - 1e-9) | (logit[positive] > 0)]
        most = NEGATIVES * len(chosen)
        some = negative if len(negative) <= most else trainer.random.choice(negative, most, replace=False)
        if k and len(negative) > len(some):  # and those negatives that look most toxic now
            some = np.union1d(some, negative[np.argsort(-logit[negative])[: len(chosen)]])
        both = np.r_[chosen, some]
        label = np.r_[np.ones(len(chosen), "i8"), np.zeros(len(some), "i8")]
        weight = np.where(label == 1, len(both) / (2 * len(chosen)), len(both) / (2 * len(some)))
        trainer.epoch(both, label, np.sqrt(weight), rate)
    met = bags.met()
    values = (trainer.e @ (trainer.w[:, 1] - trainer.w[:, 0]) * met / (met + SUPPORT)).astype("f4")
    model = ToxicityModel(values, float(trainer.b[1] - trainer.b[0]), 1.0, 0.0)
    check = np.flatnonzero(held) if len(np.unique(y[held])) == 2 else np.arange(len(y))
    model.slope, model.intercept = _logistic(np.array([model.logit(texts[i]) for i in check]), y[check])
    return model


def held_out(col: str):
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Texts and labels of at most ``bounds[label]`` ids of each label, chosen by a hash of the id, held-out ids
    excepted; of the rows of an id one. What reaches the driver is bounded by rows and by ``most_bytes`` of text. The
    sampled rows are written, so that all documents are read once. More than GRADES different labels raise ValueError."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"), (F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / (1 << 20)).alias("u")).distinct()
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(GRADES + 1).collect()}
    if len(counts) > GRADES:
        raise ValueError(f"{label} has more than {GRADES} grades")
    share = {y: min(1.0, bounds.get(y, 0) / n) for y, n in counts.items()}
    wanted = F.lit(False)
    for y, s in share.items():
        wanted = wanted | ((F.col("y") == y) & (F.col("u") < s))
    # Thinned by the hash to about ``bounds`` rows, so these windows hold few rows at any size of the input.
    place = F.row_number().over(Window.partitionBy("y").orderBy("u", "id"))
    limit = F.create_map(*[F.lit(v) for y in share for v in (y, bounds.get(y, 0))] or [F.lit(0), F.lit(0)])[F.col("y")]
    sample = known.where(wanted).withColumn("place", place).where(F.col("place") <= limit)
    joined = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "id")
    # An id may have any number of rows; one text of each is enough.
    single = joined.groupBy("id", "y", "place").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    held = Stash(single, "sample")
    run = F.sum(F.octet_length("text")).over(Window.orderBy("place", "id", "y").rowsBetween(Window.unboundedPreceding, 0))
    found = sorted((r.text, r.y) for r in held.df.withColumn("run", run).where(F.col("run") <= most_bytes).select("text", "y").collect())
    held.drop()
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Train on a bounded sample of labelled documents."""
    rows = labelled_sample(docs, labels, label, {1: toxic_rows, 0: clean_rows}, sample_bytes, id_col, text_col)
    return train([t for t, _ in rows], [y for _, y in rows])


def with_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``; no column but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t) for t in values(b.column(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words. Repeated rows each keep their row; a null id stays
    null and counts as not held out. Labels that are null, or whose document is missing, are ignored; without labels
    of both classes nothing can be learnt and every text scores as the class there is (with none: 0). An empty table
    gives an empty result. Columns other than id and text are not looked at.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return with_scores(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more; all columns stay as they are.

    Each row is judged by its own text, so repeated rows go or stay alike and ids (null, or shared by rows) play no part
    in the score; they only lead to the labels. Null and empty texts score as texts without words. Labels that are null
    or whose document is missing are ignored; without labels of both classes every text scores as the class there is
    (with none: 0, and all rows stay). An empty table stays empty. Columns of any name may be there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < cut for t in values(b.column(text_col))], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
