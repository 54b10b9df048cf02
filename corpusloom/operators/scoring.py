"""Language-model scores, quantile bins, splits and the joins of the corpus stages."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.ngrams import whitespace_words
from corpusloom.plans.ordering import running_sums
from corpusloom.plans.storage import Stash, once, spread


def perplexity(log10_sum: Column, tokens: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), -log10_sum / tokens), 1)


def bigram_model(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((word, n), (w1, w2, n)): counts of words and of neighbouring words, summed before the shuffle."""
    w = docs.select(F.concat(F.array(F.lit("<s>")), whitespace_words(F.lower(text_col)), F.array(F.lit("</s>"))).alias("w"))
    pairs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("w1"), F.get("w", i).alias("w2")))).alias("p")).select("p.*")
    two = pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    return two.groupBy(F.col("w1").alias("word")).agg(F.sum("n").alias("n")), two


def ngram_counts(docs: DataFrame, order: int, text_col: str = "text", words=None) -> DataFrame:
    """n, gram, count: word n-grams of 1..order in texts framed by <s> and </s>, summed before the shuffle.

    ``words`` cuts a text (white space by default); grams are words joined by blanks.
    """
    cut = whitespace_words if words is None else words
    w = docs.select(F.concat(F.array(F.lit("<s>")), cut(F.col(text_col)), F.array(F.lit("</s>"))).alias("w")).where("w is not null")
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.struct(F.lit(k).alias("n"), F.array_join(F.slice("w", i, F.lit(k)), " ").alias("gram")))
    lists = [F.when(F.size("w") >= k, of(k)).otherwise(F.array().cast("array<struct<n:int,gram:string>>")) for k in range(1, order + 1)]
    return w.select(F.inline(F.concat(*lists))).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("count"))


#: Bytes of grams that are held as a dict by every worker.
MODEL_BYTES = 16 << 20


def _scored_in_rows(docs: DataFrame, counts: dict[str, int], total: int, order: int, back_off: float, id_col: str, text_col: str) -> DataFrame:
    """id, s (the sum of the words' scores), k (words) of every row of which a word has a score."""
    scores: dict[str, float | None] = {}
    for gram, count in counts.items():
        before = gram.rpartition(" ")[0]
        below = counts.get(before) if before else total
        scores[gram] = None if below is None else math.log10(count / below)  # as in a join: without its context a gram has no score
    shared = docs.sparkSession.sparkContext.broadcast((scores, {g.rpartition(" ")[2] for g in counts}))
    dropped, unseen, find = math.log10(back_off), math.log10(0.5 / total), re.compile(r"[^ \t\n\x0b\f\r]+").findall

    @F.arrow_udf("struct<s:double,k:long>")
    def score(texts: pa.Array) -> pa.Array:
        (held, last), s, k = shared.value, [], []
        for text in texts:
            w = ["<s>", *find(text.as_py() or ""), "</s>"]
            parts, lost = [], 0
            for i in range(1, len(w)):
                most = min(order, i + 1)
                if w[i] in last:
                    for n in range(most, 0, -1):
                        gram = " ".join(w[i - n + 1 : i + 1])
                        if gram in held:
                            one = held[gram]
                            if one is None:
                                lost += 1
                            else:
                                parts.append(one + (most - n) * dropped)
                            break
                    else:
                        parts.append(unseen + (most - 1) * dropped)
                else:
                    parts.append(unseen + (most - 1) * dropped)
            s.append(math.fsum(parts))
            k.append(len(w) - 1 - lost)
        return pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(k, pa.int64())], ["s", "k"])

    rows = once(spread(docs), "x", score(F.col(text_col)), F.col(id_col).alias("id")).where("x.k > 0")
    return rows.select("id", "x.*")


def backoff_scores(docs: DataFrame, counts: DataFrame, order: int, back_off: float = 0.4, id_col: str = "doc_id", text_col: str = "text", words=None) -> DataFrame:
    """id, log10_score, tokens, perplexity under n-gram ``counts`` (of ``ngram_counts``).

    A word's score is the relative frequency of the longest n-gram that ends with it and occurs in the counts, times
    ``back_off`` for every word of context dropped; a word that does not occur at all counts as half an occurrence. The
    end mark is scored like a word, the start mark is only context. ``counts`` may be any model of that form, so another
    corpus or another order of smoothing can be plugged in. Counts of up to MODEL_BYTES go to all workers, and a text is
    scored in its row; larger ones, and those of words that another function cuts, are joined to a text's distinct grams.
    """
    cut = whitespace_words if words is None else words
    model = counts.select("gram", "count")
    figures = counts.agg(F.sum(F.when((F.col("n") == 1) & (F.col("gram") != "<s>"), F.col("count"))).alias("total"), F.sum(F.octet_length("gram")).alias("bytes")).first()  # two numbers
    total = figures.total or 1
    if words is None and (figures.bytes or 0) <= MODEL_BYTES:
        return _summed(_scored_in_rows(docs, {r.gram: r["count"] for r in model.collect()}, total, order, back_off, id_col, text_col), id_col)
    framed = docs.select(F.col(id_col).alias("id"), F.concat(F.array(F.lit("<s>")), F.coalesce(cut(F.col(text_col)), F.array().cast("array<string>")), F.array(F.lit("</s>"))).alias("w"))
    tail = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.slice("w", F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))))
    level = framed.select("id", F.explode(tail).alias("t")).groupBy("id", "t").agg(F.count(F.lit(1)).alias("k")).withColumn("drops", F.lit(0))
    scored = None
    for n in range(order, 0, -1):
        level = Stash(level, "grams").df
        own, rest = level.where(F.size("t") == n), level.where(F.size("t") < n)
        with_counts = own.withColumn("gram", F.array_join("t", " ")).join(model, "gram", "left")
        if n > 1:
            context = model.toDF("context", "below")
            hits = with_counts.where("count is not null").withColumn("context", F.array_join(F.slice("t", 1, n - 1), " ")).join(context, "context")
            part = hits.select("id", "k", (F.log10(F.col("count") / F.col("below")) + F.col("drops") * math.log10(back_off)).alias("s"))
            shorter = with_counts.where("count is null").select("id", F.slice("t", 2, n - 1).alias("t"), "k", (F.col("drops") + 1).alias("drops"))
            level = rest.unionByName(shorter)
        else:
            part = with_counts.select("id", "k", (F.log10(F.coalesce(F.col("count"), F.lit(0.5)) / total) + F.col("drops") * math.log10(back_off)).alias("s"))
        scored = part if scored is None else scored.unionByName(part)
    return _summed(scored.select("id", (F.col("s") * F.col("k")).alias("s"), "k"), id_col)


def _summed(scored: DataFrame, id_col: str) -> DataFrame:
    sums = scored.groupBy("id").agg(F.sum("s").alias("log10_score"), F.sum("k").alias("tokens"))
    return sums.select(F.col("id").alias(id_col), "log10_score", "tokens", perplexity(F.col("log10_score"), F.col("tokens")).alias("perplexity"))


def unigram_perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: DataFrame | None = None) -> DataFrame:
    """id, perplexity under a unigram model with one added to each count, end of text included in the length.

    The model is joined to the counts of (document, word), so a frequent word costs a row per document and task.
    """
    words = lambda d: d.select(*([id_col] if id_col in d.columns else []), F.explode(whitespace_words(F.lower(text_col))).alias("word"))
    own = words(docs).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("k"))
    model = words(train if train is not None else docs).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    totals = model.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("vocabulary"))
    joined = own.join(model, "word", "left").join(F.broadcast(totals))  # one row
    p = F.log10((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("vocabulary") + 1))
    sums = joined.groupBy(id_col).agg(F.sum(p * F.col("k")).alias("logp"), F.sum("k").alias("tokens"))
    return sums.select(id_col, perplexity(F.col("logp"), F.col("tokens") + 1).alias("perplexity"))


def bin_edges(df: DataFrame, score: str, bins: int = 32, exact: bool = True, accuracy: int = 100_000) -> list[float]:
    """Distinct quantile edges with linear interpolation; with ``exact=False`` from a mergeable sketch.

    The exact form counts each value first, so equal scores are one row, and finds the few ranks that matter from running
    sums over value ranges; no buffer holds the distinct values. Nulls are ignored; of no values there are no edges.
    """
    q = [i / bins for i in range(bins + 1)]
    if not exact:
        values = df.agg(F.percentile_approx(F.col(score).cast("double"), q, accuracy).alias("e")).first().e
        return sorted(set(values)) if values else []
    counts = df.select(F.col(score).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, ["v"], "n", "before")
    n = ranked.agg(F.max(F.col("before") + F.col("n")).alias("n")).first().n
    if not n:
        return []
    wanted = sorted({r for x in q for r in (math.floor(x * (n - 1)), math.ceil(x * (n - 1)))})
    held = F.filter(F.array(*map(F.lit, wanted)), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    at = {r.rank: r.v for r in ranked.select("v", F.explode(held).alias("rank")).collect()}  # two ranks per edge at most
    place = [(math.floor(x * (n - 1)), math.ceil(x * (n - 1)), x * (n - 1)) for x in q]
    return sorted({at[a] + (at[b] - at[a]) * (x - a) for a, b, x in place})


def assign_bin(score: Column, edges: list[float]) -> Column:
    """How many edges are not above the score, at most the last bin's number."""
    n = sum((F.when(score >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.least(n, F.lit(max(len(edges) - 1, 0)))


def join_sidecars(text: DataFrame, *sidecars: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text with its score and duplicate sidecars by id; ``unmatched`` tells what a join would lose."""
    for s in sidecars:
        text = text.join(s, key)
    return text


def unmatched(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of one side only (key, side)."""
    side = lambda x, y, s: x.select(key).join(y.select(key), key, "left_anti").withColumn("side", F.lit(s))
    return side(a, b, "left").union(side(b, a, "right"))


def hash_split(id_col: Column, weights: dict[str, float], salt: str = "") -> Column:
    """A split that depends on the id alone: the first seven hex digits of its MD5 cut [0, 1)."""
    u = F.conv(F.left(F.md5(F.concat(F.lit(salt), id_col.cast("string"))), F.lit(7)), 16, 10).cast("double") / (1 << 28)
    total, at, out = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        at += weights[name] / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def hash_order(id_col: Column, salt: str = "") -> Column:
    """A key whose order is a fixed shuffle."""
    return F.md5(F.concat(F.lit(salt), id_col.cast("string")))


def weighted_mix(parts: dict[str, tuple[DataFrame, float]], id_col: str = "doc_id", salt: str = "mix") -> DataFrame:
    """Union of corpora, each thinned by the id's hash to its weight relative to the greatest."""
    top = max(w for _, w in parts.values())
    out = None
    for name, (df, w) in parts.items():
        part = df.where(hash_split(F.col(id_col), {"in": w, "out": max(top - w, 0.0)}, f"{salt}{name}") == "in" if w < top else F.lit(True)).withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stage_counts(df: DataFrame, stage: str, kept: Column) -> DataFrame:
    return df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_in"), F.count_if(kept).alias("n_out"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a))


def top_by(df: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an order: a sample of bounded size that is the same every time."""
    return df.orderBy(*order).limit(n)


def sized_split(df: DataFrame, eval_rows: int, id_col: str = "doc_id", salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(train, eval): ``eval_rows`` rows, those with the least hash of their id, are held out. Distinct, non-null ids."""
    held = df.select(id_col, hash_order(F.col(id_col), salt).alias("__h")).orderBy("__h", id_col).limit(eval_rows).select(id_col)
    return df.join(held, id_col, "left_anti"), df.join(held, id_col, "left_semi")
