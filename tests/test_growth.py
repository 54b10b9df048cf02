"""What queries shuffle, hold and write for larger inputs, and their results against SQL on odd ones."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import filters
from corpusloom.functions.hashing import murmur3_32, murmur3_minima
from corpusloom.operators import minhash, repetition, scoring, substring, vocab
from corpusloom.plans import extra  # noqa: F401  (registers more)
from corpusloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Writes (doc_id, text) rows as a folder that queries and DuckDB read."""

    def write(rows):
        d = tmp_path_factory.mktemp("documents")
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
        return str(d)

    return write


def plain(rows):
    same = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(same(v) for v in r) for r in rows), key=repr)


def sql(name, folder, **others):
    with duckdb.connect() as db:
        for table, path in others.items():
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        return plain(db.sql(ORACLES[name]).fetchall())


def agrees(spark, name, folder):
    assert plain(QUERIES[name](spark, folder).collect()) == sql(name, folder)


def shuffled(spark, run) -> tuple[int, int]:
    """Records and bytes that ``run()`` writes to shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        s = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in (s.apply(i) for i in range(s.size()))}

    before = stages()
    run()
    new = [v for k, v in stages().items() if k not in before]
    return sum(r for r, _ in new), sum(b for _, b in new)


def prose(seed, n, words=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


GRAMS = ["t1_char_5grams", "t2_byte_3grams", "t3_word_shingles", "t4_token_ngrams", "t5_nonword_split", "t15_lm_chunks"]


@pytest.mark.parametrize("name", GRAMS)
def test_grams_are_counted_in_their_row(spark, documents, name):
    folder = documents([(i, prose(i, 500)) for i in range(40)])
    records, _ = shuffled(spark, lambda: agrees(spark, name, folder))
    assert records < 1000


@pytest.mark.parametrize("name", GRAMS)
def test_grams_of_ids_that_several_rows_share(spark, documents, name):
    texts = [(1, "a b c d e f a b c d e f"), (1, "c d e f a b"), (2, "été 😀 á x"), (None, "a b c d e f g"), (None, "b c d e f g h"), (3, ""), (4, None), (5, "ab"), (5, ""), (6, "x"), (None, None)]
    agrees(spark, name, documents(texts))


#: Empty and null texts, marks, characters beyond 16 bits, a NUL, other line ends and blanks, repeated lines and words.
ODD = ["", None, " ", "\n", "\n\n", "a", "é", "á b́", "😀", "a😀b😀", "a\0b", "a\r\nb\r\nb", "  x　", "x\nx\ny\nx", "日本語のテキスト", "a b c d e f g h i j " * 6, "👨‍👩‍👧 🇩🇪", "﻿a", "the the the the", "ab\n\nab\n\n", prose(1, 300), prose(2, 60, 5)]


@pytest.mark.parametrize("name", ["a2_duplicate_line_chars", "f3_ascii_filter", "f3_ascii_filter_as_written", "f3_ascii_percent", "t6_code_points", "f10_repetition_filter", "a3_top_2gram", "a4_covered_5gram"])
def test_odd_texts_against_sql(spark, documents, name):
    agrees(spark, name, documents(list(enumerate(ODD))))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def greedy(ids, data):
    at, out = 0, []
    while at < len(data):
        n = next((n for n in range(len(data) - at, 0, -1) if data[at : at + n] in ids), 0)
        out.append(ids[data[at : at + n]] if n else data[at] + 1)
        at += n or 1
    return out


@pytest.mark.parametrize("glue", ["", " "])
def test_longest_match_against_all_lengths(glue):
    """Tokens that begin alike, also with blanks in them; pieces are remembered, forgotten and met again."""
    draw = random.Random(4)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    words = {some("abé" + glue, draw.randint(1, 6)) for _ in range(60)} | {" "}
    t = vocab.LongestMatch([(w, 300 + i) for i, w in enumerate(sorted(words))], most=5)
    assert t.apart == (not glue)
    for _ in range(200):
        text = some("abéc \n😀", draw.randint(0, 90))
        assert t.encode(text) == greedy(t.ids, text.encode()) and t.decode(t.encode(text)) == text


def test_longest_match_encodes_a_text_once(spark):
    df = QUERIES["t12_longest_match"](spark, "/root/testdata/sf0.001")
    assert "decode(encode" not in plan_of(df)
    assert df.where("same").count() == df.count() == 200


@pytest.mark.parametrize("name", ["db_blacklist", "h23_packed_signatures", "a10_merged_signature"])
def test_a_signature_is_computed_once(spark, name):
    assert plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")).count("sign(text") == 1


def test_minima_against_plain_arithmetic():
    draw = np.random.RandomState(3)
    h = np.r_[0, (1 << 28) - 1, draw.randint(0, 1 << 28, 3000)].astype("u8")
    pairs = [*minhash.permutations(30), (1 << 28, 1 << 28), (1, 0), (1 << 28, 0)]
    a, b = np.array(pairs, "u8").T[:, :, None]
    assert minhash.affine_31(h, a, b, 100).tolist() == [min((int(v) * x + y) % minhash.PRIME for v in h) for x, y in pairs]
    seeds, grams = np.arange(40, dtype="u4"), [bytes(draw.randint(0, 256, n).tolist()) for n in (0, 1, 3, 4, 5, 5, 5, 8, 9, 15, 20)] * 30
    for signed, kind in ((False, "u4"), (True, "i4")):
        assert murmur3_minima(grams, seeds, signed, 7).tolist() == murmur3_32(grams, seeds).view(kind).min(axis=0).tolist()


def test_similarities_of_sets_in_steps(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    draw = random.Random(6)
    x, y = ([np.array(sorted(draw.sample(range(90), draw.randint(1, 60)))) for _ in range(n)] for n in (7, 5))
    want = [[len(set(p) & set(q)) / len(set(p) | set(q)) for q in y] for p in x]
    assert np.allclose(minhash._similarities(x, y, True), want)


def test_tags_are_python_objects_for_a_few_rows_only(spark, documents):
    """The tagger of a long batch holds the tags of 64 rows at most; the result is SQL's."""
    agrees(spark, "f7_sentence_check", documents([(i, t) for i, t in enumerate([*ODD, "of to", "of x", "x is y", "der"] * 40)]))
    calls = []

    def tagger(text):
        import gc

        calls.append(sum(isinstance(x, dict) and set(x) == {"tag", "detail"} for x in gc.get_objects()))
        return [(w, "") for w in text.split()]

    import pyarrow as pa

    out = filters.tag_lines(tagger).func(pa.array([None, *["a b c"] * 200]))
    assert len(out) == 201 and out[0].as_py() is None and out[200].as_py() == [{"tag": w, "detail": ""} for w in "abc"] and max(calls) == 0


def test_backoff_scores_in_rows_and_by_joins(spark, documents, monkeypatch):
    """A small model goes to the workers and no gram is shuffled; a larger one is joined, with the same scores. Both against SQL."""
    items = [prose(9, 40, 30), "a b c d e f g h i j", "the the", "été 😀"]
    folder = documents([(i, t) for i, t in enumerate([*ODD, *(prose(i, 200, 60) for i in range(40))]) if t is not None])
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    want = sql("a9_backoff_perplexity", folder, benchmark=f"{folder}/benchmark.parquet/*.parquet")
    for most in (scoring.MODEL_BYTES, 0):
        monkeypatch.setattr(scoring, "MODEL_BYTES", most)
        got = []
        records, _ = shuffled(spark, lambda: got.extend(QUERIES["a9_backoff_perplexity"](spark, folder).collect()))  # noqa: B023
        got = plain(got)
        assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
        assert (records < 1000) == (most > 0)


def test_rules_of_ngrams_that_do_not_repeat_are_not_tried(spark):
    texts = [prose(1, 80, 2000), "a b c a b d", "a b c d e a b c d f", "a a", "a", " ".join("abcdefghijk" * 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "split(text, ' ') w")
    for n in (2, 3, 4, 5, 10):
        got = {r.doc_id: r.x for r in df.select("doc_id", repetition.may_repeat(F.col("w"), n).alias("x")).collect()}
        grams = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in map(str.split, texts)]
        assert got == {i: len(set(g)) < len(g) for i, g in enumerate(grams)}


@pytest.mark.parametrize("chunk", [1, 300, substring.CHUNK])
def test_repeated_spans_shuffle_no_row_for_a_passage(spark, documents, monkeypatch, chunk):
    """Passages within a text, within a task and between tasks, and runs that overlap, touch and lie apart; null ids too."""
    monkeypatch.setattr(substring, "CHUNK", chunk)
    shared, other = prose(1, 45), prose(2, 25)
    texts = [shared, f"{prose(3, 30)} {shared} {prose(4, 21)} {other}", f"{other} {other}", prose(5, 19), prose(6, 20), prose(6, 20), "the " * 70, f"x\n{shared}", *(prose(i, 60) for i in range(20, 50)), *ODD]
    folder = documents([(i if i != 2 else None, t) for i, t in enumerate(texts)])
    records, _ = shuffled(spark, lambda: agrees(spark, "dj_repeated_spans", folder))
    assert chunk == 1 or records < 600
