import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dialogue, minhash, repetition, scoring, simhash, substring, vocab
from corpusloom.operators.graph import connected_components
from corpusloom.plans.ordering import numbered_within
from corpusloom.sources import text as src


def test_components_against_union_find(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(120)] + [(500, 500), (None, 3)] + [(600, 600 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_numbering_with_a_hot_group(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 10) as g", "id")
    rows = numbered_within(df, "g", ["id"]).toPandas().sort_values("id")
    assert (rows["rank"].values == rows.groupby("g").cumcount().values).all() and len(rows) == 3000


def test_bucket_minhash_goldens(spark):
    texts = ["吾輩は猫である。名前はまだ無い。どこで生まれたかとんと見当がつかぬ。", "吾輩は鳥である。名前はまだ無い。どこで生まれたかとんと見当がつかぬ。", "祇園精舎の鐘の声、諸行無常の響きあり。"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = {r.doc_id: r.s for r in df.select("doc_id", minhash.prefixed_signature(F.col("text")).alias("s")).collect()}
    assert p[0][0] == "0+f853f485e9c1bcbabcc880c1b8675d2c994432f4" and p[0][19] == "19+4bab81afbdacfbc514026b6ea4aac131861d9f00"
    assert p[1][5] == p[0][5] == "5+b431267e6ef558fdbb8a02655e31fb4f977e9a1f" and p[2][10] == "10+9473f3b92bd73330e3a4c53990d3d400e3c01e4f"
    b = {r.doc_id: r.s for r in df.select("doc_id", minhash.bucket_signature(F.col("text")).alias("s")).collect()}
    assert sum(x == y for x, y in zip(b[0], b[1], strict=True)) == 3 and len(b[0]) == 20


def test_flags_equal_a_sequential_pass(spark):
    r = random.Random(9)
    docs = [(i, k, f"v{r.randint(0, 60)}") for i in range(80) for k in range(3)]
    for pooled in (False, True):
        seen, want = set(), {}
        for i in range(80):
            keys = [(None if pooled else k, v) for d, k, v in docs if d == i]
            want[i] = any(x in seen for x in keys) or len(set(keys)) < len(keys)
            seen |= set(keys)
        got = {x.id: x.duplicate for x in minhash.flags(spark.createDataFrame(docs, "id long, band int, key string"), pooled).collect()}
        assert got == want


def test_simhash_majority_golden():
    assert simhash.majority_of(np.array([13352372148217134600, 5020219685658847592], "u8")) == 74633958390507528


def test_intervals(spark):
    rows = [("a", i, i + 10) for i in range(7)] + [("a", 7, 21), ("b", 0, 2), ("b", 2, 4), ("b", 4, 5), ("c", 0, 4), ("c", 2, 4), ("c", 4, 5), ("d", 0, 10), ("d", 0, 10)]
    df = spark.createDataFrame(rows, "k string, start long, stop long")
    over = sorted(tuple(r) for r in substring.merge_intervals(df, "k").collect())
    assert over == [("a", 0, 21), ("b", 0, 5), ("c", 0, 5), ("d", 0, 10)]
    longest = sorted(tuple(r) for r in substring.merge_intervals(df.where("k in ('a','c','d')"), "k", strategy="longest").collect())
    assert longest == [("a", i, i + 10) for i in range(7)] + [("a", 7, 21), ("c", 0, 4), ("c", 4, 5), ("d", 0, 10)]


def test_restore_and_cut(spark):
    bounds = spark.createDataFrame([(0, 0, 10), (1, 10, 20)], "doc_id long, start long, stop long")
    seg = spark.createDataFrame([(0, 5), (5, 10), (5, 15), (5, 19)], "start long, stop long")
    assert sorted(tuple(r) for r in substring.clip_to_documents(seg, bounds).collect()) == [(0, 0, 5), (0, 5, 10), (1, 0, 5), (1, 0, 9)]
    seg = spark.createDataFrame([(0, 5), (5, 10), (12, 19)], "start long, stop long")
    assert sorted(tuple(r) for r in substring.restore_and_merge(seg, bounds, 5).collect()) == [(0, 0, 10), (1, 2, 9)]
    df = spark.createDataFrame([("This is a test.", [(0, 4), (5, 7)])], "t string, s array<struct<start:int,stop:int>>")
    assert df.select(substring.cut_bytes(F.col("t"), F.col("s")).alias("x")).first().x == "  a test."


def test_suffix_array(spark):
    texts = ["banana", "aaa", "abab", "", "mississippi"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", substring.suffix_array(F.col("t")).alias("s")).collect()
    assert all(list(r.s) == sorted(range(len(r.t)), key=lambda i, t=r.t: t[i:]) for r in got)


def test_repetition_and_bins(spark):
    df = spark.createDataFrame([(1, "a b\na b\nc"), (2, "x y z"), (3, "")], "doc_id long, text string")
    assert [r.repetitive for r in repetition.is_repetitive(df).orderBy("doc_id").collect()] == [True, False, False]
    scores = spark.range(100).selectExpr("cast(id as double) as s")
    edges = scoring.bin_edges(scores, "s", 4)
    assert edges == [0, 24.75, 49.5, 74.25, 99]
    bins = scores.select(scoring.assign_bin(F.col("s"), edges).alias("b")).toPandas()["b"]
    assert bins.min() == 1 and bins.max() == 4


def test_vocab_round_trip():
    t = vocab.LongestMatch([("あ", 300), ("あい", 301), ("a", 302), ("abc", 303)])
    assert t.encode("あいabcab") == [301, 303, 302, ord("b") + 1]
    assert t.decode(t.encode("あいうxabc é")) == "あいうxabc é"


def test_dialogue_pieces(spark):
    df = spark.createDataFrame([("do it", "", "x"), ("do it", "this", "x")], "a string, b string, c string")
    rows = [r.p for r in df.select(dialogue.instruction_prompt(F.col("a"), F.col("b")).alias("p")).collect()]
    assert rows[0] == dialogue.WITHOUT_INPUT.format(instruction="do it") and rows[1] == dialogue.WITH_INPUT.format(instruction="do it", input="this")


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n two \n\nthree\n\n\n\nfour\nfive", encoding="utf-8")
    assert sorted(r.text for r in src.read_blank_line_documents(spark, str(tmp_path / "a.txt")).collect()) == ["four\nfive", "one\ntwo", "three"]
    df = spark.createDataFrame([(i, f"téxt\n{i}" if i else None) for i in range(10)], "id long, text string")
    paths = src.write_zstd_json_lines(df.coalesce(1), str(tmp_path / "z"), per_file=4)
    assert len(paths) == 3
    assert sorted(map(tuple, src.read_json_lines(spark, str(tmp_path / "z"), "id long, text string").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    ids, size = src.unpack_tokens(src.pack_tokens([np.arange(8), np.arange(8)], "u2", 8))
    assert ids.tolist() == [*range(8)] * 2 and size == 8
    with pytest.raises(ValueError):
        src.unpack_tokens(b"x" * 30)
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>T</title><id>7</id><revision><text>x\n[[Category:A]]\n[[Category:B]]</text></revision></page><page><title>U</title><id>8</id><revision><text>y</text></revision></page></mediawiki>")
    assert [tuple(r) for r in src.read_wikipedia_categories(spark, str(tmp_path / "w.xml")).collect()] == [("T", 7, "[[Category:A]][[Category:B]]")]


def test_streaming_exact(spark, tmp_path):
    from corpusloom.streaming.dedup import exact_within_watermark

    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "text string, s int").selectExpr("text", "timestamp_seconds(s) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in"))
    q = exact_within_watermark(stream, "text", "ts").writeStream.format("memory").queryName("exact_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.table("exact_out").collect()) == ["a", "b"]
