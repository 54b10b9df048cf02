import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.functions import filters as f, hashing as h, ngrams as g, normalize as n, similarity as m


def values(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", expr(F.col("text")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_normalize(spark):
    assert values(spark, ["Hello, world!", "Hello, 123!\n\t\b", None], n.normalize_classes) == ["hello world", "hello 000", None]
    assert values(spark, ["ｱﾊﾟｰﾄ㈱", "１２é"], lambda c: n.normalize(c)) == ["アパート(株)", "12é"]
    assert values(spark, ["a\x00b\nc\x85"], n.remove_control) == ["ab\nc"]
    assert values(spark, ["「はい」…"], n.replace_unicode_punct) == ['"はい"...']
    assert values(spark, ["汉字", "漢字"], n.is_simplified_chinese) == [True, False]


def test_urls(spark):
    urls = ["http://www.hello.cn/bora.index", "http://dora.muda.ru/aaaa/bora.index", "http://dora.muda.info/ccc", "http://www.muda.com/dd", "http://2ch.net/ee", "http://akibamatome.com/ee", "no url", "http://1.2.3.4/x", "http://x.com.cn/", None]
    assert values(spark, urls, f.url_is_bad) == [True, True, True, False, True, True, True, True, False, True]


def test_read_more_lines(spark):
    assert values(spark, ["続きを読む他のユーザーは", '続きを読む "他のユーザー"は'], f.strip_starts) == ["他のユーザーは", ' "他のユーザー"は']
    assert values(spark, ["... 続きを読む"], f.strip_ends) == ["... "]
    assert values(spark, ["aa ...(続きを表示)bb", "aa ...(続きを表bb"], f.linewise_clean) == [None, "aa ...(続きを表bb"]


def test_line_filters(spark):
    assert values(spark, ["a.\nb...\nc,\nd e f g.\nh!"], f.keep_terminated_lines) == ["a.\nh!"]
    assert values(spark, ["", "a", "a" * 10 + "é"], f.too_ascii) == [False, True, True]
    assert values(spark, ["abcde\n\nabcde", "abcde\nabcdef"], f.line_lengths_are_ok) == [False, True]


def test_ngrams(spark):
    assert len(values(spark, ["おはようございます。"], lambda c: g.char_ngrams(c, 3))[0]) == 8
    assert values(spark, ["おはよ", ""], lambda c: g.char_ngrams(c, 5, "whole")) == [["おはよ"], [""]]
    tokens = lambda c: F.split(c, " ")
    assert values(spark, ["a b c d"], lambda c: g.token_ngrams(tokens(c), 2, 1)) == [["a b", "b c", "c d"]]
    assert values(spark, ["a b c d"], lambda c: g.token_ngrams(tokens(c), 2, 5)) == [[]]
    assert values(spark, ["a b"], lambda c: g.token_ngrams(tokens(c), 3, 1)) == [["a b"]]


def test_hashes(spark):
    assert h.sha1_bits(b"hello world", 32) == 896314922 and h.sha1_bits(b"hello world", 64) == 13028719972609469994
    assert h.xxh3_bits(b"hello world", 16) == 39051 and h.xxh3_bits(b"hello world", 32) == 1088854155 and h.xxh3_bits(b"hello world", 32, 42) == 3913102222
    assert values(spark, ["hello world"], h.sha1_32) == [896314922]
    assert h.fnv1a_32(b"a") == 0xE40C292C and h.fnv1a_64(b"a") == 0xAF63DC4C8601EC8C
    assert h.murmur3_32([b"", b"test", b"hello"], np.array([0, 1], "u4")).tolist() == [[0, 0x514E28B7], [0xBA6BD213, 0x99C02AE2], [0x248BFA47, 0xBB4ABCAD]]
    assert h.murmur3_x64_128(b"", 0) == (0, 0)
    assert values(spark, ["abc"], lambda c: F.xxhash64(c))[0] % 2**64 == xxhash.xxh64_intdigest(b"abc", 42)


def test_bands():
    assert h.optimal_bands(0.7, 256) == (25, 10) and h.optimal_bands(0.75, 256) == (21, 12) and h.optimal_bands(0.75, 256, 0.1, 0.9) == (28, 9)


def test_similarities(spark):
    assert m.osa_distance("ca", "abc") == 3 and m.edit_distance("kitten", "sitting") == 3 and m.common_subsequence("abcde", "ace") == 3
    df = spark.createDataFrame([("ab", "ba"), ("", ""), ("abc", "ab")], "a string, b string")
    rows = df.select(m.damerau("a", "b").alias("d"), m.lcs_similarity("a", "b").alias("l"), m.hamming_similarity(F.col("a"), F.col("b")).alias("h")).collect()
    assert [(r.d, round(r.l, 3), r.h) for r in rows] == [(1, 0.5, 0.0), (0, 1.0, 1.0), (1, 0.667, -1.0)]
    assert pytest.approx(h.band_threshold(16, 8), 1e-6) == (1 / 16) ** (1 / 8)


def test_character_and_byte_ngrams_of_any_text(spark):
    texts = [None, "", "ab", "abc", "a\n\U0001f600b", "éあ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("text", g.char_ngrams(F.col("text"), 3).alias("c"), g.byte_ngrams(F.col("text"), 3).alias("b")).collect()
    for r in rows:
        t, raw = r.text or "", (r.text or "").encode()
        assert r.c == [t[i : i + 3] for i in range(len(t) - 2)]
        if raw:
            assert r.b == [raw[i : i + 3].hex().upper() for i in range(max(1, len(raw) - 2))]
        else:
            assert not r.b


def test_token_ngrams_of_few_tokens(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "t array<string>")
    assert [r[0] for r in df.select(g.token_ngrams(F.col("t"), 2)).collect()] == [[], ["a"], ["a b", "b c"]]
