"""Fixtures for what the tables of the driver do not hold: white space and digits of all scripts, hot groups, sinks,
models, dictionaries and streams."""

import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import filters as f, hashing as h, ngrams as g, normalize as n
from corpusloom.operators import bloom, dedup, dialogue, minhash, repetition, scoring, simhash, substring, vocab
from corpusloom.operators.graph import connected_components
from corpusloom.plans.ordering import numbered, running_sums
from corpusloom.sources import text as src
from corpusloom.streaming.dedup import flag_against_table, windowed_counts


def values(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", expr(F.col("text")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- normalisation ---------------------------------------------------------------------------------------------------


def test_strip_takes_all_white_space(spark):
    texts = ["　Abc\n", "\t a b \x85", " x ", "", None, " \x1c　 ", "a　b"]
    assert values(spark, texts, n.strip) == [t if t is None else t.strip() for t in texts]
    assert values(spark, texts, n.normalize_for_dedup)[0] == values(spark, texts, n.normalize_classes)[0] == "abc"
    assert values(spark, ["x。　", "x。 y"], f.sentence_ends) == [True, False]
    assert values(spark, ["　one \n\n two"], lambda c: g.sentences(c)) == [["one", "two"]]


def test_digits_of_all_scripts(spark):
    assert values(spark, ["１２ 34 ٣"], n.normalize_classes) == ["00 00 0"]
    assert values(spark, ["１２ 34 ٣"], n.normalize_for_dedup) == values(spark, ["１２ 34 ٣"], n.slow_normalize_for_dedup) == ["00 00 0"]


def test_spacing(spark):
    one = lambda t, **kw: values(spark, [t], lambda c: n.normalize_spacing(c, **kw))[0]
    assert one("a  b   c") == "a b c" and one("a  +b", as_written=True) == "a  b" and one("a  +b") == "a +b"
    assert one("a( x ) .") == "a (x)." and one("10 %") == "10%" and one("1 000") == "1.000" and one("1 000", language="de") == "1,000"
    assert one('he said "no",', language="en") == 'he said "no,"' and one('he said "no,"', language="es") == 'he said "no",'
    assert one('end." and', language="cs") == 'end." and' and one('end." and', language="de") == 'end". and'
    assert one("« a »") == '"a"' and one("a…") == "a..." and one("１ ２") == "１.２"


def test_unescaping(spark):
    assert values(spark, ["a\\nb", "a\n\\nb\\nc"], n.unescape_newlines) == ["a\nb", "a\n\nb\nc"]
    assert values(spark, ["a\n\\nb\\nc"], n.unescape_wrapped) == ["a\nbc"]
    assert values(spark, ["櫻 澤"], lambda c: n.map_variants(c, {"櫻": "桜", "澤": "沢"})) == ["桜 沢"]


# -- filters, segmenters ---------------------------------------------------------------------------------------------


def test_sentence_check(spark):
    kinds = {"は": (f.PARTICLE, ""), "が": (f.PARTICLE, f.CASE_PARTICLE), "走る": (f.VERB, ""), "です": (f.AUXILIARY, "")}
    tags = lambda text: [kinds.get(w, ("名詞", "")) for w in text.split()]
    df = docs_of(spark, ["犬 が 走る", "は は", "犬 猫", "犬 です", "", None]).select("doc_id", "text", f.tag_lines(tags)("text").alias("t"))
    judge = lambda longest: {r.doc_id: r.ok for r in df.select("doc_id", f.is_sentence(F.col("t.tag"), F.col("t.detail"), F.col("text"), longest).alias("ok")).collect()}
    assert judge(None) == {0: True, 1: False, 2: False, 3: True, 4: False, 5: None}
    assert judge(2)[1] is True and judge(2)[2] is True


def test_dictionaries(spark, monkeypatch):
    words = spark.createDataFrame([("a", "ana"), ("a", "x"), ("b", "ana"), ("b", None), (None, "x"), ("c", "q")], "category string, word string")
    got = {(r.doc_id, r.category): r.n for r in f.dictionary_counts(docs_of(spark, ["banana x", "", None, "none"]), words).collect()}
    assert got == {(0, "a"): 3, (0, "b"): 2}
    with pytest.raises(ValueError):
        f.dictionary_counts(docs_of(spark, ["a"]), words, most_bytes=3)
    assert f.dictionary_counts(docs_of(spark, ["a"]), words.limit(0)).count() == 0
    import sys

    pairs, texts = [("a", "ana"), ("a", "x"), ("b", "ana")], ["banana x", "anana", ""]
    fast = [f.finder(pairs)(t) for t in texts]
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert [f.finder(pairs)(t) for t in texts] == fast == [{"a": 3, "b": 2}, {"a": 2, "b": 2}, {}]


def test_segmenters(spark):
    assert values(spark, ["東京タワーへ go!12", None], g.script_runs) == [["東京", "タワー", "へ", "go", "!", "12"], None]
    assert values(spark, ["a b", None], lambda c: g.segmented(str.split)(c)) == [["a", "b"], None]


def is_repetitive(t):
    if not t:
        return False
    lines, words = t.split("\n"), t.split()
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    if len(again) / len(lines) > 0.3 or sum(map(len, again)) / len(t) > 0.2:
        return True
    for n, most in repetition.TOP_GRAMS.items():
        c = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        if max(((len(x) - n + 1) * (k - 1) for x, k in c.items()), default=0) / len(t) > most:
            return True
    for n, most in repetition.COVERED_GRAMS.items():
        met, covered = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            covered |= set(range(i, i + n)) if gram in met else set()
            met.add(gram)
        if sum(len(words[i]) for i in covered) / len(t) > most:
            return True
    return False


def test_repetition_filter_against_brute_force(spark):
    r = random.Random(15)
    texts = [None, "", "a", "x\n" * 5] + ["".join(r.choice(["aa", "b", "cccc", "dd", "ee f gg"]) + r.choice(" \n    ") for _ in range(r.randint(1, 60))) for _ in range(30)]
    texts += [" ".join(f"w{r.randint(0, k)}" for _ in range(80)) for k in (5, 40, 200, 2000, 9000)]
    want = {i for i, t in enumerate(texts) if not is_repetitive(t)}
    assert {x.doc_id for x in repetition.remove_repetitive(docs_of(spark, texts)).collect()} == want and 3 < len(want) < len(texts) - 3
    spaced = [x.doc_id for x in repetition.is_repetitive(docs_of(spark, texts), normalize=n.normalize_for_dedup).where("repetitive").collect()]
    assert spaced


# -- hashes, Bloom ---------------------------------------------------------------------------------------------------


def test_hash_columns(spark):
    r = random.Random(3)
    texts = ["", "a", "hello", "é" * 40, *("".join(r.choices("abc é", k=r.randint(0, 90))) for _ in range(60)), None]
    assert values(spark, texts, lambda c: h.fnv1a_32_column(c)) == [None if t is None else h.fnv1a_32(t.encode()) for t in texts]
    assert [int(x) for x in h.fnv1a_32_all([t.encode() for t in texts[:-1]], 7)] == [h.fnv1a_32(t.encode(), 7) for t in texts[:-1]]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert values(spark, texts[:9], h.hash_column("fnv1a_64", seed=3)) == [signed(h.fnv1a_64(t.encode(), 3)) for t in texts[:9]]
    assert values(spark, ["test"], h.hash_column("murmur3_32")) == [0xBA6BD213]
    assert values(spark, ["a"], h.hash_column("md5")) == [hashlib.md5(b"a").hexdigest()]
    assert values(spark, ["hello world"], h.hash_column("murmur3_x64_128")) == [signed(h.murmur3_x64_128(b"hello world")[0])]


def test_word_signature_against_integers(spark):
    prime = (1 << 61) - 1
    r = np.random.RandomState(42)
    a, b = r.randint(1, prime, 64, dtype=np.int64).tolist(), r.randint(0, prime, 64, dtype=np.int64).tolist()
    text = " ".join(f"word{i} other" for i in range(200))
    words = text.split(" ")
    hashes = [h.sha1_bits(" ".join(words[i : i + 5]).encode()) for i in range(len(words) - 4)]
    assert values(spark, [text, "too short", None], lambda c: minhash.word_signature(c, 64)) == [[min((v * x + y) % prime & 0xFFFFFFFF for v in hashes) for x, y in zip(a, b, strict=True)], None, None]


def test_char_and_packed_signatures(spark):
    s = values(spark, ["Some, TEXT  here!", "some text here", "abc", None], minhash.char_signature)
    assert s[0] == s[1] and len(s[0]) == 128 and len(s[2]) == 128 and s[3] is None
    assert values(spark, ["some text here", None], lambda c: minhash.unpack_signature(minhash.pack_signature(minhash.char_signature(c)))) == [s[1], None]


def test_bloom_filter_has_no_false_negative_and_few_false_positives():
    r = np.random.default_rng(4)
    keys = np.unique(r.integers(0, 2**63, 300_000).astype("u8"))
    r.shuffle(keys)
    for error in (1e-2, 1e-4):
        held = bloom.ScalableBloom(1000, error)
        wrong = sum(int(held.add(keys[i : i + 5000]).sum()) for i in range(0, len(keys), 5000))
        assert wrong <= 1.5 * error * len(keys) + 5 and len(held.layers) > 5
        assert held.add(keys).all()
    twice = bloom.ScalableBloom().add(np.array([5, 6, 5, 5, 7, 6], "u8"))
    assert twice.tolist() == [False, False, True, True, False, True]


def test_bloom_dedup(spark):
    r = random.Random(5)
    texts = [f"text {r.randint(0, 300)}" if r.random() < 0.6 else "hot" for _ in range(3000)] + [None, None]
    docs = docs_of(spark, texts).repartition(5)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert {x.doc_id for x in bloom.bloom_dedup(docs).collect()} == set(first.values())


# -- order, sums, edges ----------------------------------------------------------------------------------------------


def test_orders_and_running_sums(spark):
    df = spark.range(2000).selectExpr("id", "(id * 7919) % 2000 as k", "if(id % 3 = 0, null, id % 4) as grp", "id % 11 as v").repartition(7)
    assert {r.id: r.place for r in numbered(df.select("id", "k"), ["k"], "place", 1).collect()} == {i: (i * 7919) % 2000 + 1 for i in range(2000)}
    rows = df.collect()
    for group in (None, "grp"):
        total, want = defaultdict(int), {}
        for r in sorted(rows, key=lambda r: r.k):
            key = r.grp if group else 0
            want[r.id] = total[key]
            total[key] += r.v
        assert {r.id: r.before for r in running_sums(df, ["k"], "v", "before", group).collect()} == want
    assert numbered(df.limit(0).select("id", "k"), ["k"]).count() == 0 and running_sums(df.limit(0), ["k"], "v").count() == 0


def test_scratch_tables_go_with_their_block(spark, tmp_path):
    from pathlib import Path

    from corpusloom.plans.storage import Stash, finished, scratch, spread

    there = lambda s: Path(s.path.removeprefix("file:")).exists()
    before = Stash(spark.range(3))
    with scratch(spark):
        inner = Stash(spark.range(40, numPartitions=8), short=True)
        assert len(list(Path(inner.path.removeprefix("file:")).glob("part-*"))) == 1

        def make():
            make.own = Stash(spark.range(5))
            return make.own.df.where("id > 1")

        kept = finished(spark, make, "kept")
        assert not there(make.own) and there(kept) and kept.df.count() == 3 and there(inner)
    assert there(before) and not there(inner) and not there(kept)
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    assert spread(spark.range(7)).rdd.getNumPartitions() == spark.range(7).rdd.getNumPartitions()


def test_edges_with_ties_and_nulls(spark):
    r = random.Random(6)
    data = [float(r.choice([1, 2, 2, 2, 5, 9, 100])) if r.random() < 0.8 else r.random() for _ in range(777)]
    df = spark.createDataFrame([(x,) for x in [*data, None]], "s double")
    want = sorted(set(np.quantile(data, [i / 16 for i in range(17)]).tolist()))
    assert np.allclose(scoring.bin_edges(df, "s", 16), want)
    assert scoring.bin_edges(df.limit(0), "s") == [] and scoring.bin_edges(df.where("s = 2"), "s") == [2.0]
    assert len(scoring.bin_edges(df, "s", 16, exact=False)) <= 17


def test_blocks_of_one_group(spark):
    sizes = [5, 0, 130, 1, 64, 7]
    df = spark.createDataFrame([(i, 0, [100 * i + k for k in range(s)]) for i, s in enumerate(sizes)], "doc_id long, batch int, tokens array<int>")
    flat = [100 * i + k for i, s in enumerate(sizes) for k in range(s)]
    got = {r.block_no: r.ids for r in dialogue.token_blocks(df, 32).collect()}
    assert got == {b: flat[32 * b : 32 * b + 32] for b in range(len(flat) // 32)}


def test_first_children_to_any_depth(spark):
    rows = [("r", "nan", 0)] + [(f"m{i}", "r" if i == 0 else f"m{i - 1}", 1) for i in range(9)] + [("late", "r", 2), ("tie", "r", 1)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, pos int")
    assert [(r.depth, r.message) for r in dialogue.first_child_paths(df).orderBy("depth").collect()] == [(0, "r")] + [(i + 1, f"m{i}") for i in range(9)]
    cycle = spark.createDataFrame([("a", "nan", 0), ("b", "a", 0), ("a", "b", 0)], "message_id string, parent_id string, pos int")
    with pytest.raises(ValueError):
        dialogue.first_child_paths(cycle)


# -- SimHash, substrings ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dense,block", [(10**6, 2048), (0, 16), (20, 7)])
def test_near_edges_in_blocks(spark, dense, block):
    r = random.Random(9)
    centre = r.getrandbits(64)
    sigs = [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)] + [r.getrandbits(64) for _ in range(40)] + [centre] * 3
    rows = [(i, s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sigs)] + [(999, None)]
    parent = list(range(len(sigs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sigs):
        for j in range(i):
            if (a ^ sigs[j]).bit_count() <= 3 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    edges = simhash.near_edges(spark.createDataFrame(rows, "id long, simhash long"), dense=dense, block=block)
    got = {x.node: x.component for x in connected_components(edges).collect()}
    assert {i: got.get(i, i) for i in range(len(sigs))} == {i: find(i) for i in range(len(sigs))} and 999 not in got


@pytest.mark.parametrize("verify", ["exact", "estimate"])
def test_crowded_buckets_give_the_same_clusters_and_counts(spark, verify):
    r = random.Random(14)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 4, 9])):
            w[r.randrange(60)] = f"x{k}"
        texts.append(" ".join(w))
    docs = docs_of(spark, [*texts, "short", None, texts[3]])
    got = []
    for dense, block in ((10**6, 256), (0, 16), (10, 50)):
        ids, stats = minhash.verified_clusters(docs, 0.75, verify=verify, dense=dense, block=block)
        got.append(({x.id: x.component for x in ids.collect()}, tuple(stats.first())))
    assert got[0] == got[1] == got[2] and got[0][1][0] > got[0][1][1] > 50 and len(set(got[0][0].values())) > 3


def brute_spans(texts, k):
    grams = Counter(tuple(w[i : i + k]) for w in map(str.split, texts) for i in range(len(w) - k + 1))
    covered = [{j for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for j in range(i, i + k)} for w in map(str.split, texts)]
    return [" ".join(x for j, x in enumerate(w) if j not in c) for w, c in zip(map(str.split, texts), covered, strict=True)]


def test_repeated_passages_go(spark, monkeypatch):
    r = random.Random(10)
    passages = [" ".join(r.choices("abcdefgh", k=9)) for _ in range(4)]
    texts = [" ".join([*r.choices("ijklmnop", k=r.randint(0, 12)), r.choice(passages), *r.choices("qrst", k=r.randint(0, 9)), r.choice(passages)]) for _ in range(30)] + ["a b", "", passages[0]]
    want = {i: t for i, t in enumerate(brute_spans(texts, 5)) if t}
    docs = docs_of(spark, texts)
    assert {x.doc_id: x.text for x in substring.remove_repeated_spans(docs, 5).collect()} == want
    with monkeypatch.context() as m:  # hashes that collide mark nothing that does not repeat
        m.setattr(substring.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
        assert {x.doc_id: x.text for x in substring.remove_repeated_spans(docs, 5).collect()} == want


def test_positions_and_pattern_search(spark):
    assert values(spark, ["aaa", "xaay", "", None], lambda c: substring.positions(c, "aa")) == [[1, 2], [2], [], []]
    data = b"mississippi"
    order = sorted(range(len(data)), key=lambda i: data[i:])
    for p in (b"issi", b"s", b"ppi", b"zz", b"a", b"mississippi"):
        lo, hi = substring.suffix_range(data, order, p)
        assert sorted(order[lo:hi]) == [i for i in range(len(data)) if data.startswith(p, i)]


# -- models, vocabularies, splits ------------------------------------------------------------------------------------


def test_backoff_scores(spark):
    train, test = ["a b c a b", "a b", "c", None], ["a b c", "a x b", "", None, "c c"]
    counts = Counter()
    for t in train:
        w = ["<s>", *t.split(), "</s>"] if t is not None else []
        counts.update(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = sum(v for k, v in counts.items() if " " not in k and k != "<s>")

    def score(t):
        w, out = ["<s>", *(t or "").split(), "</s>"], 0.0
        for i in range(1, len(w)):
            drops, n = 0, min(3, i + 1)
            while n > 1 and " ".join(w[i - n + 1 : i + 1]) not in counts:
                n, drops = n - 1, drops + 1
            gram = " ".join(w[i - n + 1 : i + 1])
            below = counts[" ".join(w[i - n + 1 : i])] if n > 1 else total
            out += math.log10(counts.get(gram, 0.5) / below) + drops * math.log10(0.4)
        return out

    model = scoring.ngram_counts(docs_of(spark, train), 3)
    assert {r.gram: r["count"] for r in model.collect()} == dict(counts)
    got = {r.doc_id: r for r in scoring.backoff_scores(docs_of(spark, test), model, 3).collect()}
    for i, t in enumerate(test):
        assert abs(got[i].log10_score - score(t)) < 1e-9 and got[i].tokens == len((t or "").split()) + 1


def test_weighted_mix_thins(spark):
    part = lambda lo: spark.range(lo, lo + 4000).toDF("doc_id")
    got = {r.corpus: r["count"] for r in scoring.weighted_mix({"a": (part(0), 2.0), "b": (part(10**6), 1.0), "c": (part(10**7), 0.2)}).groupBy("corpus").count().collect()}
    assert got["a"] == 4000 and 1800 < got["b"] < 2200 and 300 < got["c"] < 500
    train, held = scoring.sized_split(part(0), 25)
    assert held.count() == 25 and train.count() == 3975 and train.join(held, "doc_id").count() == 0


def test_lists_by_file(spark):
    files = spark.createDataFrame([(i, f"f{i % 2}", i * 10) for i in range(6)], "doc_id long, source string, row long")
    got = {r.source: r.rows for r in dedup.duplicates_by_file(spark.createDataFrame([(4,), (1,), (4,), (0,), (99,)], "id long"), files).collect()}
    assert got == {"f0": [0, 40], "f1": [10]}


def test_longest_match_columns(spark):
    rows = [("あ", 300), ("あい", 301), ("abc", 303)]
    df = docs_of(spark, ["あいabc!", "", None]).select("doc_id", vocab.encode_udf(rows)("text").alias("ids"))
    assert [r.t for r in df.orderBy("doc_id").select(vocab.decode_udf(rows)("ids").alias("t")).collect()] == ["あいabc!", "", None]
    assert {r.token for r in vocab.word_tokens(docs_of(spark, ["a b a", None, " c "])).collect()} == {"a", "b", "c"}


# -- sources and sinks -----------------------------------------------------------------------------------------------


def test_manifest(spark, tmp_path):
    for name, data in (("a.bin", b"one"), ("b.bin", b"two")):
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest().upper()), ("b.bin", "00"), ("gone", "11")], "name string, sha256 string")
    assert {r.name: r.ok for r in src.verified_files(spark, str(tmp_path), manifest).collect()} == {"a.bin": True, "b.bin": False, "gone": False}


def test_bins_and_packed_files(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "cast(id % 3 as int) as chunk", "id % 17 as score")
    src.write_bins(df, f"{tmp_path}/bins", order="score", per_file=40)
    back = spark.read.parquet(f"{tmp_path}/bins")
    assert sorted(map(tuple, back.select("doc_id", "chunk", "score").collect())) == sorted(map(tuple, df.collect()))
    blocks = spark.range(50).selectExpr("id", "transform(sequence(0, 7), x -> id * 8 + x) as ids").union(spark.createDataFrame([(99, [1, 2])], "id long, ids array<long>"))
    paths = src.write_packed_tokens(blocks.repartition(3), f"{tmp_path}/packed", 8, "u2", blocks_per_file=7)
    assert len(paths) >= 8 and all(len(open(p, "rb").read()) == 24 + 16 * len(src.unpack_tokens(open(p, "rb").read())[0]) // 8 for p in paths)
    ids = sorted(tuple(r.ids) for r in src.read_packed_tokens(spark, paths, 8).collect())
    assert ids == [tuple(range(8 * i, 8 * i + 8)) for i in range(50)]


def test_json_pairs_and_recompression(spark, tmp_path):
    for i in range(3):
        with gzip.open(tmp_path / f"p{i}.jsonl.gz", "wt") as out:
            out.write(f'{{"id": {i}, "text": "a\\\\nb"}}\n')
    got = src.read_indexed(spark, f"{tmp_path}/p{{}}.jsonl.gz", 1, 2, "id long, text string").collect()
    assert sorted((r.id, r.text) for r in got) == [(1, "a\nb"), (2, "a\nb")]
    assert src.read_indexed(spark, [], 0, 5, "id long").count() == 0
    src.write_pairs(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long"), f"{tmp_path}/pairs")
    assert sorted(map(tuple, src.read_pairs(spark, f"{tmp_path}/pairs").collect())) == [("1", "2"), ("3", "4")]
    done = src.recompressed(spark, str(tmp_path), f"file://{tmp_path}/zst").collect()
    assert len(done) == 3 and spark.read.schema("id long, text string").json(f"{tmp_path}/zst").count() == 3
    csv = tmp_path / "t.tsv"
    csv.write_text("a\tb\n1\t2\n")
    assert [tuple(r) for r in src.read_table(spark, str(csv)).collect()] == [("1", "2")]


def test_signature_container(spark, tmp_path):
    docs = docs_of(spark, ["one two three four five six", "short"])
    signed = docs.select("doc_id", minhash.portable_signature(F.col("text")).alias("signature"))
    minhash.write_signatures(signed, spark.createDataFrame([(0, True)], "doc_id long, duplicate boolean"), f"{tmp_path}/s")
    back = {r.doc_id: r for r in minhash.read_signatures(spark, f"{tmp_path}/s").collect()}
    assert back[0].signature == signed.where("doc_id = 0").first().signature and back[0].duplicate and back[1].signature is None


# -- streams ---------------------------------------------------------------------------------------------------------


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("a", 10), ("a", 20), ("b", 4000), ("b", 90000)], "k string, s int").selectExpr("k", "timestamp_seconds(s) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    q = windowed_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("windows_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("windows_out").collect()) == [("a", 2), ("b", 1)]


def test_flags_over_a_stream(spark, tmp_path):
    texts = ["one two three four five six", "seven eight nine ten eleven", "one two three four five six", "short"]
    schema, out = "doc_id long, text string", []
    keys = lambda df: minhash.exploded(df, minhash.portable_signature(F.col("text"), 8), 2, 4)
    for k, rows in enumerate(([(1, texts[0]), (2, texts[1]), (4, texts[3])], [(5, texts[2]), (6, texts[1]), (7, "a b c d e f")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        flag_against_table(stream, keys, f"{tmp_path}/keys", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        out = {r.id: r.duplicate for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {1: False, 2: False, 5: True, 6: True, 7: False}
