"""Every stage of the pipeline, and the whole, against brute force on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_packing import library
from test_simhash import components, naive
from test_text_operators import brute_hits

import corpus_pipeline
from corpusloom.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    texts = [" ".join(word() for _ in range(r.randint(0, 120))) for _ in range(60)]
    item = " ".join(word() for _ in range(14))
    docs, labels = [], []
    for i in range(400):
        t = r.choice(texts).split()
        if i % 4 == 0:
            for _ in range(3):
                t.insert(r.randint(0, len(t)), r.choice(["zyxwort", "quimpol", "zyxworts"]))
            labels.append((i, 1))
        else:
            labels.append((i, 0))
            if i % 7 == 0 and len(t) > 20:
                t[r.randrange(len(t))] = word()
        docs.append((i, " ".join(t)))
    docs += [(900 + k, f"{texts[k]} {item} end") for k in range(4)] + [(None, item), (904, item.upper())]
    docs += [(5, "a b c d"), (5, "a b c d"), (8, "other text"), (8, "a b c d"), (None, "a b c d"), (None, "lone text here"), (None, None), (6, None), (6, ""), (6, ""), (None, "")]
    docs += [(950, " ".join(f"w{k % 97}" for k in range(9000)))]
    folder = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long"
    spark.createDataFrame([(i, t, "en", "s", 1, "f", 7) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}", item


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def brute_exact(rows):
    best = {}
    for i, t in rows:
        key = t or ""
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    return best


def brute_near(rows):
    tops = components({naive(t) for _, t in rows})
    groups = defaultdict(list)
    for i, t in rows:
        groups[tops[naive(t)]].append((i, t))
    return groups


def first(x):
    import hashlib

    return (x[0] is None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).digest())


def brute_pack(rows):
    ids_of, want = library(), Counter()
    for i, t in rows:
        ids = np.array([*ids_of.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    return want


def test_each_stage_and_the_whole(spark, folder):
    sf, item = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = rows_of(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    want = [(i, t) for i, t in every if model.score(t) < 0.7]
    assert Counter(rows_of(clean)) == Counter(want) and len(want) < len(every)
    exact = stages["exact_dedup"](spark, docs, sf)
    best = brute_exact(every)
    assert exact.columns == docs.columns
    assert Counter((i, t or "") for i, t in rows_of(exact)) == Counter((i, t or "") for i, t in best.values())
    near = stages["simhash"](spark, docs, sf)
    assert near.columns == docs.columns
    assert Counter((i, t or "") for i, t in rows_of(near)) == Counter((i, t or "") for i, t in (min(g, key=first) for g in brute_near(every).values()))
    left = stages["decontamination"](spark, docs, sf)
    assert left.columns == docs.columns
    assert Counter(rows_of(left)) == Counter((i, t) for i, t in every if not brute_hits([(0, t)], [(1, item)])) != Counter(every)
    packed = stages["packing"](spark, docs, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == brute_pack(every)
    # And one after the other, as run() does it.
    rows = [min(g, key=first) for g in brute_near(list(brute_exact(want).values())).values()]
    rows = [(i, t) for i, t in rows if not brute_hits([(0, t)], [(1, item)])]
    done = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in done) == brute_pack(rows)
    by = defaultdict(list)
    for r in done:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables(spark, folder, tmp_path):
    sf, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where(F.col("offset") + F.col("length") > 1024).count() == 0
