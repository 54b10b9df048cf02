import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.simhash import allocate, ball_counts, drop_near_copies, fingerprint, links, near_groups
from corpusloom.operators.graph import connected_components


def naive(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) * 2 > len(grams) for b in range(64)]
    return sum(1 << b for b, x in enumerate(bits) if x)


def components(values, distance=3):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vs}


def test_fingerprint():
    for t in (None, "", " \t", "one", "One TWO", "a b c", "a b c d a b c d e", "É é Ñ x\x1fy z w"):
        assert fingerprint(t) == naive(t)


def test_rows_against_brute_force(spark, odd_docs, make_docs):
    r = random.Random(5)
    base = [r.choices([f"w{i}" for i in range(200)], k=80) for _ in range(8)]
    rows = []
    for i in range(160):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(80)] = f"x{r.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    for docs in (make_docs(rows), odd_docs):
        data = [(x.doc_id, x.text) for x in docs.collect()]
        tops = components({naive(t) for _, t in data})
        least = {}
        for i, t in data:
            least.setdefault(tops[naive(t)], []).append(i)
        want = sorted((repr(i), f"{naive(t):016x}", min(x for x in least[tops[naive(t)]] if x is not None)) for i, t in data if any(x is not None for x in least[tops[naive(t)]]))
        got = sorted((repr(x.doc_id), x.fingerprint, x.component_id) for x in near_groups(docs).collect() if x.component_id is not None)
        assert got == want


def test_crowded_values_give_the_same_components(spark):
    """A ball of fingerprints around one centre, and rings; every value is compared in blocks, or by joins."""
    r = random.Random(3)
    centre = r.getrandbits(64)
    values = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(500)} | {r.getrandbits(64) for _ in range(100)}
    signed = [int(x) for x in np.array(sorted(values), "u8").view("i8")]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {}
    for v, top in components(values).items():
        want.setdefault(top, set()).add(v)
    sets = {frozenset(s) for s in want.values() if len(s) > 1}
    for dense, block in ((10**6, 2048), (0, 64), (40, 16)):
        got = {}
        for x in connected_components(links(df, dense=dense, block=block)).collect():
            got.setdefault(x.component, set()).add(x.node % 2**64)
        assert {frozenset(s) for s in got.values()} == sets


def test_allocation_is_optimal_and_complete():
    r = np.random.default_rng(0)
    costs = r.random((4, 5, 50))
    costs[:, 0] = 0
    t = allocate(costs, 4)
    assert (t.sum(axis=0) == 0).all() and (t >= -1).all()
    from itertools import product

    for k in range(50):
        best = min(sum(costs[i, u[i], k] for i in range(4)) for u in product(range(5), repeat=4) if sum(u) == 4)
        assert abs(sum(costs[i, t[i, k] + 1, k] for i in range(4)) - best) < 1e-9


def test_ball_counts():
    r = np.random.default_rng(1)
    h = r.integers(0, 5, 64)
    for t, counts in enumerate(ball_counts(h, 6, 3)):
        assert all(counts[v] == sum(h[u] for u in range(64) if (u ^ v).bit_count() <= t) for v in range(64))


def test_empty_and_kept(make_docs):
    assert near_groups(make_docs([])).count() == 0
    kept = drop_near_copies(make_docs([(3, "a b c d"), (5, "a b c d"), (9, None), (7, ""), (None, "x y z")]))
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["3", "7", "None"]


def test_one_row_of_each_group_of_near_copies_stays(spark):
    a, b, c = "a b c d", "q r s t u", "x y z w v"
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (1, c.upper()), (None, "k l m n"), (None, "k l m n"), (None, "K l m n")]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text.lower(), r.doc_id) for r in kept if r.doc_id) == [(a, 1), (b, 2), (c, 1)]
    assert [r.text.lower() for r in kept if not r.doc_id] == ["k l m n"]
