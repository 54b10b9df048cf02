import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows):
    """The rows of the result, as often as they occur."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out.update((i, keep, len(ids), False, sha) for i in ids)
        out[keep, keep, len(ids), False, sha] -= 1
        out[keep, keep, len(ids), True, sha] += 1
    return +out


def test_odd_rows(odd_docs):
    assert Counter(tuple(r) for r in exact_groups(odd_docs).collect()) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_repeated_rows_are_rows_each(make_docs, monkeypatch):
    from corpusloom.llm import exact_dedup, keys

    rows = [(1, "x"), (1, "x"), (2, "x")] + [(7, "y" * 30)] * 23 + [(None, "y" * 30)] * 4 + [(None, "z")] * 5
    assert Counter(tuple(r) for r in exact_groups(make_docs(rows), block_bytes=8).collect()) == brute(rows)
    monkeypatch.setattr(exact_dedup, "REPEATS", 4)  # keys of many rows are dealt out
    monkeypatch.setattr(keys.repeated, "__defaults__", (4, True))
    assert Counter(tuple(r) for r in exact_groups(make_docs(rows), block_bytes=8).collect()) == brute(rows)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_small_blocks_against_brute_force(make_docs, block):
    r = random.Random(block)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 9)))) for i in range(400)]
    assert Counter(tuple(x) for x in exact_groups(make_docs(rows), block_bytes=block).collect()) == brute(rows)


def test_hash_alone_never_decides(spark, make_docs, monkeypatch):
    """With a constant hash every block falls into one run over all partitions; names still follow the contents."""
    from corpusloom.llm import exact_dedup

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, f"text {i % 37} " * 5) for i in range(300)]
    assert Counter(tuple(x) for x in exact_groups(make_docs(rows), block_bytes=16).collect()) == brute(rows)


def test_empty_table_and_columns(make_docs):
    assert exact_groups(make_docs([])).count() == 0
    kept = drop_exact_copies(make_docs([(1, "a"), (2, "a"), (2, "a"), (3, None), (None, "")]))
    assert sorted((r.doc_id, r.text, r.name) for r in kept.collect()) == [(2, "a", "n"), (3, None, "n")]
