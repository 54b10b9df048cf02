import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm.packing import pack, packed, plan
from corpusloom.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("capacity,seed", [(16, 0), (64, 1), (64, 2), (100, 3)])
def test_plan_uses_every_item_once_and_few_bins(capacity, seed):
    r = random.Random(seed)
    counts = Counter(min(capacity, 1 + int(r.expovariate(4 / capacity))) for _ in range(3000))
    used = Counter()
    bins = 0
    for pattern, n in plan(counts, capacity):
        assert sum(pattern) <= capacity and n > 0
        bins += n
        for x in pattern:
            used[x] += n
    assert used == counts
    assert bins <= 1.01 * np.ceil(sum(x * n for x, n in counts.items()) / capacity) + 1


def test_plan_of_nothing_and_of_equal_items():
    assert plan({}, 8) == []
    assert sum(n for _, n in plan({3: 7}, 8)) == 4
    assert sum(n for _, n in plan({8: 5, 4: 2}, 8)) == 6


def test_against_the_library(odd_docs, make_docs):
    library_ids = library()
    docs = odd_docs.union(make_docs([(70, "a <|endoftext|> in the text, <|startoftext|> too\n<|endoftext|>")]))
    rows = [r.asDict() for r in packed(docs, PATH, capacity=64).collect()]
    want = Counter()
    for r in docs.collect():
        ids = np.array([*library_ids.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_rare_pieces_leave_room_for_words():
    """Words that a table of a given size can hold are not given to the model again for each ending they come with."""
    from corpusloom.llm.tokens import Encoder

    e, r = Encoder(PATH, True, table_bytes=400_000), random.Random(5)
    asked, model = [], e.model

    class Counted:
        def tokenize(self, letters):
            asked.append(letters)
            return model.tokenize(letters)

    e.model = Counted()
    words = sorted({"".join(r.choices("abcdefghi", k=9)) for _ in range(500)})
    ends = ["", ".", ",", "!", "###", ".***", "$$$", "%"]
    for _ in range(40):
        text = "a " + " ".join(w + r.choice(ends) for w in r.sample(words, len(words)))
        assert e.encode(text) == e.whole(text)
    assert len(asked) < 3 * len(words)


def test_hot_length_and_empty(spark, make_docs):
    rows = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "id as ids_crc32", "cast(if(id % 3 = 0, 5, 1 + id % 8) as bigint) as length")
    got = pack(rows, 8).toPandas()
    assert len(got) == 5000 and got.groupby("sequence_id")["length"].sum().max() <= 8
    assert not got.duplicated(["sequence_id", "offset"]).any()
    assert packed(make_docs([]), PATH).count() == 0
