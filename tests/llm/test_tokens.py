import random
import zlib

import numpy as np
import pytest

from corpusloom.llm.queries import vocabulary
from corpusloom.llm.token_files import TokenFileReader, TokenFileWriter, requested_documents, token_file_round_trip, write_token_files
from corpusloom.llm.tokens import Encoder


@pytest.mark.parametrize("control_text", [False, True])
@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, byte_level, control_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))  # as it is: the call that the contract names
    library.encode_special_tokens = control_text
    e = Encoder(vocabulary(name), byte_level, control_text, table_bytes=20_000)
    r = random.Random(7)
    letters = ["a", "b", "The", "T", " ", " ", "\n", "\n", "\t", "é", "'s", "'", "1", "12", "!", "　", "́", "ß", "Σ", "<|endoftext|>", "<|startoftext|>", "\x1c", "中", "İ", ".", ","]
    for _ in range(6000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 10)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name,byte_level,words", [("byte_bpe_50k.json", True, ["zorblefant", "Zorblefant", "écheauan"]), ("word_bpe_49k.json", False, ["zorblefant", "écheauan"])])
def test_the_model_is_asked_once_for_a_word(name, byte_level, words):
    e = Encoder(vocabulary(name), byte_level)
    asked, model = [], e.model

    class Counted:
        def tokenize(self, letters):
            asked.append(letters)
            return model.tokenize(letters)

    e.model = Counted()
    pieces = ["zorblefant,", "écheauan.***", "zorblefant.", "Zorblefant###", "zorblefant", "Zorblefant,", "écheauan", "Zorblefant"]
    text = "a " + " ".join(pieces * 3)
    assert e.encode(text) == e.whole(text)
    assert len([x for x in asked if len(x) > 5]) == len(words), asked


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_latin_letter_and_mark_around_a_word(name, byte_level):
    from tokenizers import Tokenizer

    library, e = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name), byte_level, table_bytes=20_000)
    for code in range(0x250):
        c = chr(code)
        text = " ".join(["x", f"A{c}b", f"a{c}b,", f"{c}", f"{c}.", f"ab{c}", f"ab{c}'", f"'ab{c}", f"\nAb{c}!?", f"ab{c}'s", f"ab_{c}", f"Ab{c}\n{c}Ab."])
        for _ in range(2):
            assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(c)


def test_tables_stay_within_their_bytes():
    import sys

    e = Encoder(vocabulary("byte_bpe_50k.json"), True, table_bytes=200_000)
    r = random.Random(1)
    for _ in range(300):
        text = " ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(50))
        assert e.encode(text) == e.whole(text)
        held = sum(sys.getsizeof(k) + sys.getsizeof(v) for t in (e.pieces, e.pieces.old) for k, v in t.items())
        assert held < 220_000


def test_round_trip(odd_docs, make_docs):
    path = vocabulary("word_bpe_49k.json")
    e = Encoder(path, False)
    odd_docs = odd_docs.union(make_docs([(71, "a <|endoftext|> b"), (9, "z"), (9, "a")]))
    data = [(r.doc_id, np.frombuffer(e.whole(r.text or "") + b"\2\0\0\0", "<u4")) for r in odd_docs.collect()]
    got = token_file_round_trip(odd_docs, path).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(i), len(x), zlib.crc32(x.tobytes())) for i, x in data)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_file_round_trip(make_docs([]), path).count() == 0


def test_rows_that_share_an_id_have_a_fixed_order(make_docs, tmp_path):
    path, rows = vocabulary("word_bpe_49k.json"), [(k % 3, f"text {k % 50}") for k in range(300)] + [(None, f"n {k}") for k in range(40)]
    a, b = (sorted((r.start, r.doc_id, r.ids_crc32) for r in token_file_round_trip(make_docs(x), path).collect()) for x in (rows, rows[::-1]))
    assert a == b and len(a) == 340


def test_requested_documents_touch_their_frames_only(spark, make_docs, tmp_path):
    uri = f"file://{tmp_path}/get.zst"
    w = TokenFileWriter(uri, frame_bytes=400)
    for i in [None, *range(0, 400, 2)]:
        w.add(i, np.arange((i or 0) % 17, dtype="<u4").tobytes())
    w.commit()
    r = TokenFileReader(uri)
    assert len(r.table) > 10
    for i in (0, 2, 200, 398, None):
        before = r.frames_read
        (ids,) = r.get(i)
        assert len(ids) == (i or 0) % 17 and r.frames_read == before + 1
    before = r.frames_read
    assert r.get(-1) == [] and r.get(1000) == [] and r.frames_read == before
    path = vocabulary("word_bpe_49k.json")
    docs = make_docs([(i, f"word{i} " * (i % 5)) for i in range(300)] + [(5, "again five"), (None, "no id")])
    files = write_token_files(docs, f"file://{tmp_path}/files", path)
    wanted = spark.createDataFrame([(5,), (7,), (None,), (12345,), (7,), (299,)], "doc_id long")
    e = Encoder(path, False)
    want = sorted((repr(x.doc_id), [*np.frombuffer(e.whole(x.text), "<u4").tolist(), 2]) for x in docs.collect() if x.doc_id in (5, 7, 299, None))
    assert sorted((repr(x.doc_id), list(x.ids)) for x in requested_documents(files, wanted).collect()) == want


def test_frames_are_read_alone_and_checked(tmp_path):
    uri = f"file://{tmp_path}/a.zst"
    w = TokenFileWriter(uri, frame_bytes=64)
    for i in range(50):
        w.add(None if i == 3 else i, np.arange(i, dtype="<u4").tobytes())
    w.commit()
    r = TokenFileReader(uri)
    docs = list(r.documents())
    assert [d for d, _ in docs] == [None if i == 3 else i for i in range(50)]
    assert all((x == np.arange(i)).all() for i, (_, x) in enumerate(docs))
    last = list(r.frame(len(r.table) - 1))
    assert last[-1][0] == 49
    data = bytearray((tmp_path / "a.zst").read_bytes())
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()  # any reader can
    data[r.starts[2] + 12] ^= 255
    (tmp_path / "b.zst").write_bytes(data)
    bad = TokenFileReader(f"file://{tmp_path}/b.zst")
    list(bad.frame(1))
    with pytest.raises(ValueError):
        list(bad.frame(2))
    (tmp_path / "c.zst").write_bytes(data[:-3])
    with pytest.raises(ValueError):
        TokenFileReader(f"file://{tmp_path}/c.zst")
