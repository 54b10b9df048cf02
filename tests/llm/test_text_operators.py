import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import chat, decontam, quality, toxicity, warc
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.token_counts import REDACTIONS, TokenTree, apply_edits, build_trees, edited_counts, redactions, with_edits
from corpusloom.llm.tokens import Encoder
from corpusloom.llm.words import shingles, words


def brute_hits(docs, items, threshold=0.8):
    out = Counter()
    for d, text in docs:
        for i, item in items:
            t = words(item)
            w = min(5, len(t))
            own = set(shingles(t, w)) if t else set()
            shared = len(own & set(shingles(words(text), w))) if own else 0
            if own and shared >= threshold * len(own) - 1e-9:
                out[d, i, shared, len(own)] += 1
    return out


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_decontamination_against_brute_force(spark, odd_docs, make_docs, index_bytes):
    r = random.Random(2)
    item_rows = [(i, " ".join(r.choices("abcdefghijklmnop", k=r.randint(1, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "one two"), (None, "no id here")]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choices("abcdefghijklmnop", k=r.randint(0, 300)))]
        if i % 3:
            w = r.choice(item_rows[:30])[1].split()
            if i % 2 and len(w) > 12:
                w[r.randrange(len(w))] = "zz"
            parts += [" ".join(w).upper(), "tail, end"]
        docs.append((i, "; ".join(parts)))
    items = spark.createDataFrame(item_rows, "item_id long, text string")
    for df in (make_docs(docs), odd_docs):
        rows = [(x.doc_id, x.text) for x in df.collect()]
        got = Counter((x.doc_id, x.item_id, x.shared, x.item_shingles) for x in decontam.contained_items(df, items, index_bytes=index_bytes).collect())
        want = brute_hits(rows, item_rows)
        assert want and got == want
        kept = Counter((x.doc_id, x.text, x.name) for x in decontam.drop_contaminated(df, items, index_bytes=index_bytes).collect())
        assert kept == Counter((d, t, "n") for d, t in rows if not brute_hits([(0, t)], item_rows))
    none = items.limit(0)
    assert decontam.contained_items(odd_docs, none, index_bytes=index_bytes).count() == 0
    assert decontam.drop_contaminated(odd_docs, none, index_bytes=index_bytes).count() == odd_docs.count()
    assert decontam.drop_contaminated(make_docs([]), items, index_bytes=index_bytes).count() == 0


def test_items_have_an_index_for_each_size():
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("abcdefghijklmnop", k=n))) for i, n in enumerate([1, 3, 5, 6, 9, 20, 40, 70])]
    index = decontam.Items(rows)
    assert [len(index.index[w]) for w in (1, 3, 5)] == [1, 1, len({x.upper for x in index.items if x.width == 5})]
    for w, upper, hashes in (decontam.sketch(t) for _, t in rows):
        assert len(hashes) <= decontam.allowed_missing(upper, 0.8) + 1 and w


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a</s>\nb"), (1, 1, "assistant", "\\x<|user|>\n[INST]"), (1, 1, "assistant", "\\x<|user|>\n[INST]"), (2, 0, "system", None), (2, 1, "user", "é𠮷"), (2, 2, "assistant", "\\\\"), (None, None, None, None), (3, 0, "user", "q"), (3, 1, "assistant", "")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert len(got) == 4
    for conv in {r[0] for r in rows}:
        turns = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        flat = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [(got[k].valid, got[k].complete) for k in (1, 2, 3, None)] == [(False, False), (True, True), (True, True), (False, False)]
    assert chat.digests(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 200
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (3, "http://c", "short"), (4, "http://d", "short"), (5, "u", None), (None, "n", long), (6, "e", "x\r\n\r\nWARC/1.1\r\n\r\n" * 100), (2, "again", long)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, payload string")
    got = Counter(tuple(r) for r in warc.archive_round_trip(df).collect())
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == long and i != 2
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_normaliser_reads_any_member_layout(tmp_path):
    record = lambda k: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, b"z" * k)
    all_records = [record(k) for k in (0, 5, 3_000_000, 1)]
    for name, data in (("one", gzip.compress(b"".join(all_records))), ("many", b"".join(map(gzip.compress, all_records)))):
        (tmp_path / name).write_bytes(data)
        n, size = warc.normalise(str(tmp_path / name), str(tmp_path / f"{name}.warc.gz"))
        assert n == 4 and gzip.decompress((tmp_path / f"{name}.warc.gz").read_bytes()) == b"".join(all_records)
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(gzip.compress(all_records[1])[:-9]).read)))


def _labelled(spark, r, bad_words, n=600):
    rows, labels = [], []
    for i in range(n):
        w = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(r.randint(20, 200))]
        y = i % 4 == 0
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad_words) + r.choice(["", "s", "ed"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity_against_plain_python(spark, make_docs, odd_docs):
    """One step of training and all scores, by loops over windows, words and buckets."""
    texts = ["bad worse awful thing here", "a fine day", "worst", "nothing to see in this one", "bad"]
    bags = toxicity._Bags(texts)
    t = toxicity._Trainer(bags, seed=3)
    e, w, b = t.e.copy(), t.w.copy(), t.b.copy()
    windows = [(k, words(x)[i : i + 3]) for k, x in enumerate(texts) for i in sorted({min(j, max(0, len(words(x)) - 3)) for j in range(0, len(words(x)), 3)})]
    assert len(windows) == len(bags) and [k for k, _ in windows] == bags.text_of.tolist()
    label = np.array([int(k in (0, 2, 4)) for k, _ in windows])
    weight = np.linspace(0.5, 2, len(windows))
    t.epoch(np.arange(len(windows)), label, weight, 0.25, steps=1)
    ge, gw, gb = defaultdict(lambda: np.zeros(toxicity.DIM)), np.zeros_like(w), np.zeros(2)
    for (_, own), y, scale in zip(windows, label, weight, strict=True):
        subs = [toxicity.subwords(x) for x in own]
        v = np.mean([np.mean([e[s] for s in sub], axis=0) for sub in subs], axis=0)
        z = v @ w + b
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        g = scale * (p - np.eye(2)[y])
        gw, gb = gw + np.outer(v, g), gb + g
        for sub in subs:
            for s in sub:
                ge[s] += (w @ g) / len(own) / len(sub)
    for s, g in ge.items():
        assert np.allclose(t.e[s], e[s] - 0.25 * g / np.sqrt(1e-8 + (g * g).mean()))
    assert np.allclose(t.w, w - 0.25 * gw / np.sqrt(1e-8 + gw * gw)) and np.allclose(t.b, b - 0.25 * gb / np.sqrt(1e-8 + gb * gb))
    r = random.Random(3)
    rows, labels = _labelled(spark, r, ["zyxwort"], 200)
    table = spark.createDataFrame([*labels, (None, 1), (3, 1), (8, 1), (9, 0)], "doc_id long, toxic int")
    docs = make_docs(rows).union(odd_docs)
    model = toxicity.fit(docs, table)

    def score(text):
        own = [np.mean(model.values[toxicity.subwords(x)]) for x in words(text)]
        best = max((np.mean(own[i : i + 3]) for i in range(max(1, len(own) - 2))), default=0.0) if own else 0.0
        return 1 / (1 + np.exp(-(model.slope * (best + model.bias) + model.intercept)))

    plain = {t: score(t) for _, t in [*rows, *((x.doc_id, x.text) for x in odd_docs.collect())]}
    want = sorted((repr(x.doc_id), round(plain[x.text], 4)) for x in docs.collect())
    assert sorted((repr(x.doc_id), round(x.score, 4)) for x in toxicity.toxicity_scores(docs, table).collect()) == want
    kept = Counter((x.doc_id, x.text, x.fp) for x in toxicity.drop_toxic(docs, table).collect())
    assert kept == Counter((x.doc_id, x.text, "f") for x in docs.collect() if plain[x.text] < toxicity.CUT) and 0 < kept.total() < docs.count()
    assert toxicity.drop_toxic(odd_docs, table.limit(0)).count() == odd_docs.count() and toxicity.drop_toxic(make_docs([]), table).count() == 0


def test_training_sample_is_bounded(spark, make_docs):
    """By ids and bytes, also where one id has most rows; too many labels raise."""
    docs = make_docs([(5, f"hot {k % 7}") for k in range(500)] + [(i, "x" * 50) for i in range(100, 400)])
    labels = spark.createDataFrame([(5, 1), (5, 1)] + [(i, i % 2) for i in range(100, 400)], "doc_id long, toxic int")
    found = toxicity.labelled_sample(docs, labels, "toxic", {1: 30, 0: 20}, 10**6)
    assert Counter(y for _, y in found)[1] <= 30 and 10 <= Counter(y for _, y in found)[0] <= 20
    assert sum(len(t) for t, _ in toxicity.labelled_sample(docs, labels, "toxic", {1: 30, 0: 20}, 700)) <= 700
    many = spark.range(3000).selectExpr("id as doc_id", "cast(id as int) as toxic")
    with pytest.raises(ValueError):
        toxicity.labelled_sample(docs, many, "toxic", {1: 30}, 10**6)
    with pytest.raises(ValueError):
        quality.quality_scores(docs, many, label="toxic")


def test_quality_against_plain_python(spark, make_docs, odd_docs):
    """Training by numerical derivatives of the likelihood, and all probabilities, by loops."""
    texts = ["a b", "b c c", "A1 x", "a a a", "x y", "c b a", "B9 z", "y y x"]
    grades = [0, 1, 2, 0, 2, 1, 2, 0]
    model = quality.train(texts, grades, steps=4)
    rows = [quality.Features()(t) for t in texts]
    used = sorted({int(x) for b, _ in rows for x in b})
    met = {u: sum(u in b for b, _ in rows) for u in used}
    count = Counter(grades)

    def loss(p):
        cuts = [p[-2], p[-2] + np.exp(p[-1])]
        total = 0.0
        for (b, v), y in zip(rows, grades, strict=True):
            s = sum(p[used.index(int(i))] * x * met[int(i)] / (met[int(i)] + quality.SUPPORT) for i, x in zip(b, v, strict=True))
            edge = [0.0, *(1 / (1 + np.exp(s - c)) for c in cuts), 1.0]
            total -= np.log(edge[y + 1] - edge[y]) / count[y] / 3
        return total + 1e-3 / 100 / 2 * sum(x * x for x in p[: len(used)])

    p = np.r_[np.zeros(len(used)), -1.0, 0.0]
    m, v = np.zeros(len(p)), np.zeros(len(p))
    for step in range(1, 5):
        g = np.array([(loss(p + d) - loss(p - d)) / 2e-5 for d in np.eye(len(p)) * 1e-5])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (1 - 0.9 * step / 4) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    for k, u in enumerate(used):
        assert abs(model.weights[u] - p[k] * met[u] / (met[u] + quality.SUPPORT)) < 2e-3
    assert np.allclose(model.thresholds, [p[-2], p[-2] + np.exp(p[-1])], atol=2e-3)
    data = [(i, texts[i % 8]) for i in range(120)]
    labels = spark.createDataFrame([(i, grades[i % 8]) for i in range(120)] + [(9, 0), (None, 2), (7, None)], "doc_id long, quality int")
    docs = make_docs(data).union(odd_docs)
    sample = toxicity.labelled_sample(docs, labels, "quality", {0: 3000, 1: 3000, 2: 3000}, 10**8)
    fitted = quality.train([t for t, _ in sample], [y for _, y in sample])

    def expected(text):
        b, x = fitted.features(text)
        value = sum(float(fitted.weights[i]) * y for i, y in zip(b, x, strict=True))
        below = [0.0, *(1 / (1 + np.exp(value - c)) for c in fitted.thresholds), 1.0]
        return sum(k * (below[k + 1] - below[k]) for k in range(3)), 1 - below[2]

    want = sorted((repr(x.doc_id), *(round(float(y), 4) for y in expected(x.text))) for x in docs.collect())
    got = quality.quality_scores(docs, labels).collect()
    assert sorted((repr(x.doc_id), round(x.expected_grade, 4), round(x.tail_probability, 4)) for x in got) == want
    assert all(x.selected == (x.tail_probability >= 0.5) for x in got)


def test_toxicity_held_out_and_misspelt(spark, make_docs, odd_docs):
    r = random.Random(3)
    rows, labels = _labelled(spark, r, ["zyxwort", "quimpol"])
    labelled = spark.createDataFrame([*labels, (9999, 1), (1, None)], "doc_id long, toxic int")
    scored = {x.doc_id: x for x in toxicity.toxicity_scores(make_docs(rows), labelled).collect()}
    held = [(scored[i], y) for i, y in labels if scored[i].held_out]
    assert sum((s.predicted == 1) == bool(y) for s, y in held) > 0.95 * len(held)
    model = toxicity.train([t for _, t in rows], [y for _, y in labels])
    assert model.score("ab cd ef gh zyxwwort ab cd ef") > model.score("ab cd ef gh abcdefgh ab cd ef")
    assert all(0 <= x.score <= 1 for x in toxicity.toxicity_scores(odd_docs, labelled.limit(0)).collect())
    assert toxicity.toxicity_scores(make_docs([]), labelled).count() == 0


def test_quality_grades(spark, make_docs, odd_docs):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["fine", "good", "text"]) if r.random() < (i % 5) / 4 else r.choice(["$$$", "!!", "x9x"]) for _ in range(60))) for i in range(500)]
    labels = spark.createDataFrame([(i, i % 5) for i, _ in rows], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.quality_scores(make_docs(rows), labels).collect()}
    held = [(got[i].expected_grade, i % 5) for i in got if got[i].held_out]
    assert sum(abs(e - y) < 1 for e, y in held) > 0.9 * len(held)
    m = quality.train([t for _, t in rows], [i % 5 for i, _ in rows])
    assert (m.thresholds[1:] >= m.thresholds[:-1]).all()
    assert quality.quality_scores(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.quality_scores(make_docs([]), labels).count() == 0


def test_edits_equal_a_full_count(odd_docs, make_docs):
    path = vocabulary("byte_bpe_50k.json")
    e = Encoder(path, True, control_text=True)
    r = random.Random(2)
    letters = ["a", "b", "The", " ", " ", "\n", "\n", "\t", "é", "'s", "'", "1", "!", "　", "́", "<|endoftext|>", "中", "."]
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    for _ in range(600):
        t = word(r.randint(0, 60))
        tree = TokenTree(t, e.find, e.token_count, leaf=r.choice([1, 2, 8]))
        for _ in range(5):
            a = r.randint(0, len(t))
            b, new = min(len(t), a + r.randint(0, 6)), word(r.randint(0, 3))
            t = t[:a] + new + t[b:]
            assert tree.replace(a, b, new) == len(e.whole(t)) // 4 and tree.text() == t
            if r.random() < 0.3:
                tree = TokenTree.stored(t, tree.chars, tree.tokens, e.find, e.token_count)
    docs = make_docs([(1, "mail a.b@c.org or +49 123 456 7890 now"), (2, None)])
    got = {x.doc_id: x for x in edited_counts(docs, path).collect()}
    assert (got[1].n_edits, got[1].n_tokens_edited) == (2, len(e.whole("mail <EMAIL> or <PHONE> now")) // 4)
    assert got[2].n_tokens == 0 and edited_counts(odd_docs, path).count() == odd_docs.count()


def test_trees_and_a_table_of_edits(spark, make_docs, odd_docs):
    path = vocabulary("byte_bpe_50k.json")
    e = Encoder(path, True, control_text=True)
    r = random.Random(6)
    docs = odd_docs.union(make_docs([(i, " ".join(r.choices(["some", "words", "é", "12345", "it's"], k=r.randint(0, 400)))) for i in range(20, 60)]))
    trees = build_trees(docs, path)
    held = {x.row: x for x in trees.collect()}
    assert len(held) == docs.count() and all(x.tokens[1] == len(e.whole(x.text)) // 4 for x in held.values())
    edits, texts = [], {}
    for row, x in held.items():
        at, out, last = 0, "", 0
        for _ in range(r.randint(0, 4)):
            a = min(len(x.text), at + r.randint(0, 300))
            b, new = min(len(x.text), a + r.randint(0, 40)), r.choice(["", "<NEW>", " a b "])
            edits.append((row, a, b, new))
            out, last, at = out + x.text[last:a] + new, b, b + 1
        texts[row] = out + x.text[last:]
    table = spark.createDataFrame([*edits, (10**9, 0, 0, "nobody")], "row long, start long, stop long, new string")
    done = {x.row: x for x in apply_edits(with_edits(trees, table), path).collect()}
    assert {k: x.text for k, x in done.items()} == texts
    assert all(x.n_tokens_edited == x.tokens[1] == len(e.whole(x.text)) // 4 and x.n_tokens == held[k].tokens[1] for k, x in done.items())
    untouched = [k for k in done if not done[k].n_edits]
    assert untouched and all(done[k].reread == 0 and done[k].tokens == held[k].tokens for k in untouched)
    again = with_edits(spark.createDataFrame([done[r] for r in done], "row long, doc_id long, text string, chars array<int>, tokens array<int>, a long, b int, c long, d long").drop("a", "b", "c", "d"), table.limit(0))
    assert sorted(x.n_tokens_edited for x in apply_edits(again, path).collect()) == sorted(x.n_tokens_edited for x in done.values())
    clash = with_edits(trees, spark.createDataFrame([(min(held), 0, 10**6, "")], "row long, start long, stop long, new string"))
    with pytest.raises(Exception, match="outside the text"):
        apply_edits(clash, path).collect()


def test_redactions_do_not_overlap():
    import regex

    compiled = [(regex.compile(p), new) for p, new in REDACTIONS]
    r = random.Random(12)
    for _ in range(300):
        text = "".join(r.choice(["a", ".", "@", "b.c", "1234567", " ", "+49 ", "x@y.zz"]) for _ in range(30))
        want = []
        for p, new in compiled:
            want += [(m.start(), m.end(), new) for m in p.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in want)]
        assert redactions(text, tuple(compiled)) == sorted(want)
