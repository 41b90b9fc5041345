import random
from collections import defaultdict

import numpy as np
import pytest

from concord.llm import chunks
from concord.llm.common import table


def brute(rows):
    """Words of each document that lie in a 51-word window which another document has."""
    by, docs = defaultdict(set), {}
    for d, t in rows:
        if d is not None and t is not None:
            w = docs[d] = t.split()
            for i in range(len(w) - 50):
                by[tuple(w[i : i + 51])].add(d)
    return {d: {i + k for i in range(len(w) - 50) if len(by[tuple(w[i : i + 51])]) > 1 for k in range(51)} for d, w in docs.items()}


@pytest.mark.parametrize("limit, bits", [(1 << 24, 8), (1 << 24, 6), (0, 7)])
def test_planted_passages(spark, monkeypatch, limit, bits):
    monkeypatch.setattr(chunks, "FILTER_KEYS", limit)
    monkeypatch.setattr(chunks, "SPAN_BITS", bits)
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(3000)] + ["the", "of"] * 300
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    passages = [text(n) for n in (51, 52, 55, 60, 80, 120, 300, 700)]
    rows = [(i, f"{text(r.randrange(0, 90))} {r.choice(passages)}\n{text(r.randrange(0, 90))}") for i in range(120)]
    rows += [(200 + i, text(r.randrange(1, 400))) for i in range(100)]
    short = text(50)
    rows += [(400 + i, f"{text(40)} {short} {text(40)}") for i in range(10)] + [(500 + i, text(30)) for i in range(3)]
    copy = text(200)
    rows += [(600 + i, copy) for i in range(5)] + [(700, copy.replace(" ", "  ")), (701, None), (702, ""), (None, copy), (710, text(90)), (710, "x")]
    rows += [(720, passages[3] + " " + passages[4]), (721, "w" * 100000 + " " + passages[2])]
    rows.append(rows[-1])
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, _gone int")
    got = defaultdict(set)
    for x in chunks.repeated_passages(df).collect():
        assert x.n_words >= 51 and x.first_doc_id <= x.doc_id
        got[x.doc_id] |= set(range(x.start_word, x.start_word + x.n_words))
    want = {d: w for d, w in brute(rows).items() if w}
    assert set(got) == set(want)
    for d, w in want.items():
        assert got[d] == w, d
    assert chunks.repeated_passages(df.limit(0)).count() == 0
    left = chunks.drop_repeats(df)
    assert left.columns == df.columns and left.count() == len(rows)
    texts = {x.doc_id: x.text for x in left.collect()}
    assert texts[600] == copy and texts[603] == "" and texts[702] == "" and texts[701] is None


def test_cuts_resist_insertions():
    r = random.Random(1)
    words = ["".join(r.choices("abcdef", k=5)) for _ in range(2000)]
    _, _, a, _ = chunks.chunked(" ".join(words))
    _, _, b, _ = chunks.chunked(" ".join(["new", "words", *words]))
    assert len(set(a[1:] + 2) - set(b)) <= 3 and 300 < len(a) < 700


def test_pieces_do_not_move_cuts(monkeypatch):
    text = table.__doc__ or "" + " ".join(f"w{i * i}" for i in range(3000))
    want = chunks.chunked(text)[2]
    monkeypatch.setattr(chunks, "_PIECE", 64)
    assert np.array_equal(chunks.chunked(text)[2], want)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {d: w for d, w in brute([(r.doc_id, r.text) for r in docs.collect()]).items() if w}
    got = defaultdict(set)
    for x in chunks.repeated_passages(docs).collect():
        got[x.doc_id] |= set(range(x.start_word, x.start_word + x.n_words))
    assert got == want


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_passages_of_copied_documents_in_unique_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(chunks, "FILTER_KEYS", limit)
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(n))
    rows = []
    for i in range(40):
        passage = text(51 + i % 10)
        copied = f"{text(120)} {passage} {text(130)}"
        rows += [(3 * i, copied), (3 * i + 1, copied), (3 * i + 2, f"{text(60 * (i % 3))} {passage} {text(60 * (i % 2))}")]
    rows += [(200 + i, "no " * 60 + "cut") for i in range(2)]
    got = defaultdict(set)
    for x in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x.doc_id] |= set(range(x.start_word, x.start_word + x.n_words))
    assert got == {d: w for d, w in brute(rows).items() if w}


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_texts_that_share_a_doc_id_stay_apart(spark, monkeypatch, limit):
    monkeypatch.setattr(chunks, "FILTER_KEYS", limit)
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    a, b, c = text(80), text(200), text(70)
    rows = [(1, a), (5, f"{a} tail"), (5, b), (5, f"{c} {a}"), (6, f"{b} end"), (5, b)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int")
    got = sorted((x.doc_id, x.text) for x in chunks.drop_repeats(df).collect())
    assert got == sorted([(1, a), (5, "tail"), (5, b), (5, b), (5, c), (6, "end")])
