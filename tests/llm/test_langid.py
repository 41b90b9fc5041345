import numpy as np
import pytest

from concord.llm import langid, queries
from concord.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out").collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(got) > 100 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def brute(learned, text):
    """The same decision with sets of gram strings, one window at a time."""
    unit = [0, *langid._coded(text).tolist(), 0]
    unit = [u for i, u in enumerate(unit) if u or i == 0 or unit[i - 1]]
    wins = [tuple(unit[i : i + langid.GRAM]) for i in range(len(unit) - langid.GRAM + 1)]
    counts = np.zeros(len(learned.languages))
    for w in wins:
        g = np.array([sum(u << 16 * (langid.GRAM - 1 - k) for k, u in enumerate(w))], np.uint64)
        for i in range(len(counts)):
            counts[i] += all(int(learned.masks[0][langid.slot(g, h)[0]]) >> i & 1 for h in langid.HASHES)
    return np.clip((counts - len(wins) * learned.false) / (1 - learned.false) / max(1, len(wins)), 0, 1)


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    monkeypatch.setattr(langid, "LEAST_SHARE", 0)
    rows = [(i, "the cat and the dog " * 3, "en", 1) for i in range(5)] + [(10 + i, "le chat et le chien", "fr", 1) for i in range(4)] + [(20, None, "de", 1), (21, "x", None, 1)]
    learned = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, _score int"))
    assert learned.languages == ["en", "fr"]
    texts = ["the dog", "le chien", None, "", "12 ** \n", "語", "𐍈𐍉", "😀😀", "THE DOG " * 400]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, _score int")
    found = langid.predict(df, learned).orderBy("doc_id").collect()
    assert [r._lang for r in found] == ["en", "fr", "und", "und", "und", "en", "en", "und", "en"]
    for t, r in zip(texts, found):
        if r._lang != "und":
            assert r._score == pytest.approx(brute(learned, t).max())
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r._lang for r in langid.predict(df, none).collect()} == {"und"}


def test_many_languages():
    rng = np.random.default_rng(1)
    names = [f"l{i}" for i in range(70)]
    masks = rng.integers(0, 2**62, (2, 1 << langid.SLOT_BITS), dtype=np.uint64)
    learned = langid.Filter(names, masks)
    of, gram = np.array([0, 0, 1], np.int32), np.array([5, 9, 77], np.uint64)
    got = learned.counts(of, gram, 2)
    for i in range(70):
        bits = [all(int(masks[i // 64][langid.slot(gram[j : j + 1], h)[0]]) >> (i % 64) & 1 for h in langid.HASHES) for j in range(3)]
        assert got[0, i] == bits[0] + bits[1] and got[1, i] == bits[2]
