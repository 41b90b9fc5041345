import numpy as np

from concord.llm import queries, quality
from concord.llm.common import table

SF = "/root/testdata/sf0.01"


def test_agrees_with_labels(spark):
    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, SF).collect()}
    assert len(got) == table(spark, SF, "documents").count()
    labels = table(spark, SF, "labels").collect()
    bad = [got[r.doc_id].rejected for r in labels if r.quality == 0 or r.toxic == 1]
    good = [got[r.doc_id].rejected for r in labels if r.quality == 1 and r.toxic == 0]
    assert np.mean(bad) > 0.95 and np.mean(good) < 0.02


def test_em_separates_faults_without_labels():
    g, b = quality.GOOD, quality.BAD
    code = lambda bad: sum((b if i in bad else g) << 2 * i for i in range(7))
    p = quality.expectation_maximisation([(code(()), 900), (code((1,)), 30), (code((4,)), 40), (code((5, 6)), 20)])
    assert p[code(())] < 0.1 and min(p[code((1,))], p[code((4,))], p[code((5, 6))]) > 0.5
    assert quality.expectation_maximisation([]) == {}


def test_odd_rows(spark):
    rows = [(1, "good words here. " * 9), (2, None), (3, ""), (4, "Te " * 500), (None, "x y z"), (4, "Te " * 500), (5, "é" * 300000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, _score int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (4, None, None), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scorer = quality.train(docs, labels)
    got = quality.score(docs, scorer).collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    empty = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0


def test_measures_in_pieces(monkeypatch):
    from concord.llm import common

    text = "A b!! b!! b!! idiot | ## Idiot ABC " * 40
    whole = quality.look(text, frozenset([b"abc"]))
    monkeypatch.setattr(quality, "blocks", lambda data: common.blocks(data, 30))
    assert quality.look(text, frozenset([b"abc"])) == whole
    assert whole[0][5] == 80 and whole[0][6] == 40


def test_marks_alone_are_scored_by_their_votes():
    bad = {x: quality.zlib.crc32(f"{x}={quality.BAD}".encode()) % quality.BUCKETS for x in ("bars", "symbols", "exclaims")}
    scorer = quality.Scorer(list(bad.values()), np.full(3, 5.0), -2.0, frozenset())
    assert all(scorer.score(t) > 0.5 for t in ("| | | | | |", "*** ### $$$ %%%", "!!!! !!!! !!!!"))
    assert scorer.score(None) == scorer.score("") == scorer.score(" \n\t") == scorer.score(" . ") < 0.5


def test_agrees_with_labels_it_has_not_seen(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    held = "crc32(cast(doc_id as string)) % 4 = 0"
    scorer = quality.train(docs, labels.filter(f"not {held}"))
    got = {r.doc_id: r._rejected for r in quality.score(docs.filter(held), scorer).select("doc_id", "_rejected").collect()}
    rows = labels.filter(held).collect()
    bad = [got[r.doc_id] for r in rows if r.quality == 0 or r.toxic == 1]
    good = [got[r.doc_id] for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean(bad) > 0.93 and np.mean(good) < 0.03


def test_em_estimates_the_accuracy_of_every_labeller():
    """Ten labels in a hundred are wrong; the other labellers outvote them."""
    g, b, last = quality.GOOD, quality.BAD, 2 * (len(quality.LABELLERS) - 1)
    code = lambda bad, label: sum((b if i in bad else g) << 2 * i for i in range(7)) | label << last
    fault = (5, 6)  # two labellers look for it
    p = quality.expectation_maximisation([(code((), g), 8100), (code((), b), 90), (code(fault, b), 900), (code(fault, g), 100)])
    assert p[code((), g)] < 0.05 and p[code(fault, b)] > 0.95 and p[code(fault, g)] > 0.5
