"""Quality classifier from weak labels (operator 10).

1. Heuristic labellers vote bad, good or not at all on every text: shares of capitals, symbols, cell bars, exclamations
   and repeated words, a lexicon of insults, a second lexicon learned from labelled texts, and the given labels.
2. Only the number of documents for each pattern of votes leaves Spark. Expectation-maximisation over that table
   estimates each labeller's accuracy for either class, and so the probability of bad for each pattern.
3. A hashed linear scorer is fitted to those probabilities on a bounded sample of documents. Its features are hashed
   words and the votes that a text's measures stand for. It alone decides: a document with a score of REJECT or more goes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import blocks, cut, encode, fresh
from concord.llm.decontaminate import _WORDS

REJECT = 0.5
#: The bound of the labelled sample that the second lexicon is learned from, in rows.
LABELLED_ROWS = 20_000
#: The bound of the sample that the scorer is fitted on, in rows.
TRAIN_ROWS = 20_000
#: What the sample for the fit never exceeds, should one doc_id have very many different texts.
MOST_ROWS = 4 * TRAIN_ROWS
#: A learned insult occurs in so many bad labelled texts of good style at least, and in this share of bad ones.
LEXICON_TEXTS, LEXICON_SHARE, LEXICON_WORDS = 5, 0.8, 10_000
#: Hashed features: size of the space, and how many the scorer keeps.
BUCKETS, FEATURES, FEATURE_TEXTS = 1 << 22, 4096, 5
#: Steps of expectation-maximisation and of the fit.
EM_STEPS, FIT_STEPS = 50, 200
#: Insults.
INSULTS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
#: Measures, and the values from which each votes bad, and below which it votes good.
STYLES = {"capitals": (0.3, 0.2), "symbols": (0.2, 0.05), "bars": (0.08, 0.02), "exclaims": (0.08, 0.02), "repeats": (0.1, 0.06)}
LABELLERS = [*STYLES, "insults", "learned", "labels"]
#: How often a given label says bad, of good and of bad texts: where its estimate starts.
GIVEN = [0.01, 0.95]
#: The faults that a bad text may have, by the labellers that look for each.
FAULTS = [("capitals", "exclaims"), ("symbols",), ("bars",), ("repeats",), ("insults", "learned")]
NONE, GOOD, BAD = 0, 1, 2
_INSULTS = frozenset(w.encode() for w in INSULTS)
_NO_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_NO_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_NO_SYMBOLS = bytes(c for c in range(256) if c not in b"*#&%$^~")


def look(text: str | None, learned: frozenset) -> tuple[list[float], set[bytes]]:
    """The measures of a text, in LABELLERS' order without labels, and its distinct words."""
    known: set[bytes] = set()
    n = repeats = capitals = letters = symbols = bars = exclaims = insults = taught = 0
    last: bytes | None = None
    for part in blocks(encode(text or "")):
        words = part.split()
        n += len(words)
        repeats += sum(map(eq, words, words[1:])) + bool(words and words[0] == last)
        last = words[-1] if words else last
        capitals += len(part.translate(None, _NO_CAPITALS))
        letters += len(part.translate(None, _NO_LETTERS))
        symbols += len(part.translate(None, _NO_SYMBOLS))
        bars += part.count(b"|")
        exclaims += part.count(b"!!")
        plain = part.translate(_WORDS).split()
        own = set(plain)
        insults += sum(w in _INSULTS for w in plain) if own & _INSULTS else 0
        taught += sum(w in learned for w in plain) if own & learned else 0
        known |= own
    per = n + 5  # one mark in a very short text is no fault
    caps = capitals / letters if letters >= 20 else 0.0
    return [caps, symbols / per, bars / per, exclaims / per, repeats / per, insults, taught], known


def votes(measures: list[float]) -> int:
    """The pattern of the votes, two bits a labeller; labels come last and are added later."""
    code = 0
    for i, ((bad, good), x) in enumerate(zip(STYLES.values(), measures)):
        code |= (BAD if x >= bad else GOOD if x < good else NONE) << 2 * i
    for i, x in enumerate(measures[len(STYLES) :], len(STYLES)):
        code |= (BAD if x >= 2 else NONE if x else GOOD) << 2 * i
    return code


def features(measures: list[float], known: set[bytes]) -> set[int]:
    """Hashed features: words, and the vote that each measure stands for."""
    out = {zlib.crc32(w) % BUCKETS for w in known}
    code = votes(measures)
    for i, name in enumerate(LABELLERS[:-1]):
        out.add(zlib.crc32(f"{name}={code >> 2 * i & 3}".encode()) % BUCKETS)
    return out


def given(labels: DataFrame) -> DataFrame:
    """(doc_id, vote) of labelled documents: bad if any row says quality 0 or toxic 1, good if all say neither."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    vote = F.when(bad, BAD).when(good, GOOD).otherwise(NONE)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(vote).alias("vote"))


def sampled(df: DataFrame, n: int, total: int, salt: int) -> DataFrame:
    """About n of total rows, chosen by a hash of doc_id."""
    return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < F.lit(int(min(1.0, n / max(1, total)) * (1 << 30))))


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> frozenset:
    """Words of labelled bad texts of good style that good texts hardly have. Counted in Spark; at most LEXICON_WORDS."""
    chosen = sampled(labels.filter(F.col("vote") != NONE), LABELLED_ROWS, labels.count(), 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bad = [], []
            for text, vote in zip(b.column("text"), b.column("vote").to_pylist()):
                measures, known = look(text.as_py(), frozenset())
                if not any(x >= at for (at, _), x in zip(STYLES.values(), measures)):
                    word += known
                    bad += [vote == BAD] * len(known)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(bad, pa.bool_())], ["word", "bad"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "vote").mapInArrow(words, "word binary, bad boolean")
    by = rows.groupBy("word").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"))
    found = by.filter((F.col("bad") >= LEXICON_TEXTS) & (F.col("bad") >= F.col("n") * LEXICON_SHARE))
    return frozenset(bytes(r.word) for r in found.orderBy(F.desc("bad"), "word").limit(LEXICON_WORDS).collect())


def expectation_maximisation(patterns: list[tuple[int, int]]) -> dict[int, float]:
    """The probability of bad for each (pattern, number of documents).

    A text is good or has one of the faults of FAULTS; a labeller votes bad with a probability of its own for each of
    them, and its silence says nothing. The start ties each labeller to its fault and the given labels, which are right or
    wrong alike about every fault, to GIVEN. All accuracies, those of the labels too, are estimated from there on."""
    code = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([n for _, n in patterns], float)
    vote = (code[:, None] >> 2 * np.arange(len(LABELLERS))) & 3
    said_bad, spoke = (vote == BAD).astype(float), (vote != NONE).astype(float)
    rate = np.array([[0.8 if name in own else 0.01 for name in LABELLERS] for own in [(), *FAULTS]])  # P(votes bad)
    prior = np.array([0.8, *[0.2 / len(FAULTS)] * len(FAULTS)])
    share = np.zeros((len(code), len(prior)))
    rate[:, -1] = [GIVEN[0], *[GIVEN[1]] * len(FAULTS)]
    for _ in range(EM_STEPS):
        log = said_bad @ np.log(rate).T + (spoke - said_bad) @ np.log(1 - rate).T + np.log(prior)
        share = np.exp(log - log.max(axis=1, keepdims=True)) if len(code) else share
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        mass = weight[:, None] * share
        prior = (mass.sum(axis=0) + 0.1) / (mass.sum() + 0.1 * len(prior))
        hits, all_ = mass.T @ said_bad, mass.T @ spoke
        rate = (hits + 0.01) / (all_ + 0.1)
        for k, start in ((slice(0, 1), GIVEN[0]), (slice(1, None), GIVEN[1])):
            rate[k, -1] = (hits[k, -1].sum() + 0.1 * start) / (all_[k, -1].sum() + 0.1)
        rate = np.clip(rate, 1e-4, 1 - 1e-3)
    return dict(zip(code.tolist(), (1 - share[:, 0]).tolist()))


class Scorer:
    """weights of the kept buckets, and the bias."""

    def __init__(self, buckets: list[int], weights: np.ndarray, bias: float, learned: frozenset):
        self.weight = dict(zip(buckets, weights.tolist()))
        self.bias, self.learned = bias, learned

    def score(self, text: str | None) -> float:
        measures, known = look(text, self.learned)
        z = self.bias
        if text and not text.isspace():
            get = self.weight.get
            z += sum(get(b, 0.0) for b in sorted(features(measures, known) & self.weight.keys()))
        return 1 / (1 + float(np.exp(-max(-50.0, min(50.0, z)))))


def _fit(rows: list[list[int]], target: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on sets of features 0 .. n - 1, by full gradients with adaptive steps."""
    sizes = np.array([len(r) for r in rows], np.int64)
    col = np.concatenate([np.array(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, FIT_STEPS + 1):
        z = np.bincount(row, w[col], len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        grad = np.append(np.bincount(col, error[row], n) / max(1, len(rows)) + 1e-5 * w, error.mean() if len(rows) else 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer learned from docs (doc_id, text) and labels (doc_id, quality, toxic), either of which may be empty.

    Votes are counted over all documents; lexicon and fit use samples of about LABELLED_ROWS and TRAIN_ROWS rows. A
    document may lack a label, and a label its document. Rows with a null doc_id are scored but not learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    known = cut(given(labels))
    learned = learn_lexicon(docs, known)
    held = spark.sparkContext.broadcast(learned)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = [votes(look(t.as_py(), held.value)[0]) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(code, pa.int32())], ["doc_id", "code"])

    label = F.col("vote") * (1 << 2 * (len(LABELLERS) - 1))
    all_votes = cut(docs.mapInArrow(voted, "doc_id long, code int")).join(known, "doc_id", "left").select("doc_id", F.col("code").bitwiseOR(F.coalesce(label, F.lit(0))).alias("code"))
    counts = [(r.code, r.n) for r in all_votes.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()]  # 3^8 at most
    probability = spark.sparkContext.broadcast(expectation_maximisation(counts))
    n = sum(x for _, x in counts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, f = [], []
            for text, vote in zip(b.column("text"), b.column("vote").to_pylist()):
                measures, words = look(text.as_py(), held.value)
                p.append(probability.value.get(votes(measures) | (vote or 0) << 2 * (len(LABELLERS) - 1), 0.5))
                f.append(sorted(features(measures, words)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(f, pa.list_(pa.int32()))], ["doc_id", "p", "f"])

    chosen = sampled(docs, TRAIN_ROWS, n, 2).join(sampled(known, TRAIN_ROWS, n, 2), "doc_id", "left")
    made = chosen.select("doc_id", "text", "vote").mapInArrow(hashed, "doc_id long, p double, f array<int>")
    rows = cut(made.dropDuplicates().limit(MOST_ROWS))  # rows that repeat a doc_id and its text count once
    by = rows.select("p", F.explode("f").alias("b")).groupBy("b").agg(F.sum("p").alias("bad"), F.count("*").alias("n")).filter(F.col("n") >= FEATURE_TEXTS)
    total = rows.agg(F.sum("p"), F.count("*")).first()
    bads, size = total[0] or 0.0, total[1]
    lean = F.abs(F.log((F.col("bad") + 0.5) / (bads + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (size - bads + 1))) * F.sqrt(F.col("n"))
    buckets = sorted(r.b for r in by.orderBy(F.desc(lean), "b").limit(FEATURES).select("b").collect())
    place = {b: i for i, b in enumerate(buckets)}
    data = rows.mapInArrow(_only(spark.sparkContext.broadcast(place)), "doc_id long, p double, f array<int>")
    got = sorted(data.collect(), key=lambda r: (r.doc_id, r.p, r.f))  # about TRAIN_ROWS rows of kept features
    weights, bias = _fit([r.f for r in got], np.array([r.p for r in got]), len(buckets))
    return Scorer(buckets, weights, bias, learned)


def _only(place):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [[place.value[x] for x in row if x in place.value] for row in b.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("p"), pa.array(f, pa.list_(pa.int32()))], ["doc_id", "p", "f"])

    return kept


def score(docs: DataFrame, scorer: Scorer, score: str = "_score", rejected: str = "_rejected") -> DataFrame:
    """docs with _score, the probability of bad from 0 to 1, and _rejected, or other names for them, whose columns are
    replaced where docs has them; the other columns stay.

    A null or blank text gets the score of the bias alone, a text of marks alone that of its votes. Repeated texts get equal scores."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # FEATURES weights and the lexicon

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([held.value.score(t.as_py()) for t in b.column("text")], pa.float64())
            own = [(f.name, c) for f, c in zip(b.schema, b.columns) if f.name != score]
            yield pa.RecordBatch.from_arrays([c for _, c in own] + [s], [x for x, _ in own] + [score])

    fields = [f for f in docs.schema.fields if f.name not in (score, rejected)]
    schema = T.StructType([*fields, T.StructField(score, T.DoubleType())])
    return docs.drop(rejected).mapInArrow(scored, schema).withColumn(rejected, F.col(score) >= REJECT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier, learned from docs and labels, does not reject."""
    p, rejected = fresh(docs.columns, "_score", "_rejected")
    return score(docs, train(docs, labels), p, rejected).filter(~F.col(rejected)).select(*docs.columns)
