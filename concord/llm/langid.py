"""Language ID with language-bitmask n-gram filters (operator 1).

Training: the GRAM-letter grams of a bounded sample of labelled texts are counted by language in Spark; those common
enough go into one bit-sliced Bloom filter, whose slots hold a bit for every language. Only the slots (SLOTS x words of
64 languages) reach the driver.

Prediction: one map pass. A gram's slots, combined with AND, are the set of all languages that may contain it.
Popcounts by language over a text's grams, corrected for each language's false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import cut

#: Letters (or word edges) in a gram.
GRAM = 3
#: Slots of the filter, a power of two, and hashes of a gram.
SLOT_BITS = 18
#: Odd multipliers of the two hashes.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The bound of the sample: about so many labelled rows of each language are learned from.
TRAIN_ROWS = 2000
#: Languages learned, at most.
MOST_LANGUAGES = 1024
#: A gram belongs to a language if it makes up this share of its grams, and occurs at least twice.
LEAST_SHARE = 2e-5
#: Characters looked at in one numpy step.
CHUNK = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each UTF-16 unit the lower-cased letter, or 0 where it is no letter. Halves of pairs stand for themselves."""
    table = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            table[c] = c
        elif chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


_table: list[np.ndarray] = []


def _coded(text: str) -> np.ndarray:
    if not _table:
        _table.append(_letters())
    return _table[0][np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]


def has_letter(text: str, coded: np.ndarray) -> bool:
    plain = (coded > 0) & ((coded < 0xD800) | (coded >= 0xE000))
    return bool(plain.any()) or ((coded > 0).any() and any(c.isalpha() for c in text if ord(c) > 0xFFFF))


def grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, gram) of all grams of coded texts. Runs of non-letters, and both ends, are one word edge."""
    size = np.array([len(t) + 2 for t in texts])
    unit = np.zeros(size.sum(), np.uint16)
    ends = np.cumsum(size)
    for t, e in zip(texts, ends):
        unit[e - 1 - len(t) : e - 1] = t
    of = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    keep = unit > 0
    keep[1:] |= (unit[:-1] > 0) | (of[1:] != of[:-1])
    keep[:1] = True
    unit, of = unit[keep].astype(np.uint64), of[keep]
    n = max(0, len(unit) - GRAM + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = (gram << np.uint64(16)) | unit[k : k + n]
    same = of[:n] == of[GRAM - 1 : GRAM - 1 + n]
    return of[:n][same], gram[same]


def _pieces(texts: Iterator[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts in lists of about CHUNK units with their places; a longer text comes in overlapping pieces."""
    places, held, units = [], [], 0
    for place, text in enumerate(texts):
        for s in range(0, max(1, len(text) - GRAM + 1), CHUNK):
            places.append(place)
            held.append(text[s : s + CHUNK + GRAM - 1])
            units += len(held[-1])
            if units >= CHUNK:
                yield places, held
                places, held, units = [], [], 0
    if held:
        yield places, held


def slot(gram: np.ndarray, multiplier: int) -> np.ndarray:
    return (gram * np.uint64(multiplier)) >> np.uint64(64 - SLOT_BITS)


class Filter:
    """The bit-sliced Bloom filter: masks[w, slot] has the bits of languages 64 w .. 64 w + 63."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages = languages
        small = len(languages) <= 8
        self.masks = masks.astype(np.uint8) if small else masks
        bit = [(masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
        self.false = np.array([b.mean() ** len(HASHES) for b in bit])

    def counts(self, of: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """How many grams of each of n texts each language may contain."""
        first, second = (slot(gram, h) for h in HASHES)
        k = len(self.languages)
        if k <= 8:
            found = self.masks[0][first] & self.masks[0][second]
            by = np.bincount((of.astype(np.int64) << 8) | found, minlength=n << 8).reshape(n, 256)
            return np.stack([by[:, (np.arange(256) >> i) & 1 == 1].sum(axis=1) for i in range(k)], axis=1)
        out = []
        for word in self.masks:
            found = word[first] & word[second]
            out += [np.bincount(of, (found >> np.uint64(i)) & np.uint64(1), n) for i in range(min(64, k - len(out)))]
        return np.stack(out, axis=1).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, k = len(texts), len(self.languages)
        lettered = np.zeros(n, bool)
        total, held = np.zeros(n, np.int64), np.zeros((n, k), np.int64)

        def coded() -> Iterator[np.ndarray]:
            for i, t in enumerate(texts):
                c = _coded(t or "")
                lettered[i] = has_letter(t or "", c)
                yield c

        for places, part in _pieces(coded()):
            of, gram = grams(part)
            places = np.array(places)
            np.add.at(total, places, np.bincount(of, minlength=len(part)))
            if k:
                np.add.at(held, places, self.counts(of, gram, len(part)))
        if not k:
            return [UNKNOWN] * n, [0.0] * n
        own = (held - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9)
        share = np.clip(own / np.maximum(total, 1)[:, None], 0, 1)
        best = share.argmax(axis=1)
        langs = [self.languages[b] if x else UNKNOWN for b, x in zip(best, lettered)]
        return langs, np.where(lettered, share[np.arange(n), best], 0.0).tolist()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column("l").to_numpy()
        for places, part in _pieces(_coded(t.as_py() or "") for t in batch.column("text")):
            of, gram = grams(part)
            by = lang[np.array(places)][of]
            for one in np.unique(by):
                g, c = np.unique(gram[by == one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), one, np.int32)), pa.array(g.view(np.int64)), pa.array(c)], ["l", "gram", "c"])


def _slot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, gram = batch.column("l").to_numpy().astype(np.int64), batch.column("gram").to_numpy().view(np.uint64)
        bit = (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)
        for h in HASHES:
            yield pa.RecordBatch.from_arrays([pa.array((lang // 64).astype(np.int32)), pa.array(slot(gram, h).view(np.int64)), pa.array(bit)], ["w", "slot", "bit"])


def train(labelled: DataFrame) -> Filter:
    """The filter learned from labelled (doc_id, text, lang); rows without text or lang are left out.

    About TRAIN_ROWS rows of each language are taken, chosen by a hash of doc_id; rows that repeat a text count once. The
    MOST_LANGUAGES most frequent values of lang are learned, which bounds the filter where lang is dirty. Languages are numbered from the most
    frequent on, names in order where they tie; a tie in a prediction goes to the first."""
    rows = labelled.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    languages = [r["lang"] for r in sizes]
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((words, 1 << SLOT_BITS), np.uint64)
    if not languages:
        return Filter([], masks)
    spark = labelled.sparkSession
    plan = spark.createDataFrame([(i, r["lang"], min(1.0, TRAIN_ROWS / r["count"])) for i, r in enumerate(sizes)], "l int, lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(plan), "lang").filter(draw < F.col("share")).select("l", "text").dropDuplicates()
    counted = sample.mapInArrow(_gram_counts, "l int, gram long, c long").groupBy("l", "gram").agg(F.sum("c").alias("c"))
    counted = cut(counted)
    total = F.broadcast(counted.groupBy("l").agg(F.sum("c").alias("n")))  # a row for each language
    common = counted.join(total, "l").filter((F.col("c") >= F.col("n") * LEAST_SHARE) & (F.col("c") >= 2))
    slots = common.select("l", "gram").mapInArrow(_slot_bits, "w int, slot long, bit long")
    by = slots.groupBy("w", "slot").agg(F.bit_or("bit").alias("bits"))
    for r in by.collect():  # at most the filter's own size
        masks[r.w, r.slot] = r.bits & (1 << 64) - 1
    return Filter(languages, masks)


def predict(docs: DataFrame, learned: Filter) -> DataFrame:
    """docs with _lang and _score; the other columns stay. A null text, or one without a letter, is 'und' with score 0;
    so is every text if nothing was learned. A text whose grams no language has gets the first language, score 0."""
    held = docs.sparkSession.sparkContext.broadcast(learned)  # of fixed size

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = held.value.predict(b.column("text").to_pylist())
            own = [(f, c) for f, c in zip(b.schema, b.columns) if f.name not in ("_lang", "_score")]
            cols = [c for _, c in own] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f, _ in own] + ["_lang", "_score"])

    fields = [f for f in docs.schema.fields if f.name not in ("_lang", "_score")]
    schema = T.StructType([*fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(predicted, schema)
