"""How text filters overlap, over all orders in which they can be applied (operator 11).

Five filters look at a whole text: A under MIN_WORDS words, B fewer than half of the words distinct, C many capitals, D a
forbidden mark, E a copy of a text with a smaller doc_id. A to D are functions of the text alone. For E the texts meet in
compressed (radix) tries: every task sorts its texts and settles its own copies, so that a text leaves it once, however
often it is there; the texts left are dealt into ranges of text order by adaptive prefixes, a prefix that holds too much
being replaced by longer ones; and a range, sorted, goes through tries of about TRIE_BYTES, one after the other, whose
terminals hold the least doc_id of their text. Traversing a trie tells which of its rows are copies. What a row fails is a
mask of five bits, and all that is asked about any order follows from the number of rows of each part and mask.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import blocks, stored

FILTERS = "ABCDE"
#: The bits of a mask: bit k is filter k of FILTERS.
A, B, C, D, E = (1 << k for k in range(5))
MIN_WORDS = 200
DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 3
#: Marks that filter D forbids, letters that filter C counts.
_MARKS, _CAPITALS = re.compile(rb"[#$%&*|]"), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text in a trie, up to one text more.
TRIE_BYTES = 8 << 20
#: Text that a range should hold, and the least share of all text that makes a prefix too large (else it is half a range):
#: a level has at most 1 / LARGE_SHARE such prefixes, which are what the driver holds.
RANGE_BYTES, LARGE_SHARE = 64 << 20, 1e-4
#: Lengths of prefixes, in characters.
DEPTHS = (16, 64, 256, 1024, 4096)


def fails(text: bytes, n_chars: int) -> int:
    """The mask of A to D."""
    n, distinct = 0, set()
    for part in blocks(text):
        words = part.split()
        n += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    few, same = A * (n < MIN_WORDS), B * (100 * len(distinct) < DISTINCT_PERCENT * n)
    return few | same | C * (100 * capitals > CAPITAL_PERCENT * n_chars) | D * (_MARKS.search(text) is not None)


class RadixTrie:
    """A compressed trie of byte strings; a terminal holds the least number inserted for its string and its rows."""

    def __init__(self):
        self.label, self.child = [b""], [{}]
        self.least: list[int | None] = [None]
        self.rows: list[list[int]] = [[]]

    def _node(self, label: bytes) -> int:
        self.label.append(label)
        self.child.append({})
        self.least.append(None)
        self.rows.append([])
        return len(self.label) - 1

    def insert(self, key: bytes, number: int, row: int | None = None) -> None:
        node, at = 0, 0
        while at < len(key):
            below = self.child[node].get(key[at])
            if below is None:
                below = self.child[node][key[at]] = self._node(key[at:])
            label = self.label[below]
            if not key.startswith(label, at):
                shared = _shared(label, key, at)
                middle = self.child[node][key[at]] = self._node(label[:shared])
                self.label[below] = label[shared:]
                self.child[middle][label[shared]] = below
                below = middle
            node, at = below, at + len(self.label[below])
        if self.least[node] is None or number < self.least[node]:
            self.least[node] = number
        if row is not None:
            self.rows[node].append(row)

    def terminals(self) -> Iterator[tuple[int, list[int]]]:
        """(least number, rows) of every terminal."""
        todo = [0]
        while todo:
            node = todo.pop()
            if self.least[node] is not None:
                yield self.least[node], self.rows[node]
            todo.extend(self.child[node].values())


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Bytes that label and key from at on begin with alike."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, part) in the order of text and doc_id to (doc_id, part, fails, text). Only the rows of a text's
    least doc_id keep it; the others are copies already. A row without doc_id is no copy and makes none."""
    last, least, mask = None, None, 0
    for b in batches:
        ids, texts, own, open_ = b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), [], []
        chars = pc.utf8_length(b.column("text")).to_pylist()
        same = [False, *pc.equal(texts[1:], texts[:-1]).to_pylist()] if len(texts) else []
        for i, n in enumerate(ids):
            if not same[i] and (text := texts[i].as_py()) != last:
                last, least, mask = text, None, fails(text, chars[i])
            least = n if least is None else least
            open_.append(n is not None and n == least)
            own.append(mask | E * (n is not None and n > least))
        kept = pc.if_else(pa.array(open_, pa.bool_()), b.column("text"), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(own, pa.int32()), kept], ["doc_id", "part", "fails", "text"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, fails, text) in the order of text to (doc_id, part, fails): copies get E. The last text of a
    trie begins the next one, so that a text's rows may lie in many batches."""
    trie, held, seen, last = RadixTrie(), [], 0, None

    def close() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, own = rows.column("doc_id").to_numpy(), rows.column("fails").to_numpy().copy()
        for least, at in trie.terminals():
            if at:
                own[at] |= E * (ids[at] > least)
        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("part").combine_chunks(), pa.array(own)], ["doc_id", "part", "fails"])

    n = 0
    for b in batches:
        held.append(b.select(["doc_id", "part", "fails"]))
        for number, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
            key = text.as_py()
            trie.insert(key, number, n)
            n, seen = n + 1, seen + len(key)
            last = (key, number) if last is None or last[0] != key else (key, min(last[1], number))
        if seen >= TRIE_BYTES:
            yield close()
            trie, held, seen, n = RadixTrie(), [], 0, 0
            trie.insert(*last)
    if held:
        yield close()


def _key(texts: DataFrame) -> tuple[DataFrame, int]:
    """texts with a column key, a prefix of text such that keys are in the order of texts and, if texts differ early
    enough, none holds a large share of them; and the number of ranges."""
    prefix = lambda d: F.substring("text", 1, d)
    weight = F.sum(F.octet_length("text").cast("long") + 1).alias("w")
    total = texts.agg(weight).first()["w"] or 0
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    most = max(total / (2 * n), total * LARGE_SHARE)
    key, rest = prefix(DEPTHS[0]), texts
    for depth, longer in zip(DEPTHS, DEPTHS[1:]):
        large = [r["p"] for r in rest.groupBy(prefix(depth).alias("p")).agg(weight).filter(F.col("w") > most).select("p").collect()]
        if not large:
            break
        table = F.broadcast(texts.sparkSession.createDataFrame([(p,) for p in large], "large string"))
        texts = texts.join(table, prefix(depth) == F.col("large"), "left")
        key = F.when(F.col("large").isNotNull(), prefix(longer)).otherwise(key if depth == DEPTHS[0] else F.col("key"))
        texts = texts.withColumn("key", key).drop("large")
        rest = rest.join(table, prefix(depth) == F.col("large"), "left_semi")
    return texts if "key" in texts.columns else texts.withColumn("key", key), n


def flags(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, fails) for each row of docs (doc_id, text and the column part): the mask of the filters that it
    fails, each looked at alone and over the whole table. Null texts and parts count as empty. Rows with the least doc_id
    of a text are no copies, all of them if they are repeated; a null doc_id makes no copies and is none. Other columns
    are ignored; no rows give no rows. A task holds one text whole, with its distinct words, and one trie."""
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), empty("text").alias("text"), empty(part).alias("part"))
    local = stored(rows.sortWithinPartitions("text", "doc_id").mapInArrow(_settled, "doc_id long, part string, fails int, text string"))
    done = local.filter("text IS NULL").drop("text")
    texts, n = _key(local.filter("text IS NOT NULL"))
    ranges = texts.repartitionByRange(n, "key").drop("key").sortWithinPartitions("text", "doc_id")
    return done.unionByName(ranges.mapInArrow(_marked, "doc_id long, part string, fails int"))


def counts(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): rows of each part and mask, and how many of them labels (doc_id, quality, toxic)
    calls good (quality 1) and toxic (1). A doc_id with several labels has each that one of them gives."""
    yes = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    known = labels.groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return marked.join(known, "doc_id", "left").groupBy("part", "fails").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part and
    step of each order of FILTERS, from rows (part, fails, n, good, toxic). A filter removes what it is the first of its
    order to be failed: of the orders of f filters that a row fails, each is first in 1 / f."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": k, "own": own, "before": before})
            before |= own
    n_orders = len(steps) // len(FILTERS)
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    each = counted.select("*", F.inline(literal))
    mine, earlier = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    share = F.col("n") * F.floor(F.lit(n_orders) / F.greatest(F.bit_count("fails"), F.lit(1)))
    return each.groupBy("part", "filter_order", "step").agg(
        total(~mine & ~earlier).alias("kept"),
        total(mine & ~earlier).alias("removed"),
        total(mine & earlier).alias("redundant"),
        total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(mine & ~earlier, "good").alias("good_lost"),
        total(mine & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(mine, share).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """interactions() of docs by the values of part; no rows give no parts."""
    return interactions(counts(flags(docs, part), labels))
