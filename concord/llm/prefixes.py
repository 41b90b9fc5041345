"""The prefix trie of conversations, in double arrays (operator 13).

A conversation is a sequence of turns, a turn is known by 128 bits of a SHA-256 digest of role and text, and a prefix by a
polynomial of its turns' digests modulo a prime of 127 bits, so that prefixes of a conversation that is cut into segments
of SEGMENT turns can be put together without walking it. A prefix shard holds the segments that begin behind some
prefixes, each different segment once, with the number and the least conv_id of the conversations that go through it;
a prefix with very many continuations is dealt to several shards. A shard gives its turns dense ids, packs its trie
into BASE and CHECK arrays (state s goes over symbol c to BASE[s] + c, if CHECK there is s) and walks all its segments
through them level by level, adding up what each state gets. Upper nodes that several shards share are merged over all
shards, as is every node, by its prefix.

A sum over a subtree needs no walk from below: let each node belong to its least conv_id. A conversation then owns the
end of its own path, and what lies below a node is what its members own, but for the nodes above on its owner's path. So
a second walk with the members' own totals gives all subtree sums, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import stored

#: Rebuilding: conversations come in families of FAMILY ids, and up to MOST_SHARED first turns are those of the family's first.
FAMILY, MOST_SHARED = 100, 5
#: Turns of a segment; turns that a prefix shard should hold; conv_ids that are digested as one text.
SEGMENT, SHARD_TURNS, END_IDS = 1024, 1 << 18, 1 << 16
#: Turns below which a shard is not worth splitting.
LEAST_TURNS = 64
#: The prime and the factor of the polynomial.
PRIME, FACTOR = (1 << 127) - 1, 0x1E3779B97F4A7C15F39CC0605CEDC835
#: The prefix without turns.
ROOT = (1).to_bytes(16, "big")
_NODES = "node binary, parent binary, depth long, chars long, a long, b long, conv long"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars) of rows (conv_id, turn, role, text): pos counts a conversation's turns from 0 in the
    order of turn, nulls first, and of key among equal ones; key stands for role and text, null ones as empty; chars is the
    number of the text's code points. Rows without conv_id belong to no conversation and are left out.

    Rows are sorted by ranges of (conv_id, turn, key) and counted within a range; what a conversation has in earlier
    ranges is added, so that one of any length is spread over many tasks."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    key = F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("key")
    rows = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", key, F.length("text").cast("long").alias("chars"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column("conv_id").to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]]))
            of = np.searchsorted(starts, np.arange(len(ids)), side="right") - 1
            pos = np.arange(len(ids)) - np.concatenate([starts, [-n]])[of]
            last, n = ids[-1], int(pos[-1]) + 1
            cols = [b.column("conv_id"), pa.array(np.full(len(ids), part)), pa.array(pos), b.column("key"), b.column("chars")]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "pos", "key", "chars"])

    laid = rows.repartitionByRange("conv_id", "turn", "key").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "key")
    local = stored(laid.mapInArrow(counted, "conv_id long, part long, pos long, key binary, chars long"))
    pieces = local.groupBy("conv_id", "part").agg(F.count("*").alias("own"))
    before = F.sum("own").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("own")
    later = pieces.select("conv_id", "part", before.alias("before")).filter("before > 0")  # a row for each range at most
    return local.join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "chars")


def shared(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, pos, key, chars) with the first turns of each conversation replaced by those of its family's first,
    and the table (conv_id) of all conversations, those without a turn among them."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    families = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = sizes.select("conv_id", base.alias("base"), shared(F.col("conv_id")).alias("h")).join(families, "base", "left")
    known = stored(known.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("n_head")))
    heads = rows.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    first = known.join(heads, "base").filter("pos < h").select("conv_id", "pos", "key", "chars")
    own = rows.join(known, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "key", "chars")
    return first.unionByName(own), known.select("conv_id")


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _bytes(number: int) -> bytes:
    return number.to_bytes(16, "big")


def segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segments (conv_id, seg, keys, chars) of rows (conv_id, pos, key, chars), and for each its place in the trie:
    (conv_id, seg, prefix, own, after), the prefix before it, its own turns and the prefix behind it."""
    by = rows.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("t"))
    cut = stored(by.select("conv_id", "seg", F.col("t.key").alias("keys"), F.col("t.chars").alias("chars")))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, sizes = [], []
            for keys in b.column("keys"):
                h = 0
                for key in keys.as_py():
                    h = (h * FACTOR + _number(key)) % PRIME
                own.append(_bytes(h))
                sizes.append(len(keys))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array(own, pa.binary()), pa.array(sizes, pa.int64())], ["conv_id", "seg", "own", "size"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, 0
        for b in batches:
            before, after = [], []
            for conv, own, n in zip(b.column("conv_id").to_pylist(), b.column("own").to_pylist(), b.column("size").to_pylist()):
                now = _number(ROOT) if conv != last else now
                before.append(_bytes(now))
                last, now = conv, (now * pow(FACTOR, n, PRIME) + _number(own)) % PRIME
                after.append(_bytes(now))
            cols = [b.column("conv_id"), b.column("seg"), pa.array(before, pa.binary()), b.column("own"), pa.array(after, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "seg", "prefix", "own", "after"])

    own = cut.select("conv_id", "seg", "keys").mapInArrow(digested, "conv_id long, seg long, own binary, size long")
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "seg")  # a row for each SEGMENT turns
    return cut, stored(own.mapInArrow(chained, "conv_id long, seg long, prefix binary, own binary, after binary"))


class DoubleArray:
    """A trie over dense symbols: from state s symbol c leads to base[s] + c if check there is s. State 0 is the root."""

    def __init__(self):
        self.base, self.check, self.first = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1
        self.check[0] = -2  # taken, and reached from nowhere

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free places."""
        found = self.first + np.flatnonzero(self.check[self.first :] == -1)
        if len(found) < n:
            self._grow(len(self.check) + n)
            found = self.first + np.flatnonzero(self.check[self.first :] == -1)
        return found[:n]

    def _base(self, symbols: np.ndarray) -> int:
        """A base that leads over all of symbols, in order, to free places."""
        while self.first < len(self.check) and self.check[self.first] != -1:
            self.first += 1
        low, width, span = self.first, 4096, int(symbols[-1] - symbols[0])
        while True:
            self._grow(low + width + span + 1)
            fits = self.check[low : low + width] == -1
            for step in (symbols[1:] - symbols[0]).tolist():
                fits &= self.check[low + step : low + step + width] == -1
                if not fits.any():
                    break
            if fits.any():
                return low + int(np.argmax(fits)) - int(symbols[0])
            low += width

    def add(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The new states of different pairs (state, symbol), in order, of states that have no symbols yet."""
        out = np.empty(len(states), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]]))
        sizes = np.diff(np.append(starts, len(states)))
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            some = symbols[a : a + n]
            base = self._base(some)
            self.base[states[a]] = base
            out[a : a + n] = base + some
            self.check[base + some] = states[a]
        one = starts[sizes == 1]
        if len(one):
            places = self._free(len(one))
            self.base[states[one]] = places - symbols[one]
            self.check[places] = states[one]
            out[one] = places
            self.first = int(places[-1])
        return out

    def walk(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where pairs (state, symbol) lead; -1 if nowhere."""
        to = self.base[states] + symbols
        inside = (to >= 0) & (to < len(self.check)) & (states >= 0)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def shard_nodes(paths: pa.Table) -> pa.Table:
    """The nodes of one shard's paths (prefix, start, keys, chars, a, b, conv), which begin at depth start: a and b summed, conv the least, over the
    paths that go through a node."""
    prefix = pc.dictionary_encode(paths.column("prefix").combine_chunks())
    lists = paths.column("keys").combine_chunks()
    turn = pc.dictionary_encode(lists.flatten())
    n_prefixes, keys = len(prefix.dictionary), [_number(k) for k in turn.dictionary.to_pylist()]
    symbol, sizes = turn.indices.to_numpy() + n_prefixes, pc.list_value_length(lists).to_numpy()
    starts = np.cumsum(sizes) - sizes
    chars, top = paths.column("chars").combine_chunks().flatten().to_numpy(), prefix.indices.to_numpy()
    array, rows, n_symbols = DoubleArray(), np.arange(len(sizes)), n_prefixes + len(keys)
    hashes: dict[int, int] = {}
    levels, states, now = [], np.zeros(len(sizes), np.int64), top
    for level in range(int(sizes.max(initial=0)) + 1):
        pairs, at, back = np.unique(states * n_symbols + now, return_index=True, return_inverse=True)
        above, over = pairs // n_symbols, pairs % n_symbols
        new = array.add(above, over)
        if level == 0:
            hashes.update((s, _number(prefix.dictionary[c].as_py())) for s, c in zip(new.tolist(), over.tolist()))
        else:
            up = [hashes[s] for s in above.tolist()]
            hashes.update((s, (h * FACTOR + keys[c - n_prefixes]) % PRIME) for s, h, c in zip(new.tolist(), up, over.tolist()))
            levels.append((level, above, new, rows[at]))
        states, on = new[back], sizes[rows] > level
        rows, states = rows[on], states[on]
        now = symbol[starts[rows] + level]
    sums = [np.zeros(len(array.check), np.int64) for _ in range(2)]
    least = np.full(len(array.check), np.iinfo(np.int64).max)
    own = [paths.column(c).to_numpy() for c in ("a", "b", "conv", "start")]
    rows = np.arange(len(sizes))
    states = array.walk(np.zeros(len(sizes), np.int64), top)
    for level in range(int(sizes.max(initial=0)) + 1):
        for total, weight in zip(sums, own):
            np.add.at(total, states, weight[rows])
        np.minimum.at(least, states, own[2][rows])
        on = sizes[rows] > level
        rows, states = rows[on], states[on]
        states = array.walk(states, symbol[starts[rows] + level])
    out = {c: [] for c in ("node", "parent", "depth", "chars", "a", "b", "conv")}
    for level, above, new, row in levels:
        out["node"] += [_bytes(hashes[s]) for s in new.tolist()]
        out["parent"] += [_bytes(hashes[s]) for s in above.tolist()]
        for name, values in (("depth", own[3][row] + level), ("chars", chars[starts[row] + level - 1]), ("a", sums[0][new]), ("b", sums[1][new]), ("conv", least[new])):
            out[name].append(values)
    kinds = {"node": pa.binary(), "parent": pa.binary()}
    cols = {c: pa.array(v, kinds[c]) if c in kinds else pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for c, v in out.items()}
    return pa.table(cols)


def _sharded(paths: DataFrame) -> DataFrame:
    """paths with a column shard. Paths with one prefix and first turn share a shard; if they have more turns than an even
    share, SHARD_TURNS at most, they are dealt to several by their own turns."""
    first = paths.withColumn("first", F.element_at("keys", 1))
    weight = first.groupBy("prefix", "first").agg(F.sum(F.size("keys")).alias("w"))
    total = paths.agg(F.sum(F.size("keys")).alias("w")).first()["w"] or 0
    n = max(4 * int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TURNS))
    most = min(SHARD_TURNS, max(LEAST_TURNS, total // n))
    large = weight.filter(F.col("w") > most).select("prefix", "first", F.ceil(F.col("w") / most).alias("parts"))
    salt = F.coalesce(F.pmod(F.xxhash64("own"), F.col("parts")), F.lit(0))
    return first.join(large, ["prefix", "first"], "left").withColumn("shard", F.pmod(F.xxhash64("prefix", "first", salt), F.lit(n)))


def _walked(paths: DataFrame) -> DataFrame:
    """The nodes of all paths (prefix, own, start, keys, chars, a, b, conv), merged over the shards."""
    each = _sharded(paths).select("shard", "prefix", "start", "keys", "chars", "a", "b", "conv").groupBy("shard").applyInArrow(shard_nodes, _NODES)
    least = lambda c: F.min(c).alias(c)
    return each.groupBy("node").agg(least("parent"), least("depth"), least("chars"), F.sum("a").alias("a"), F.sum("b").alias("b"), least("conv"))


def ends_sha256(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the digest of a node's conv_ids, ascending, with commas between. They
    are written out in ranges of (node, conv_id) first, END_IDS at a time, as one digest must be made in order."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        make = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "first": pa.array([held[0]], pa.int64()), "ids": [",".join(map(str, held))]})
        for b in batches:
            for own, conv in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()):
                if held and (own != node or len(held) >= END_IDS):
                    yield make()
                    held = []
                node = own
                held.append(conv)
        if held:
            yield make()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, now = None, None
        for b in batches:
            done = []
            for own, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if own != node:
                    done += [(node, now.hexdigest())] if now else []
                    node, now = own, hashlib.sha256(ids.encode())
                else:
                    now.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([now.hexdigest()])], ["node", "ends_sha256"])

    laid = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(written, "node binary, first long, ids string")
    return laid.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digested, "node binary, ends_sha256 string")


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the
    sequences rows (conv_id, pos, key, chars) of all conversations convs (conv_id); no conversations give no nodes.

    conv_id is the least member of a node and parent_conv_id that of its parent; n_convs counts members, n_leaves the
    childless nodes of its subtree, itself included; saved_tokens adds up (members - 1) * chars over its subtree."""
    cut, places = segments(rows)
    same = places.groupBy("prefix", "own").agg(F.count("*").alias("a"), F.min("conv_id").alias("conv"), F.first("seg").alias("seg"))
    keys = cut.withColumnRenamed("conv_id", "conv")
    paths = stored(same.join(keys, ["conv", "seg"]).select("prefix", "own", (F.col("seg") * SEGMENT).alias("start"), "keys", "chars", "a", F.lit(0).cast("long").alias("b"), "conv"))
    found = stored(_walked(paths).drop("b").withColumnRenamed("a", "n_convs"))
    kids = found.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = found.join(kids, "node", "left").withColumn("value", (F.col("n_convs") - 1) * F.col("chars")).withColumn("chunk", F.floor(F.col("depth") / SEGMENT))
    known = stored(known.withColumn("leaf", F.col("n_children").isNull().cast("long")).drop("chars"))

    chunks = known.groupBy("conv", "chunk").agg(F.sum("value").alias("v"))
    owner = Window.partitionBy("conv")
    chunks = chunks.select("conv", "chunk", (F.sum("v").over(owner.orderBy(F.desc("chunk"))) - F.col("v")).alias("later"), F.sum("v").over(owner).alias("all"))
    suffix = F.sum("value").over(Window.partitionBy("conv", "chunk").orderBy(F.desc("depth")))

    owned = stored(known.groupBy(F.col("conv").alias("conv_id")).agg(F.sum("value").alias("t"), F.sum("leaf").alias("l")))
    total = lambda c, to: F.coalesce(F.sum(c), F.lit(0)).alias(to)
    weights = places.join(owned, "conv_id", "left").groupBy("prefix", "own").agg(total("t", "a"), total("l", "b"))
    below = _walked(paths.drop("a", "b").join(weights, ["prefix", "own"])).select("node", F.col("a").alias("t"), F.col("b").alias("l"))

    root = F.lit(ROOT)
    last = places.groupBy("conv_id").agg(F.max_by("after", "seg").alias("node"))
    ends = ends_sha256(stored(convs.join(last, "conv_id", "left").select(F.coalesce("node", root).alias("node"), "conv_id")))
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv")).filter("n_convs > 0")  # one row
    sums = owned.agg(total("t", "saved_tokens"), total("l", "n_leaves")).withColumn("node", root)
    upper = top.withColumn("node", root).join(sums, "node", "left").join(kids, "node", "left")
    upper = upper.select("node", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")

    out = known.withColumn("suffix", suffix).join(chunks, ["conv", "chunk"]).join(below, "node")
    saved = F.col("t") - F.col("all") + F.col("suffix") + F.col("later")
    out = out.select("node", "parent", "depth", "n_convs", "conv", "n_children", F.col("l").alias("n_leaves"), saved.alias("saved_tokens")).unionByName(upper)
    parents = known.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    parents = parents.unionByName(top.select(root.alias("parent"), F.col("conv").alias("parent_conv_id")))
    return out.join(parents, "parent", "left").join(ends, "node", "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """nodes() of conversations (conv_id, turn, role, text) as they are. Repeated rows are repeated turns, long texts count
    by their digest, other columns are ignored."""
    rows = turns(conversations)
    return nodes(rows, rows.select("conv_id").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """nodes() of conversations after rebuild()."""
    return nodes(*rebuild(turns(conversations)))
