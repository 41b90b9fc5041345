"""Helpers shared by the operators: tables, the shared folder, words, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; bytes.split() without an argument cuts at exactly these bytes.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = found or f"file://{tempfile.mkdtemp(prefix='concord-')}"
        context.setCheckpointDir(found)
    if not found:
        found = context._jsc.sc().getCheckpointDir().get().rsplit("/", 1)[0]
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: later jobs do not recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def encode(text: str) -> bytes:
    """UTF-8; a lone surrogate, which no well-formed column holds, becomes '?'."""
    return text.encode("utf-8", "replace")


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about size bytes, cut at spaces only, so that a very long text never becomes one word list."""
    at, n = 0, len(data)
    while n - at > size:
        near = [x for x in (data.find(b" ", at + size), data.find(b"\n", at + size)) if x >= 0]
        end = min(near) if near else n
        yield data[at:end]
        at = end
    yield data[at:]


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like wanted that no name of taken equals, upper or lower case."""
    used = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """batch in parts of up to rows rows and about size bytes of a text column; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it: as cut(), but small on disk."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have both collectors look for plans that nothing refers to any more: Spark deletes shuffle files only then, and
    otherwise those of finished steps stay on disk beside those of the next one."""
    gc.collect()
    spark._jvm.System.gc()


#: Most bits of a key filter, 16 MB.
FILTER_BITS = 1 << 27


def _filter_bits(key: np.ndarray, size: int) -> list[np.ndarray]:
    k = key.view(np.uint64)
    return [(k >> np.uint64(s)) & np.uint64(size - 1) for s in (0, 29)]


def key_filter(keys: DataFrame, n: int) -> Broadcast:
    """A Bloom filter of keys (key long, n rows) of 16 bits a key and FILTER_BITS at most. It only spares work: what it
    lets through is checked exactly, so that a full one costs time and nothing else."""
    size = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length() - 1))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.unique(np.concatenate(_filter_bits(b.column("key").to_numpy(), size)))
            word, start = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.uint64(1) << (places & np.uint64(63))
            value = np.bitwise_or.reduceat(bits, start) if len(word) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    got = keys.select("key").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    mask = np.zeros(max(1, size // 64), np.uint64)  # FILTER_BITS / 64 rows at most
    mask[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast((mask, size))


def may_hold(held: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    mask, size = held
    a, b = (mask[p >> np.uint64(6)] >> (p & np.uint64(63)) for p in _filter_bits(keys, size))
    return a & b & np.uint64(1) == 1


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v) with u > v. The minima are written first, so that the join below has an
    exchange on both sides and adaptive execution can split a hub's partition."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternates large-star and small-star until nothing changes. Every step is a grouped minimum and a join, each
    result goes to the shared checkpoint folder, and only a count and a checksum reach the driver. Self-links are
    dropped; no edges give no rows."""
    now = cut(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    was = _checksum(now)
    while was[0]:
        now = cut(_star(cut(_star(now, True)), False))
        got = _checksum(now)
        if got == was:
            break
        was = got
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
