"""BPE encoding and decoding through a table of distinct words (operator 12).

The tokenizer drops white space and none of its tokens spans a space or a line feed, so texts are split there and a word
has the same ids wherever it stands. A task splits its texts block by block (BLOCK_CHARS characters): a block keeps its
distinct words, dealt into buckets by a hash, and for each word of its texts the place of that word among them. The
distinct words of all blocks meet by bucket; there each distinct word is encoded once, and the ids go back to the blocks
that hold it, where they are joined to the texts by position. Decoding joins the distinct ids of a block with the table
of (id, piece), which has a row for each entry of the tokenizer's vocabulary, and puts the pieces in the places of the
ids, with a space between them, as a tokenizer without a decoder does.

Blocks are written once, as a table bucketed by block in the shared folder, and never shuffled: only their words, ids and
pieces travel. A word that every text holds travels once for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import shared_dir, slices
from concord.llm.wavelet import default_tokenizer, tokens_at

#: Characters of a block, up to one text more.
BLOCK_CHARS = 14_000_000
#: Distinct words whose ids a task remembers; beyond it the task starts anew and may encode a word once more.
TASK_WORDS = 2_000_000
#: Ids in a batch of results, up to one text more.
BATCH_IDS = 1 << 21
#: Largest vocabulary whose table of pieces is broadcast.
BROADCAST_PIECES = 1 << 20
_BLOCK = "block long, doc_ids array<long>, sizes array<int>, places binary, n long, words array<binary>, ids array<int>"


def _zstd(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _squeezed(places: np.ndarray) -> bytes:
    """Places below 2^32 as byte planes, of which the upper ones are nearly empty."""
    return _zstd(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _opened(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch], size, most: int) -> Iterator[tuple[int, list, pa.Array]]:
    """(block, doc_ids, second column) of about most, as size counts a batch."""
    task, k, held, got = TaskContext.get().partitionId(), 0, [], 0

    def close() -> tuple[int, list, pa.Array]:
        whole = pa.Table.from_batches(held).combine_chunks()
        return (task << 24) + k, whole.column(0).to_pylist(), pa.concat_arrays(whole.column(1).chunks)

    for b in batches:
        for some in slices(b, 1 << 16, 4 << 20) if pa.types.is_string(b.column(1).type) else [b]:
            held.append(some)
            got += size(some.column(1))
            if got >= most:
                yield close()
                k, held, got = k + 1, [], 0
    if held:
        yield close()


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """rows, written to the shared folder in n buckets by block: a later join by block reads them in place."""
    name, spark = f"concord_{uuid.uuid4().hex}", rows.sparkSession
    rows.write.bucketBy(n, "block").option("path", f"{shared_dir(spark)}/blocks-{name}").saveAsTable(name)
    return spark.table(name)


def _shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split(docs: DataFrame) -> DataFrame:
    """The blocks of docs (doc_id, text). words holds, for each bucket, its distinct words in order with spaces between, compressed;
    places are those of the texts' words in all buckets, one after the other, from 1; 0 is the empty word."""
    n = _shards(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, doc_ids, texts in _blocks(batches, lambda x: pc.sum(pc.utf8_length(x)).as_py() or 0, BLOCK_CHARS):
            parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
            code = parts.flatten().dictionary_encode()
            word = code.dictionary.to_pylist()
            bucket = np.array([xxhash.xxh32_intdigest(w) % n if w else -1 for w in word], np.int64)
            order = pc.sort_indices(code.dictionary).to_numpy()
            order = order[np.argsort(bucket[order], kind="stable")]
            first = int(len(word) > 0 and bucket[order[0]] < 0)  # whether the empty word is there
            place = np.empty(len(word), np.int64)
            place[order] = np.arange(len(word)) + 1 - first
            ends = np.searchsorted(bucket[order], np.arange(-1, n), side="right").tolist()
            words = [_zstd(" ".join(word[i] for i in order[a:b]).encode()) if b > a else None for a, b in zip(ends, ends[1:])]
            places, sizes = place[code.indices.to_numpy()], pc.list_value_length(parts).to_pylist()
            yield _row(block, doc_ids, sizes, places, words, [])
            del texts, parts, code, word, words, places
            pa.default_memory_pool().release_unused()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _bucketed(docs.mapInArrow(cut, _BLOCK), n)


def _row(block: int, doc_ids: list, sizes: list, places: np.ndarray, words: list, ids: list) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "places": pa.binary(), "n": pa.int64(), "words": pa.list_(pa.binary()), "ids": pa.list_(pa.int32())}
    row = {"block": [block], "doc_ids": [doc_ids], "sizes": [sizes], "places": [_squeezed(places)], "n": [len(places)], "words": [words], "ids": [ids]}
    return pa.RecordBatch.from_pydict(row, schema=pa.schema(list(kinds.items())))


def word_ids(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """(block, bucket, ids, sizes): the ids of a block's distinct words, each encoded once in the task of its bucket."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = tokens_at(tokenizer), {}
        for b in batches:
            for block, bucket, line in zip(*(c.to_pylist() for c in b.columns)):
                words = zstandard.ZstdDecompressor().decompress(line).decode().split(" ")
                new = set(words).difference(known)
                if len(known) + len(new) > TASK_WORDS:
                    known, new = {}, set(words)
                known.update(tokens._encoded(new))
                got = [known[w] for w in words]
                ids = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
                sizes = np.fromiter(map(len, got), np.int32, len(got)) // 4
                cols = [pa.array([block]), pa.array([bucket], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (ids, sizes))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "bucket", "ids", "sizes"])

    n = _shards(blocks.sparkSession)
    rows = blocks.select("block", F.posexplode("words").alias("bucket", "words")).filter("words IS NOT NULL")
    return rows.repartition(n, "bucket").mapInArrow(encoded, "block long, bucket int, ids array<int>, sizes array<int>")


def pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece) of the tokenizer's whole vocabulary, special tokens included."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        for b in batches:
            vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True) if b.num_rows else {}
            yield pa.RecordBatch.from_pydict({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(vocabulary.keys(), pa.string())})

    rows = spark.range(1, numPartitions=1).mapInArrow(listed, "id int, piece string")
    from tokenizers import Tokenizer

    return F.broadcast(rows) if Tokenizer.from_file(tokenizer).get_vocab_size() <= BROADCAST_PIECES else rows


def _pieces_of(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(block, pieces): the pieces of a block's distinct ids, of rows (block, ids); a block has no more of them than the
    vocabulary has entries. Ids without a piece are left out."""
    each = ids.select("block", F.explode(F.array_distinct("ids")).alias("id")).join(pieces(ids.sparkSession, tokenizer), "id")
    return each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "piece"))).alias("pieces"))


def _texts(ids: np.ndarray, offsets: np.ndarray, own: pa.StructArray) -> pa.Array:
    """The texts of ids that offsets part, from the pieces (id, piece) of the block."""
    known, piece = own.field(0).to_numpy(zero_copy_only=False), own.field(1)
    at = np.searchsorted(known, ids)
    held = known[np.minimum(at, len(known) - 1)] == ids if len(known) else np.zeros(len(ids), bool)
    before = np.concatenate([[0], np.cumsum(held)])
    lists = pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), piece.take(pa.array(at[held])))
    return pc.binary_join(lists, " ")


def _joined(blocks: DataFrame, words: DataFrame | None, own: DataFrame | None, ids_of_words: bool, packed: bool = False) -> DataFrame:
    """Blocks with what came back for them, turned into (doc_id, ids, decoded); decoded is null without own."""
    rows = blocks.select("block", "doc_ids", "sizes", "places", "n", "ids")
    rows = rows.join(words, "block", "left") if ids_of_words else rows.withColumn("w", F.lit(None).cast("array<struct<bucket:int,ids:array<int>,sizes:array<int>>>"))
    rows = rows.join(own, "block", "left") if own is not None else rows.withColumn("pieces", F.lit(None).cast("array<struct<id:int,piece:string>>"))

    decode = own is not None

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _put({x: b.column(x)[i] for x in b.schema.names}, ids_of_words, decode, packed, BATCH_IDS)
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(put, f"doc_id long, ids {'binary' if packed else 'array<int>'}, decoded string")


def _put(row: dict, ids_of_words: bool, decode: bool, packed: bool, most: int) -> Iterator[pa.RecordBatch]:
    doc_ids, places = row["doc_ids"].values, _opened(row["places"].as_py(), row["n"].as_py())
    ends = np.cumsum(np.concatenate([[0], row["sizes"].values.to_numpy()]))
    if ids_of_words:
        back = row["w"].values
        parts = [back.field(k).flatten().to_numpy() for k in (1, 2)] if back is not None else [np.zeros(0, np.int32)] * 2
        of, sizes = parts[0], np.concatenate([[0], parts[1]])
    else:
        of, sizes = row["ids"].values.to_numpy(), np.ones(len(row["ids"].values) + 1, np.int64)
        sizes[0] = 0
    starts = np.cumsum(sizes) - sizes
    own = row["pieces"].values if decode else None
    own = pa.array([], pa.struct([("id", pa.int32()), ("piece", pa.string())])) if own is None else own
    n_ids = np.concatenate([[0], np.cumsum(sizes[places])])[ends]
    a = 0
    while a < len(doc_ids):
        b = max(a + 1, int(np.searchsorted(n_ids, n_ids[a] + most, side="right")) - 1)
        some = places[ends[a] : ends[b]]
        lens = sizes[some]
        to = np.cumsum(lens)
        ids = of[np.repeat(starts[some] - to + lens, lens) + np.arange(to[-1] if len(to) else 0)]
        offsets = n_ids[a : b + 1] - n_ids[a]
        texts = _texts(ids, offsets, own) if decode else pa.nulls(b - a, pa.string())
        if packed:
            places_of = [pa.py_buffer(x.astype("<i4")) for x in (4 * offsets, ids)]
            out = pa.Array.from_buffers(pa.binary(), b - a, [None, *places_of])
        else:
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([doc_ids[a:b], out, texts], ["doc_id", "ids", "decoded"])
        a = b


def _gathered(words: DataFrame) -> DataFrame:
    return words.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids", "sizes"))).alias("w"))


def encode(docs: DataFrame, tokenizer: str | None = None, packed: bool = False) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): the ids of whole texts, as the tokenizers library gives them without special
    tokens added. Null texts count as empty and have no ids. Rows stay rows: repeated and null doc_ids keep one result
    each. Other columns are ignored, whatever their names; no rows give no rows. A text is held whole by one task. ids is an
    array<int>, or packed: one binary of little-endian unsigned 32-bit integers."""
    blocks = split(docs)
    return _joined(blocks, _gathered(word_ids(blocks, tokenizer or default_tokenizer())), None, True, packed).drop("decoded")


def decode(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids array<int>), special tokens kept. Null ids count as none, ids that the
    vocabulary lacks (null ones too) are skipped, as the library does. Rows stay rows, as with encode."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, doc_ids, ids in _blocks(batches, lambda x: len(x.flatten()), BLOCK_CHARS):
            ids = pc.fill_null(ids, [])
            code = pc.fill_null(ids.flatten(), -1).dictionary_encode()
            yield _row(block, doc_ids, pc.list_value_length(ids).to_pylist(), code.indices.to_numpy() + 1, [], code.dictionary.to_pylist())

    path = tokenizer or default_tokenizer()
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    blocks = _bucketed(rows.mapInArrow(cut, _BLOCK), _shards(tokens.sparkSession))
    return _joined(blocks, None, _pieces_of(blocks, path), False).select("doc_id", F.col("decoded").alias("text"))


def round_trip(docs: DataFrame, tokenizer: str | None = None, packed: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) of docs (doc_id, text): encode, and decode from those ids, over the same blocks."""
    path = tokenizer or default_tokenizer()
    blocks = split(docs)
    words = _gathered(word_ids(blocks, path))
    return _joined(blocks, words, _pieces_of(words.select("block", F.flatten("w.ids").alias("ids")), path), True, packed)
