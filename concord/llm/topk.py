"""Exact top-k search with block-at-a-time pruning (operator 5).

1. Vectors become integer vectors, floor(256 x) of each component. A stored row number, not vec_id, names a row.
2. PIVOTS rows are drawn by a hash; every row is ordered by its nearest and its second nearest pivot, so that neighbours
   are alike, and dealt into groups of about GROUP_ROWS rows by ranges of that order. A group holds blocks of BLOCK_ROWS
   rows. A block is one forward index: ids, an integer matrix, and the largest and smallest value of every dimension
   (the term maxima of positive and of negative query weights).
3. The bound of a block for a query is the sum of its term maxima times the query's weights. Each query visits blocks
   by its own falling bounds and stops at the first that falls below its kth score. Ties are visited, as a smaller id
   may win. The visits of all queries of a task to one block are one matrix product.
4. Every query searches the group that it lies in first, which gives it a kth score. Term maxima of the groups (of
   MOST_BOUNDS ranges of groups at most) are then broadcast, and a query travels to those groups alone whose bound
   reaches that score. A task holds one group and one bucket of about QUERY_ROWS queries.
5. Each query's candidates, k at most from each group, are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import cut

SCALE = 256
BLOCK_ROWS = 128
GROUP_ROWS = 8192
QUERY_ROWS = 8192
#: Rows that the order of rows is made by. The result does not depend on it.
PIVOTS = 256
#: Ranges of groups whose term maxima are broadcast.
MOST_BOUNDS = 1024
#: Float64 sums of integer products are exact below this bound; larger ones are made with Python integers.
EXACT = 2**53
_LONG = 2**63 - 1


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the rows that take part: vec_id and vector not null, every
    component finite. An empty vector takes part and scores 0."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * SCALE).cast("double"))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))
    ).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list column, filled up with zeros to one width."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width if width is not None else int(sizes.max(initial=0))))
    if len(sizes) and (sizes == out.shape[1]).all():
        return values[offsets[0] : offsets[-1]].reshape(out.shape).copy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[row, col] = values[offsets[0] : offsets[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: rows of a by rows of b."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(w, 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    exact = whole(a).dot(whole(b).T).reshape(len(a), len(b)) if w else np.zeros((len(a), len(b)), object)
    return np.array([[max(-_LONG, min(_LONG, x)) for x in r] for r in exact], np.int64).reshape(exact.shape)


class Block:
    """Ids, row numbers, integer matrix, and term maxima and minima of a document range."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray):
        self.ids, self.rows, self.matrix = ids, rows, matrix
        self.most, self.least = matrix.max(axis=0), matrix.min(axis=0)


class Bound:
    """Term maxima and minima alone, of a range of groups."""

    def __init__(self, most: np.ndarray, least: np.ndarray):
        self.most, self.least = most, least


def bounds(queries: np.ndarray, found: list[Block] | list[Bound]) -> np.ndarray:
    """No score of query i in block j is above [i, j]. Rounded up where float64 sums may not be exact."""
    width = max([queries.shape[1], *(len(b.most) for b in found)])
    fill = lambda x: np.pad(x, (0, width - len(x)))
    most, least = np.stack([fill(b.most) for b in found]), np.stack([fill(b.least) for b in found])
    q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = up @ most.T + down @ least.T
    slack = (up @ np.abs(most).T - down @ np.abs(least).T) * 1e-12
    return bound + np.where(np.abs(slack) * 1e12 < EXACT, 0, slack)


class Best:
    """The k best rows of each query so far. floor is a score that k rows of another group reach, or None."""

    def __init__(self, matrix: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int):
        n = len(rows)
        self.matrix, self.own, self.floor, self.k = matrix, rows, floor, k
        self.score = np.full((n, k), -_LONG - 1, np.int64)
        self.ids, self.rows = np.zeros((n, k), np.int64), np.full((n, k), -1, np.int64)
        self.visited = 0

    def least(self, at: np.ndarray) -> np.ndarray:
        """What a row must reach to matter to queries at; the lowest number where anything does."""
        return np.maximum(np.where(self.rows[at, -1] < 0, -_LONG - 1, self.score[at, -1]), self.floor[at])

    def visit(self, need: np.ndarray, b: Block) -> None:
        got = products(self.matrix[need], b.matrix)
        reach = (got >= self.least(need)[:, None]).any(axis=1)
        need, got = need[reach], got[reach]
        own = self.own[need][:, None] == b.rows[None, :]
        score = np.concatenate([self.score[need], got], axis=1)
        ids = np.concatenate([self.ids[need], np.broadcast_to(b.ids, got.shape)], axis=1)
        rows = np.concatenate([self.rows[need], np.where(own, -1, b.rows[None, :])], axis=1)
        order = np.lexsort((rows, ids, -np.maximum(score, -_LONG), rows < 0), axis=1)[:, : self.k]
        self.score[need], self.ids[need], self.rows[need] = (np.take_along_axis(x, order, axis=1) for x in (score, ids, rows))

    def search(self, blocks: list[Block]) -> None:
        """Visit blocks, each query in its own order, until its next bound is too low."""
        if not blocks or not len(self.own):
            return
        bound = bounds(self.matrix, blocks)
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(self.own))
        for step in range(len(blocks)):
            to = order[live, step]
            go = bound[live, to] >= self.least(live)
            live, to = live[go], to[go]  # bounds only fall from here on: the others are done
            if not len(live):
                break
            self.visited += len(live)
            for j in np.unique(to):
                self.visit(live[to == j], blocks[j])


def blocks_of(group: pa.Table) -> list[Block]:
    """The blocks of a group's rows (row, vec_id, v, near, second)."""
    row, near, second = (group.column(c).to_numpy() for c in ("row", "near", "second"))
    laid = group.select(["row", "vec_id", "v"]).take(pa.array(np.lexsort((row, second, near)))).combine_chunks()
    out = []
    for batch in laid.to_batches(max_chunksize=BLOCK_ROWS):
        out.append(Block(batch.column("vec_id").to_numpy(), batch.column("row").to_numpy(), _matrix(batch.column("v"))))
    return out


_FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def _results(best: Best, ids: np.ndarray) -> pa.Table:
    i, c = np.nonzero((best.rows >= 0) & (best.score >= best.floor[:, None]))
    cols = (best.own[i], ids[i], best.ids[i, c], best.rows[i, c], best.score[i, c])
    return pa.table({n.split()[0]: pa.array(x, pa.int64()) for n, x in zip(_FOUND.split(", "), cols)})


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)


def laid_out(stored: DataFrame) -> DataFrame:
    """stored (row, vec_id, v, ...) with near and second, the pivots of a row, and g, its group."""
    groups = max(1, -(-stored.count() // GROUP_ROWS))
    drawn = stored.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).select("v").toArrow()
    pivots = _vectors(drawn) if drawn.num_rows else np.zeros((1, 0))
    held = stored.sparkSession.sparkContext.broadcast(pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                m, p = _matrix(batch.column("v")), held.value
                w = min(m.shape[1], p.shape[1])
                with np.errstate(over="ignore", invalid="ignore"):
                    alike = np.nan_to_num(m[:, :w] @ p[:, :w].T)
                near = alike.argmax(axis=1)
                alike[np.arange(len(near)), near] = -np.inf
                cols = [pa.array(near.astype(np.int32)), pa.array(alike.argmax(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "near", "second"])

    schema = T.StructType([*stored.schema.fields, T.StructField("near", T.IntegerType()), T.StructField("second", T.IntegerType())])
    ranged = stored.mapInArrow(placed, schema).repartitionByRange(groups, "near", "second", "row")
    return cut(ranged.withColumn("g", F.spark_partition_id()))


def group_bounds(laid: DataFrame) -> tuple[list[Bound], np.ndarray, int]:
    """Term maxima of the rows of each pivot in each range of groups; the range of each; and how many groups a range has.
    As rows are in the order of their pivots there are MOST_BOUNDS + PIVOTS of them at most."""
    groups = (laid.agg(F.max("g")).first()[0] or 0) + 1
    per = -(-groups // MOST_BOUNDS)

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = (batch.column("g").to_numpy() // per).astype(np.int64) << 32 | batch.column("near").to_numpy()
            for one in np.unique(part):
                m = _matrix(batch.column("v").filter(pa.array(part == one)))
                n = m.shape[1] + 1
                most, least = (np.append(f(axis=0), 0.0) for f in (m.max, m.min))
                cols = [np.full(n, one), np.append(np.arange(n - 1), -1).astype(np.int32), most, least]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["part", "dim", "most", "least"])

    rows = laid.select("g", "near", "v").mapInArrow(maxima, "part long, dim int, most double, least double")
    got = rows.groupBy("part", "dim").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.count("*").alias("n")).toArrow()
    part, dim, most, least, n = (got.column(c).to_numpy() for c in ("part", "dim", "most", "least", "n"))
    parts, s = np.unique(part, return_inverse=True)
    width, own = int(dim.max(initial=-1)) + 1, dim >= 0
    whole = np.zeros(len(parts), np.int64)
    whole[s[~own]] = n[~own]
    up, down, seen = np.zeros((len(parts), width)), np.zeros((len(parts), width)), np.zeros((len(parts), width), np.int64)
    up[s[own], dim[own]], down[s[own], dim[own]], seen[s[own], dim[own]] = most[own], least[own], n[own]
    short = seen < whole[:, None]  # some rows end before this dimension, as if filled up with zeros
    up, down = np.where(short, np.maximum(up, 0), up), np.where(short, np.minimum(down, 0), down)
    return [Bound(x, y) for x, y in zip(up, down)], (parts >> 32).astype(np.int32), per


def own_group(laid: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query's own group; laid has asked, whether a row is a query."""

    def search(group: pa.Table) -> pa.Table:
        asked = group.filter(group.column("asked"))
        rows, ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        best = Best(_vectors(asked), rows, np.full(len(rows), -_LONG - 1, np.int64), k)
        if len(rows):
            best.search(blocks_of(group))
        return _results(best, ids)

    return laid.groupBy("g").applyInArrow(search, _FOUND)


def other_groups(laid: DataFrame, first: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups and the queries that go to them, by (to_g, to_q) and (g, q): a group and a bucket of queries. A query goes to the
    groups whose bound reaches the kth score that it has from first."""
    found, range_of, per = group_bounds(laid)
    groups = laid.agg(F.max("g")).first()[0] or 0
    held = laid.sparkSession.sparkContext.broadcast(found)  # MOST_BOUNDS + PIVOTS pairs of vectors at most
    floor = first.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = laid.filter("asked").join(floor.withColumnRenamed("query_row", "row"), "row", "left")

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                floor = batch.column("floor").fill_null(-_LONG - 1).to_numpy()
                reach = bounds(_matrix(batch.column("v")), held.value) >= floor[:, None]
                lists = pa.array([np.unique(range_of[r]) for r in reach], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "v", "g")), pa.array(floor), lists], ["row", "vec_id", "v", "own", "floor", "to"])

    buckets = max(1, -(-asked.count() // QUERY_ROWS))
    sent = asked.select("row", "vec_id", "v", "g", "floor").mapInArrow(aimed, "row long, vec_id long, v array<double>, own int, floor long, to array<int>")
    sent = sent.withColumn("s", F.explode("to"))
    sent = sent.withColumn("g", F.explode(F.sequence(F.col("s") * per, F.least(F.col("s") * per + per - 1, F.lit(groups))))).filter("g <> own")
    sent = cut(sent.select("row", "vec_id", "v", "floor", "g", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("q")))
    pairs = sent.select(F.col("g").alias("to_g"), F.col("q").alias("to_q")).distinct()
    rows = laid.join(pairs, F.col("g") == F.col("to_g")).select("to_g", "to_q", "row", "vec_id", "v", "near", "second")
    return rows, sent


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank int, vec_id, score long): the k highest integer inner products of each row for which the
    condition is_query holds, against every other row. Ties go to the smaller vec_id.

    Rows with a null vec_id or vector, or with a null or non-finite component, take no part. Vectors of different
    lengths are compared as if filled up with zeros. Rows that share a vec_id are rows of their own: each is a query,
    and a candidate for the others. Scores beyond the range of long are cut to it. Fewer than k other rows: all of them.
    Other columns are ignored."""
    stored = integer_vectors(vectors).withColumns({"row": F.monotonically_increasing_id(), "asked": F.coalesce(is_query, F.lit(False))})
    laid = laid_out(cut(stored))
    first = cut(own_group(laid, k))
    rows, asked = other_groups(laid, first, k)

    def search(group: pa.Table, queries: pa.Table) -> pa.Table:
        best = Best(_vectors(queries), queries.column("row").to_numpy(), queries.column("floor").to_numpy(), k)
        if group.num_rows:
            best.search(blocks_of(group))
        return _results(best, queries.column("vec_id").to_numpy())

    rest = rows.groupBy("to_g", "to_q").cogroup(asked.groupBy("g", "q")).applyInArrow(search, _FOUND)
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
