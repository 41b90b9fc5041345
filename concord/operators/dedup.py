"""First-wins de-duplication, in an explicit order column."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and the session
    runs on one machine (tests). A cluster without it is refused, as its machines do not share local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='concord-')}"


def shared_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_base(spark))


def first_by(df: DataFrame, key: Column, *order: str | Column, keep_blank: bool = True) -> DataFrame:
    """The first row of each key; rows with a null or empty key all stay if keep_blank."""
    blank = key.isNull() | (key == "") if keep_blank else F.lit(False)
    marked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(F.when(~blank, key), F.when(blank, F.struct(*order))).orderBy(*order)))
    return marked.filter(F.col("_rn") == 1).drop("_rn")


def dedup_url_then_title(df: DataFrame, url_key: Column, title_key: Column, seq: str = "seq", existing: DataFrame | None = None) -> DataFrame:
    """First by URL key, then the survivors first by title key; then without titles in existing (title_key)."""
    out = first_by(df, url_key, seq).withColumn("_t", title_key)
    out = first_by(out, F.col("_t"), seq)
    if existing is not None:
        out = out.join(existing.select(F.col("title_key").alias("_t")).distinct(), "_t", "left_anti")
    return out.drop("_t")


def with_dropped(df: DataFrame, kept: DataFrame, source: str, seq: str = "seq") -> DataFrame:
    """(source, dropped) counts of the rows of df that are not in kept."""
    return df.join(kept.select(seq), seq, "left_anti").groupBy(source).agg(F.count("*").alias("dropped"))


#: Undecided rows that dedup_greedy_or settles in one task, some 200 bytes each.
REST_ROWS = 200_000
#: What part of its rows a round may leave undecided; after one that leaves more, the next follows chains.
SLOW = 0.75


def dedup_greedy_or(df: DataFrame, url: str, title: str, seq: str = "seq") -> DataFrame:
    """A row goes if its URL or its title is that of an earlier row that stays; rows that went do not block others. Null and
    empty URLs and titles block nothing and are blocked by nothing. seq is unique.

    A key is named by its first row, so that rounds carry no texts, and keys of one row are left out; a row without others
    never enters a round. In a round over what is undecided, rows that are first by both keys stay and what they block goes,
    which leaves a small part unless rows wait for each other in long chains. After a round that leaves more than SLOW, the
    next one follows chains (see _decided): a row with one earlier row among those that share its keys stays if and only if
    that one goes; chains are followed by doubling, so that one of n rows takes about log n steps and all go side by side.
    As soon as REST_ROWS rows or fewer are undecided, one task settles them one after the other."""
    shared_folder(df.sparkSession)
    key = lambda c: F.when(F.col(c) != "", F.col(c))
    own = df.select(F.col(seq).alias("_s"), key(url).alias("_u"), key(title).alias("_t"))
    for c in ("_u", "_t"):
        named = own.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("_s").alias("_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        own = own.join(named, c, "left").select("_s", *[F.col("_id" if x == c else x).alias(x) for x in ("_u", "_t")])
    left = own.filter("_u is not null or _t is not null").checkpoint()
    first = {"_u": F.col("_u"), "_t": F.col("_t")}  # of the first round; its names are those of the first rows
    dropped, n, slow = left.select("_s").limit(0), left.count(), False
    while n > REST_ROWS:
        if slow:
            kept, settled = _decided(left)
            rest = left.join(kept.select("_s"), "_s", "left_anti").join(settled.withColumn("_settled", F.lit(True)), "_s", "left")
        else:
            rows = left
            for c in () if first else ("_u", "_t"):
                rows = rows.join(left.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("_s").alias(f"{c}1")), c, "left")
            stays = [F.coalesce(F.col("_s") == first.get(c, F.col(f"{c}1")), F.lit(True)) for c in ("_u", "_t")]
            rows = rows.select("_s", "_u", "_t", (stays[0] & stays[1]).alias("_stays"))
            rows = rows if first else rows.checkpoint()
            kept, rest = rows.filter("_stays"), rows.filter("not _stays").withColumn("_settled", F.lit(False))
        for c in ("_u", "_t"):  # a row that stays is the only one of its keys
            rest = rest.join(kept.filter(F.col(c).isNotNull()).select(c, F.lit(True).alias(f"{c}_taken")), c, "left")
        gone = [F.coalesce(c, F.lit(False)) for c in ("_settled", "_u_taken", "_t_taken")]
        judged = rest.select("_s", "_u", "_t", (gone[0] | gone[1] | gone[2]).alias("_gone")).checkpoint()
        dropped, left, first = dropped.union(judged.filter("_gone").select("_s")), judged.filter("not _gone").drop("_gone"), {}
        was, n = n, left.count()
        slow = n > SLOW * was
    if n:
        dropped = dropped.union(left.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(_one_after_the_other, left.select("_s").schema))
    return df.join(dropped.withColumnRenamed("_s", seq), seq, "left_anti")


def _one_after_the_other(rows: pa.Table) -> pa.Table:
    taken_u, taken_t, gone = set(), set(), []
    rows = rows.sort_by("_s")
    for i, (u, t) in enumerate(zip(rows["_u"].to_pylist(), rows["_t"].to_pylist())):
        if (u is not None and u in taken_u) or (t is not None and t in taken_t):
            gone.append(i)
        else:
            taken_u.add(u)
            taken_t.add(t)
    return rows.select(["_s"]).take(pa.array(gone, pa.int64()))


def _decided(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of undecided rows (_s, _u, _t) those that surely stay, and (_s) those that surely go."""
    rows = left
    for c in ("_u", "_t"):  # the first and the second row of every key, without sorting any key's rows
        first = left.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("_s").alias(f"{c}1"))
        second = left.join(first, c).filter(f"_s > {c}1").groupBy(c).agg(F.min("_s").alias(f"{c}2"))
        rows = rows.join(first, c, "left").join(second, c, "left")
    before = lambda c: F.when(F.col("_s") == F.col(f"{c}2"), F.col(f"{c}1"))
    early = lambda c: F.coalesce(F.col("_s") == F.col(f"{c}1"), F.lit(True))
    known = lambda c: early(c) | (F.col("_s") == F.col(f"{c}2"))
    a, b = before("_u"), before("_t")
    kind = F.when(early("_u") & early("_t"), "stays").when(known("_u") & known("_t") & (a.isNull() | b.isNull() | (a == b)), "follows")
    rows = rows.select("_s", "_u", "_t", kind.alias("kind"), F.coalesce(a, b).alias("to")).checkpoint()
    chain = rows.filter("kind = 'follows'").select("_s", "to", F.lit(1).alias("flips")).checkpoint()
    while True:
        on = chain.select(F.col("_s").alias("to"), F.col("to").alias("_far"), F.col("flips").alias("_more"))
        step = chain.join(on, "to", "left").select("_s", F.coalesce("_far", "to").alias("to"), ((F.col("flips") + F.coalesce("_more", F.lit(0))) % 2).alias("flips"), F.col("_far").isNotNull().alias("_moved")).checkpoint()
        chain = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            break
    sure = rows.filter("kind = 'stays'").select("_s")
    settled = chain.join(sure.withColumnRenamed("_s", "to"), "to", "left_semi")
    stays = sure.union(settled.filter("flips = 0").select("_s"))
    return rows.join(stays, "_s", "left_semi").select("_s", "_u", "_t"), settled.filter("flips = 1").select("_s")


def dedup_cross_source(df: DataFrame, platform_id: str, title_key: Column, seq: str = "seq") -> DataFrame:
    """First by the platform's id, then the survivors first by title, over all sources; rows without an id or a title are
    not compared by it. See with_dropped for the counts per source."""
    return first_by(first_by(df, F.col(platform_id), seq), title_key, seq)


def drop_processed(df: DataFrame, key: str, processed: DataFrame) -> DataFrame:
    """The rows whose key is not in processed (key); a null key was never processed."""
    return df.join(processed.select(key).distinct(), key, "left_anti")


#: Most tasks of in_blocks; beyond it a task takes several blocks.
MOST_TASKS = 8192


def _dealt(asked: DataFrame, rows: DataFrame, asked_rows: int, block_rows: int, on: tuple[str, ...] = (), kinds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks of about asked_rows and block_rows rows, each row beside every block (_a, _b) of the other
    side. Columns on that are joined too are dealt by as well: Spark would else deal anew, into as many parts as it has set
    for shuffles, however many blocks there are. They split a block into kinds parts, which are a task each."""
    n_asked = max(1, -(-asked.count() // asked_rows))
    n_rows = max(1, -(-rows.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    a = asked.withColumn("_a", part(asked, n_asked)).withColumn("_b", every(n_rows))
    b = rows.withColumn("_b", part(rows, n_rows)).withColumn("_a", every(n_asked))
    dealt = lambda df: df.repartition(min(n_asked * n_rows * kinds, MOST_TASKS), "_a", "_b", *on)
    return dealt(a), dealt(b)


def in_blocks(asked: DataFrame, rows: DataFrame, asked_rows: int = 2048, block_rows: int = 1 << 13, on: tuple[str, ...] = ()) -> DataFrame:
    """Every row of asked, a stated query set, beside every row of rows (with equal columns on, where given). Both sides are
    dealt into blocks of bounded size and joined by block numbers, so that no task holds more than a few blocks. Neither is
    broadcast, however small Spark takes it to be: its estimate does not see that each row goes to several blocks."""
    a, b = _dealt(asked, rows, asked_rows, block_rows, on)
    return b.join(a.hint("shuffle_hash"), ["_a", "_b", *on]).drop("_a", "_b")


def in_runs(asked: DataFrame, rows: DataFrame, on: tuple[str, ...], kinds: int, asked_rows: int, block_rows: int) -> DataFrame:
    """As in_blocks, where on has kinds values and a block about asked_rows and block_rows rows of each of them. A row of asked
    goes through all rows of its block before the next one does, so that the rows of a block are held, not those of asked.
    coalesce merges nothing here: it ends Spark's compiled stage, which would hold all that is made of a row of asked
    further on, too."""
    a, b = _dealt(asked, rows, asked_rows * kinds, block_rows * kinds, on, kinds)
    return a.join(b.hint("shuffle_hash"), ["_a", "_b", *on]).drop("_a", "_b").coalesce(MOST_TASKS)


def block_by_block(asked: DataFrame, rows: DataFrame, f: Callable, schema: str, asked_rows: int, block_rows: int) -> DataFrame:
    """f of each block of asked and each block of rows, two Arrow tables of bounded size; what f returns follows schema."""
    a, b = _dealt(asked, rows, asked_rows, block_rows)
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(f, schema)


def cap_round_robin(df: DataFrame, n: int, source: str, seq: str = "seq") -> DataFrame:
    """n rows, one of each source in turn, sources by first appearance, with their place; all rows in order if there are no more than n."""
    pos = F.row_number().over(Window.partitionBy(source).orderBy(seq))
    order = df.groupBy(source).agg(F.min(seq).alias("_first"))
    dealt = df.withColumn("_pos", pos).join(order, source).orderBy("_pos", "_first").limit(n)
    total = df.limit(n + 1).count()
    by = [F.col(seq)] if total <= n else [F.col("_pos"), F.col("_first")]
    return dealt.withColumn("place", F.row_number().over(Window.orderBy(*by))).drop("_pos", "_first")


def truncated(df: DataFrame, kept: DataFrame, source: str, seq: str = "seq") -> DataFrame:
    """(source, n): how many rows of each source a cap left out; sources that lost none are not listed."""
    return df.join(kept.select(seq), seq, "left_anti").groupBy(source).agg(F.count("*").alias("n"))
