"""Matching of names: edit similarity, containment, shared characters, and identity cascades."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import text as X
from concord.operators import dedup as D


#: Characters of the substrings by which keys are indexed for containment.
Q = 3


def _substrings(c: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _segment(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th of parts even segments of n characters, the longer ones last."""
    size, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    extra = F.greatest(F.lit(0), i - (parts - longer))
    return 1 + (i - 1) * size + F.greatest(F.lit(0), extra - 1), size + (extra > 0).cast("int")


def near_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (lk, rk) of different keys of left (lk) and right (rk) that are at least so similar.

    A segment index: two keys of which the longer has L characters may differ in d = (1 - least) * L edits, so of d + 1
    even segments of the right key one stands unchanged in the left key, and not far from its place. The right keys are
    indexed by (length, d, segment number, segment), for each d that a left key's length can give; the number of segments
    follows the lengths, so short keys have few long segments rather than many short ones. A left key asks with its own
    substrings at the places that a segment can have moved to: at most i - 1 edits lie before the i-th segment and d + 1 - i
    behind it. Keys with fewer characters than segments (least of 0.5 or less) are joined by their lengths."""
    edits = lambda n: F.floor(n * F.lit(1 - least) + 1e-9).cast("int")
    upto = lambda n: F.sequence(F.lit(1), n)
    rn, ln = F.length("rk"), F.length("lk")

    def own(d: Column) -> Column:
        parts = d + 1

        def segment(i: Column) -> Column:
            start, size = _segment(rn, parts, i)
            return F.struct(d.alias("d"), i.alias("i"), F.substring(F.col("rk"), start, size).alias("s"))

        return F.when(rn > d, F.transform(upto(parts), segment)).otherwise(F.array(F.struct(d.alias("d"), F.lit(0).alias("i"), F.lit("").alias("s"))))

    most = edits(F.floor(rn / F.lit(least)).cast("int"))
    index = right.select("rk", rn.alias("n"), F.inline(F.flatten(F.transform(F.sequence(edits(rn), most), own))))

    def asked(n: Column) -> Column:
        d = edits(F.greatest(n, ln))
        parts, shift = d + 1, ln - n

        def probes(i: Column) -> Column:
            start, size = _segment(n, parts, i)
            low = F.greatest(F.lit(1), start - (i - 1), start + shift - (parts - i))
            high = F.least(ln - size + 1, start + (i - 1), start + shift + (parts - i))
            cut = lambda at: F.struct(n.alias("n"), d.alias("d"), i.alias("i"), F.substring(F.col("lk"), at, size).alias("s"))
            return F.when(low <= high, F.transform(F.sequence(low, high), cut)).otherwise(F.filter(F.array(cut(F.lit(1))), lambda x: F.lit(False)))

        alone = F.array(F.struct(n.alias("n"), d.alias("d"), F.lit(0).alias("i"), F.lit("").alias("s")))
        return F.when(n > d, F.flatten(F.transform(upto(parts), probes))).otherwise(alone)

    probe = left.select("lk", F.inline(F.array_distinct(F.flatten(F.transform(_band(ln, least), asked)))))
    pairs = probe.join(index, ["n", "d", "i", "s"]).select("lk", "rk").filter("lk <> rk").distinct()
    return pairs.filter(similarity(F.col("lk"), F.col("rk")) >= least)


def fuzzy_match(left: DataFrame, right: DataFrame, key: str, least: float = 0.85, mode: str = "best") -> DataFrame:
    """(l_seq, r_seq, score): the best right row of each left row (mode best; ties to the smaller seq), or the first (mode
    first), among those at least so similar. Distinct keys are compared, not rows: equal ones by an equality join, others
    by near_pairs(). Empty keys match nothing."""
    lk = left.select(F.col(key).alias("lk")).distinct().filter("lk <> ''")
    rk = right.select(F.col(key).alias("rk")).distinct().filter("rk <> ''")
    equal = lk.join(rk, F.col("lk") == F.col("rk")).select("lk", "rk")
    scored = near_pairs(lk, rk, least).unionByName(equal).withColumn("score", similarity(F.col("lk"), F.col("rk")))
    firsts = right.groupBy(F.col(key).alias("rk")).agg(F.min("seq").alias("r_seq"))
    by_key = scored.join(firsts, "rk")
    order = [F.desc("score"), F.col("r_seq")] if mode == "best" else [F.col("r_seq")]
    best = by_key.withColumn("n", F.row_number().over(Window.partitionBy("lk").orderBy(*order))).filter("n = 1")
    return left.select(F.col("seq").alias("l_seq"), F.col(key).alias("lk")).join(best, "lk").select("l_seq", "r_seq", "score")


def _band(n: Column, least: float) -> Column:
    """The lengths that a key at least so similar can have."""
    return F.sequence(F.ceil(n * F.lit(least) - 1e-9).cast("int"), F.floor(n / F.lit(least) + 1e-9).cast("int"))


def containing_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (k, rk) of distinct keys, of left (k) and right (rk), of which one holds the other. Empty keys hold nothing and
    are held by nothing.

    A key is indexed once, under that of its substrings of Q characters which the fewest keys of the other side have; a
    key that has one no other side's key has is held by none. The other side asks with its substrings, and each candidate
    is compared once. Keys of fewer than Q characters are looked up as they are, among substrings of their length."""
    l, r = left.select("k").filter("k <> ''").distinct(), right.select("rk").filter("rk <> ''").distinct()

    def held(inner: DataFrame, outer: DataFrame, i: str, o: str) -> DataFrame:
        asked = outer.select(o, F.explode(_substrings(F.col(o), Q)).alias("g"))
        counts = asked.groupBy("g").agg(F.count("*").alias("f"))
        own = inner.filter(F.length(i) >= Q).select(i, F.explode(_substrings(F.col(i), Q)).alias("g"), F.size(_substrings(F.col(i), Q)).alias("n"))
        rarest = own.join(counts, "g").groupBy(i).agg(F.min_by("g", F.struct("f", "g")).alias("g"), F.count("*").alias("known"), F.first("n").alias("n"))
        found = asked.join(rarest.filter("known = n").select(i, "g"), "g").filter(F.col(o).contains(F.col(i))).select("k", "rk")
        short = inner.filter(F.length(i) < Q)
        few = outer.select(o, F.explode(F.flatten(F.array(*[_substrings(F.col(o), n) for n in range(1, Q)]))).alias(i))
        return found.union(few.join(short, i).select("k", "rk"))

    return held(l, r, "k", "rk").union(held(r, l, "rk", "k")).distinct()


def exact_then_contains(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(l_seq, r_seq, how): by equal key, else the first right row whose key holds the left key or is held by it."""
    l, r = left.select(F.col("seq").alias("l_seq"), F.col(key).alias("k")), right.groupBy(F.col(key).alias("k")).agg(F.min("seq").alias("r_seq"))
    exact = l.join(r, "k").withColumn("how", F.lit("exact"))
    rest = l.join(r, "k", "left_anti")
    rk = r.withColumnRenamed("k", "rk")
    first = containing_pairs(rest, rk).join(rk, "rk").groupBy("k").agg(F.min("r_seq").alias("r_seq")).withColumn("how", F.lit("contains"))
    return exact.select("l_seq", "r_seq", "how").unionByName(rest.join(first, "k").select("l_seq", "r_seq", "how"))


def propagate_urls(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(seq, value): for each left row the value of the last right row, by seq, whose key holds its own or is held by it."""
    l, r = left.select("seq", F.col(key).alias("k")), right.groupBy(F.col(key).alias("rk")).agg(F.max(F.struct("seq", value)).alias("last"))
    best = containing_pairs(l, r).join(r, "rk").groupBy("k").agg(F.max("last").alias("last"))
    return l.join(best, "k").select("seq", F.col("last")[value].alias(value))


def match_names_to_hosts(names: DataFrame, urls: DataFrame) -> DataFrame:
    """(seq, url_seq, url): for each name (seq, name) the first URL (seq, url) whose host, without www., holds the name or is
    held by it, both in lower-case ASCII letters and digits. Names or hosts without any match nothing."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    host = F.regexp_replace(F.regexp_extract("url", r"^(?:https?://)?([^/]*)", 1), r"^www\.", "")
    n, u = names.select("seq", plain("name").alias("k")), urls.select(F.col("seq").alias("url_seq"), "url", plain(host).alias("rk"))
    first = u.groupBy("rk").agg(F.min(F.struct("url_seq", "url")).alias("u"))
    best = containing_pairs(n, first).join(first, "rk").groupBy("k").agg(F.min("u").alias("u"))
    return n.join(best, "k").select("seq", "u.*")


def sharing_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (k, rk) of distinct keys of left (k) and right (rk) whose sets of characters overlap by least or more: shared
    characters over the larger number of characters.

    A set join: characters are ordered by rarity over both sides. Of n characters of a key at most n - least * n are not
    shared, so one of its rarest n - ceil(least * n) + 1 is among as many of the other key's; only those are joined, for
    sets whose sizes allow it, and the overlap is taken once for each candidate."""
    size = lambda c: F.size(F.array_distinct(F.split(c, "")))
    chars = lambda df, c: df.select(c, size(F.col(c)).alias(f"{c}_n"), F.explode(F.array_distinct(F.split(F.col(c), ""))).alias("g"))
    l, r = left.select("k").filter("k <> ''").distinct(), right.select("rk").filter("rk <> ''").distinct()
    rare = chars(l, "k").select("g").union(chars(r, "rk").select("g")).groupBy("g").agg(F.count("*").alias("f"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(c).orderBy("f", "g"))
        n = F.col(f"{c}_n")
        return chars(df, c).join(rare, "g").withColumn("i", place).filter(F.col("i") <= n - F.ceil(n * F.lit(least) - 1e-9) + 1).select(c, f"{c}_n", "g")

    fits = F.least("k_n", "rk_n") >= F.greatest("k_n", "rk_n") * F.lit(least) - 1e-9
    both = rarest(l, "k").join(rarest(r, "rk"), "g").filter(fits).select("k", "rk").distinct()
    return both.filter(charset_overlap(F.col("k"), F.col("rk")) >= least - 1e-9)


def _sets(keys: list[str], places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each key its characters as a row of 0 and 1, those of places only, and the number of all its distinct ones."""
    rows = np.zeros((len(keys), max(1, len(places))), dtype=np.float32)
    for i, key in enumerate(keys):
        rows[i, [places[c] for c in set(key) if c in places]] = 1
    return rows, np.array([len(set(key)) for key in keys], dtype=np.float32)


#: Left and right keys of a block of best_titles, and left keys taken at once.
TITLES, OFFERED, STRIP = 2048, 8192, 256


def _best_of_block(least: float) -> Callable:
    """For each left key of a block the right key that fits best: characters are counted by products of 0 and 1, and texts
    are compared where one set of characters holds the other, as it must where one text does."""

    def fit(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("r_seq")  # so that the first of equals is the smallest
        k, x = left["k"].to_pylist(), left["k_core"].to_pylist()
        rk, y = right["rk"].to_pylist(), right["rk_core"].to_pylist()
        found = []
        if k and rk:
            places = {c: i for i, c in enumerate(sorted(set().union(*rk)))}
            (b, nb), (cb, ncb) = _sets(rk, places), _sets(y, places)
            for at in range(0, len(k), STRIP):
                ks, xs = k[at : at + STRIP], x[at : at + STRIP]
                (a, na), (ca, nca) = _sets(ks, places), _sets(xs, places)
                shared = a @ b.T
                score = shared.astype(np.float64) / np.maximum(na[:, None], nb)
                bonus = np.zeros(score.shape)
                for i, j in zip(*np.nonzero((ca @ cb.T == np.minimum(nca[:, None], ncb)) & (nca[:, None] > 0) & (ncb > 0))):
                    bonus[i, j] = 0.3 if xs[i] in y[j] or y[j] in xs[i] else 0.0
                for i, j in zip(*np.nonzero(shared == np.minimum(na[:, None], nb))):
                    if ks[i] == rk[j]:
                        score[i, j], bonus[i, j] = 2.0, 0.0
                    elif ks[i] in rk[j] or rk[j] in ks[i]:
                        score[i, j] = 0.8
                score = np.round(score + bonus, 9)
                best = score.argmax(axis=1)
                top = score[np.arange(len(ks)), best]
                found += [(ks[i], float(top[i]), int(best[i])) for i in np.nonzero(top >= least - 1e-9)[0]]
        of = pa.array([j for *_, j in found], pa.int64())
        return pa.table({"k": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()), "r_seq": right["r_seq"].take(of)})

    return fit


def best_titles(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(l_seq, r_seq, score): for each left row (seq, title) the right row (seq, title) that fits best. An equal key scores 2
    and is taken at once; else a key that holds the other scores 0.8, any other the overlap of characters, and 0.3 more
    if one core name holds the other. Under least nothing fits; ties, of scores rounded to 9 places, go to the smaller seq.

    Titles share most of their characters with most others, so that hardly a pair can be ruled out. Left keys without an
    equal one are therefore compared with all right keys, in blocks (see _best_of_block)."""
    keyed = lambda df, seq, k: df.select(F.col("seq").alias(seq), X.compare_key(F.col("title")).alias(k)).filter(f"{k} <> ''").withColumn(f"{k}_core", X.core_key(F.col(k)))
    l, r = keyed(left, "l_seq", "k"), keyed(right, "r_seq", "rk")
    firsts = r.groupBy("rk", "rk_core").agg(F.min("r_seq").alias("r_seq"))
    keys = l.select("k", "k_core").distinct()
    equal = keys.join(firsts.hint("merge"), F.col("k") == F.col("rk")).select("k", F.lit(2.0).alias("score"), "r_seq")
    rest = keys.join(firsts.hint("merge"), F.col("k") == F.col("rk"), "left_anti")
    near = D.block_by_block(rest, firsts, _best_of_block(least), f"k string, score double, r_seq {r.schema['r_seq'].dataType.simpleString()}", TITLES, OFFERED)
    best = near.unionByName(equal).groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("down"), "r_seq")).alias("b"))
    return l.select("l_seq", "k").join(best.hint("merge"), "k").select("l_seq", F.col("b.r_seq").alias("r_seq"), (-F.col("b.down")).alias("score"))


def repair_urls(events: DataFrame, pages: DataFrame, candidates: DataFrame, sources: list[str], known_bad: list[str], bad_path: str, error_marks: list[str]) -> DataFrame:
    """events (seq, title, source_name, url) with their URLs repaired, and how: 'kept', 'repaired' or 'cleared'. A URL of
    one of sources is bad if it is blank or known to be, if it contains bad_path, or if its page (url, html) holds one of
    error_marks. A bad one is replaced by that of the best fitting candidate (seq, title, url), and cleared if none fits."""
    error = F.lit(False)
    for mark in error_marks:
        error = error | F.col("html").contains(mark)
    wrong = pages.filter(error).select("url").distinct().withColumn("_error", F.lit(True))
    rows = events.join(wrong.hint("merge"), "url", "left")
    url = F.coalesce("url", F.lit(""))
    bad = F.col("source_name").isin(sources) & ((url == "") | url.isin(known_bad) | url.contains(bad_path) | F.coalesce("_error", F.lit(False)))
    rows = rows.withColumn("_bad", F.coalesce(bad, F.lit(False))).drop("_error")
    found = best_titles(rows.filter("_bad").select("seq", "title"), candidates.select("seq", "title"))
    new = found.join(candidates.select(F.col("seq").alias("r_seq"), F.col("url").alias("_new")).hint("merge"), "r_seq").select(F.col("l_seq").alias("seq"), "_new")
    how = F.when(~F.col("_bad"), "kept").when(F.col("_new").isNotNull(), "repaired").otherwise("cleared")
    out = rows.join(new.hint("merge"), "seq", "left").withColumn("how", how).withColumn("url", F.when(F.col("_bad"), F.coalesce("_new", F.lit(""))).otherwise(F.col("url")))
    return out.select(*events.columns, "how")


def charset_overlap(a: Column, b: Column) -> Column:
    """Shared distinct characters over the larger number of distinct characters."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


def charset_match(pairs: DataFrame, a: str, b: str, mode: str = "flag") -> DataFrame:
    """pairs with similar (mode flag: equal, contained, or overlap above 0.7), score (mode score: 1, 0.8 or the overlap),
    or in_order (mode order: the share of a's characters found in b one after the other)."""
    x, y = F.col(a), F.col(b)
    same, held = x == y, x.contains(y) | y.contains(x)
    if mode == "flag":
        return pairs.withColumn("similar", same | held | (charset_overlap(x, y) > 0.7))
    if mode == "score":
        return pairs.withColumn("score", F.when(same, 1.0).when(held, 0.8).otherwise(charset_overlap(x, y)))
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        where = F.call_function("locate", c, y, s["at"])
        return F.struct(F.when(where > 0, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(where > 0, where + 1).otherwise(s["at"]).alias("at"))

    n = F.aggregate(F.split(x, ""), start, step, lambda s: s["n"])
    return pairs.withColumn("in_order", n / F.length(x))


def resolve_editions(incoming: DataFrame, editions: DataFrame) -> DataFrame:
    """incoming (seq, catalog_key, year, url, title) with event_id and how: by catalog and year, else by catalog and URL,
    else, without a year, by catalog and title, else new (null). The edition with the smallest seq wins; a blank URL or
    title finds nothing."""
    out = incoming
    for name, cols in (("year", ["catalog_key", "year"]), ("url", ["catalog_key", "url"]), ("title", ["catalog_key", "title"])):
        first = editions.filter(F.col(cols[1]).cast("string") != "").groupBy(*cols).agg(F.min_by("event_id", "seq").alias(f"_{name}"))
        out = out.join(first, cols, "left")
    by_title = F.when(F.col("year").isNull(), F.col("_title"))
    how = F.when(F.col("_year").isNotNull(), "year").when(F.col("_url").isNotNull(), "url").when(by_title.isNotNull(), "title").otherwise("new")
    return out.select(*incoming.columns, F.coalesce("_year", "_url", by_title).alias("event_id"), how.alias("how"))
