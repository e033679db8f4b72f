"""Frequent itemsets with an absolute support, exact at every level.

Level k's candidates come from the frequent (k - 1)-sets alone: two that differ in their last item
are joined, and those with a (k - 1)-subset that is not frequent go. Then occurrences of the frequent
(k - 1)-sets are extended by a larger item of the same basket, only to candidates, and counted. What
is shuffled is keyed by basket or by itemset; nothing but a level's size reaches the driver.

Where items' sets of baskets are small as bits and comparing all of them is less work than the pairs of
items that meet in baskets, they are sent to all tasks as bitmaps of at most ``BITMAPS`` bytes instead,
and each task extends its own first items depth first; then no occurrence is shuffled.
"""

from __future__ import annotations

from itertools import combinations
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .similarity import dense_ranks, durable

#: Bytes of bitmaps that are sent to all tasks at most, and comparisons of words that are as much work as a pair of items that meets in a basket.
BITMAPS, WORDS_A_PAIR = 64_000_000, 20


def frequent_singletons(baskets: DataFrame, support: int) -> DataFrame:
    """items (array of one), k, n: items in at least ``support`` baskets; repeats in a basket count once."""
    return baskets.distinct().groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select(F.array("item").alias("items"), F.lit(1).alias("k"), "n")


def level_candidates(level: DataFrame, k: int) -> DataFrame:
    """``items`` of k items all of whose (k - 1)-subsets are in ``level`` (items)."""
    head, last = F.slice("items", 1, k - 2), F.element_at("items", -1)
    left, right = level.select(head.alias("head"), last.alias("x")), level.select(head.alias("head"), last.alias("y"))
    grown = left.join(right, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("items"))
    for drop in range(k - 2):  # those without one of the last two are what was joined
        subset = F.concat(F.slice("items", 1, drop), F.slice("items", drop + 2, k - drop - 1))
        grown = grown.withColumn("subset", subset).join(level.select(F.col("items").alias("subset")), "subset", "left_semi").select("items")
    return grown


def extended(prefix: tuple, ids: np.ndarray, bits: np.ndarray, support: int, max_k: int | None):
    """(items, n) of frequent sets of ``prefix`` and two or more of ``ids``, whose bitmaps with the prefix are ``bits``; depth first."""
    if len(ids) < 2 or max_k is not None and len(prefix) + 2 > max_k:
        return
    step = max(1, 4_000_000 // bits.size)
    for at in range(0, len(ids) - 1, step):
        counts = np.bitwise_count(bits[at : at + step, None, :] & bits[None, at + 1 :, :]).sum(axis=2, dtype=np.int64)
        for i in range(min(step, len(ids) - 1 - at)):
            met = np.flatnonzero(counts[i, i:] >= support) + i
            if len(met):
                own, after = int(ids[at + i]), at + 1 + met
                for j, n in zip(after, counts[i, met], strict=True):
                    yield (*prefix, own, int(ids[j])), int(n)
                yield from extended((*prefix, own), ids[after], bits[after] & bits[at + i], support, max_k)


def from_first(first: int, bits: np.ndarray, turned: np.ndarray, support: int, max_k: int | None):
    """Frequent sets of two and more items (places in ``bits``) whose first is ``first``: the second items with their counts, then (items, n) of larger sets."""
    rest = turned[:, first + 1 :]
    if len(turned) <= 64:
        counts = np.zeros(rest.shape[1], np.int64)
        for word, own in zip(rest, turned[:, first], strict=True):
            counts += np.bitwise_count(word & own)
    else:
        counts = np.array([np.bitwise_count(bits[first] & x).sum(dtype=np.int64) for x in bits[first + 1 :]], np.int64)
    met = np.flatnonzero(counts >= support)
    seconds = met + first + 1
    return seconds, counts[met], extended((first,), seconds, bits[seconds] & bits[first], support, max_k)


def by_bitmaps(pairs: DataFrame, level: DataFrame, support: int, max_k: int | None = None) -> DataFrame | None:
    """items, k, n of sets of two and more, from ``pairs`` (basket, item; a set) of the frequent items of ``level``; None where bitmaps are too large or more work."""
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["item"]
    sizes = pairs.groupBy("basket").agg(F.count("*").cast("double").alias("size"))
    total, met = sizes.agg(F.count("*"), F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()
    items, words = level.count(), -(-total // 64)
    if not items or items * words * 8 > BITMAPS or items * items / 2 * words > WORDS_A_PAIR * met:
        return None
    names = level.select(F.col("items")[0].alias("item")).orderBy("item").toArrow()["item"].combine_chunks()
    one = F.get(F.array(*[F.lit(1 << j if j < 63 else -(1 << 63)).cast("long") for j in range(64)]), F.pmod("rank", F.lit(64)).cast("int"))
    set_bits = pairs.join(dense_ranks(pairs, "basket"), "basket").groupBy("item", F.floor(F.col("rank") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros((items, words), np.uint64)  # of signed numbers NumPy counts the bits of the absolute value
    bits[pc.index_in(set_bits["item"], value_set=names).to_numpy(), set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast((names, bits))
    tasks = min(items, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def grown(batches):
        own, rows = held.value
        turned = np.ascontiguousarray(rows.T)

        def batch(places, lengths, counts):
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), own.take(pa.array(places, pa.int64())))
            return pa.RecordBatch.from_arrays([lists, pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())], names=["items", "k", "n"])

        for some in batches:
            for task in some["id"].to_pylist():
                for first in range(task, len(rows), tasks):
                    seconds, counts, larger = from_first(first, rows, turned, support, max_k)
                    if len(seconds):
                        yield batch(np.stack([np.full(len(seconds), first), seconds], axis=1).ravel(), np.full(len(seconds), 2), counts)
                    waiting = []
                    for x in larger:
                        waiting.append(x)
                        if len(waiting) == 10_000:
                            yield batch([i for c, _ in waiting for i in c], [len(c) for c, _ in waiting], [n for _, n in waiting])
                            waiting = []
                    if waiting:
                        yield batch([i for c, _ in waiting for i in c], [len(c) for c, _ in waiting], [n for _, n in waiting])

    return durable(spark.range(0, tasks, 1, tasks).mapInArrow(grown, f"items array<{kind}>, k int, n long"))


def frequent_itemsets(baskets: DataFrame, support: int, max_k: int | None = None) -> DataFrame:
    """items (ascending array), k, n for every set in at least ``support`` baskets; none gives no rows."""
    if support < 1:
        raise ValueError("support must be 1 or more")
    pairs = baskets.select("basket", "item").where("basket is not null and item is not null").distinct()
    level = frequent_singletons(pairs, support).persist(StorageLevel.MEMORY_AND_DISK)
    pairs = pairs.join(level.select(F.col("items")[0].alias("item")), "item", "left_semi").select("basket", "item").persist(StorageLevel.MEMORY_AND_DISK)
    if (max_k is None or max_k > 1) and (larger := by_bitmaps(pairs, level, support, max_k)) is not None:
        return level.union(larger)
    found, held, k = level, pairs.select("basket", F.array("item").alias("items")), 1
    while (max_k is None or k < max_k) and not level.isEmpty():
        k += 1
        grown = held.join(pairs, "basket").where(F.col("item") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("item")).alias("items"))
        if k > 2:  # all pairs of frequent items are candidates
            able = level_candidates(level, k).persist(StorageLevel.MEMORY_AND_DISK)
            if not able.count():
                break
            grown = grown.join(able, "items", "left_semi").select("basket", "items")
        level = grown.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("items", F.lit(k).alias("k"), "n").persist(StorageLevel.MEMORY_AND_DISK)
        held = grown.join(level.select("items"), "items", "left_semi").select("basket", "items").persist(StorageLevel.MEMORY_AND_DISK)
        found = found.union(level)
    return found


def frequent_by_growth(baskets: DataFrame, support: int) -> DataFrame:
    """The same sets by the library's pattern growth: items, k, n."""
    from pyspark.ml.fpm import FPGrowth

    rows = baskets.distinct().groupBy("basket").agg(F.collect_set("item").alias("items"))
    n = rows.count()
    if not n:
        return baskets.sparkSession.createDataFrame([], "items array<long>, k int, n long")
    # half below the support, as the library rounds its fraction up
    fitted = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(rows)
    return fitted.freqItemsets.select(F.array_sort("items").alias("items"), F.size("items").alias("k"), F.col("freq").alias("n"))


def partition_candidates(rows: list[set], k: int, local: float, known: set | None) -> set:
    """Ascending k-tuples that occur in at least ``local`` of a partition's baskets.

    With ``known``, the candidates of the level before, only tuples whose (k - 1)-subsets are all
    among them are counted, and of each basket only the items that some of them holds.
    """
    counts: dict[tuple, int] = {}
    useful = None if known is None else {i for c in known for i in c}
    for row in rows:
        for c in combinations(sorted(row if useful is None else row & useful), k):
            if known is None or all(s in known for s in combinations(c, k - 1)):
                counts[c] = counts.get(c, 0) + 1
    return {c for c, n in counts.items() if n >= local}


def partition_levels(rows: list[set], local: float, max_k: int | None = None) -> list[tuple]:
    """Candidates of every level of a partition, until a level is empty."""
    found, known, k = [], None, 0
    while max_k is None or k < max_k:
        k += 1
        known = partition_candidates(rows, k, local, known)
        if not known:
            break
        found += sorted(known)
    return found


def frequent_two_pass(baskets: DataFrame, support: int, max_k: int | None = None, block: int = 20_000) -> DataFrame:
    """items, k, n by two passes: candidates frequent within a block of baskets, level by level, then exact counts.

    A set frequent overall is so in some block at its share of the support, so the result equals
    :func:`frequent_itemsets` however baskets are dealt. A block of at most ``block`` baskets is what
    a task holds; items that are not frequent are dropped before, as no frequent set has one. Candidates
    are joined with baskets on their first two items, so that a basket only meets those it may hold.
    """
    if support < 1:
        raise ValueError("support must be 1 or more")
    pairs = baskets.select("basket", "item").where("basket is not null and item is not null").distinct()
    single = frequent_singletons(pairs, support)
    pairs = pairs.join(single.select(F.col("items")[0].alias("item")), "item", "left_semi")
    rows = pairs.groupBy("basket").agg(F.collect_set("item").alias("items")).persist(StorageLevel.MEMORY_AND_DISK)
    total = rows.count()

    def local(frames):
        held: list[set] = []

        def found():
            own = partition_levels(held, max(1.0, floor(support * len(held) / total)), max_k)
            held.clear()
            return pd.DataFrame({"items": [list(c) for c in own]})

        for frame in frames:
            for x in frame["items"]:
                held.append(set(x))
                if len(held) >= block:
                    yield found()
        if held:
            yield found()

    kind = dict(baskets.dtypes)["item"]
    candidates = rows.select("items").mapInPandas(local, f"items array<{kind}>").distinct().where("size(items) > 1")
    candidates = candidates.select("items", F.col("items")[0].alias("first"), F.col("items")[1].alias("second"))
    first, second = pairs.select("basket", F.col("item").alias("first")), pairs.select("basket", F.col("item").alias("second"))
    met = first.join(second, "basket").where("first < second").join(candidates, ["first", "second"]).select("basket", "items")
    # pairs are whole already; of larger candidates a basket must hold the rest too
    more = met.where("size(items) > 2").join(rows.select("basket", F.col("items").alias("own")), "basket").where(F.size(F.array_except("items", "own")) == 0)
    counted = met.where("size(items) = 2").select("items").union(more.select("items")).groupBy("items").agg(F.count("*").alias("n"))
    return single.union(counted.where(F.col("n") >= support).select("items", F.size("items").alias("k"), "n"))
