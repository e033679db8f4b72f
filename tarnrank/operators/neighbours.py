"""Neighbour-based rating prediction: split, centring, similarities, ranks and weighted sums, all joins on long-form rows."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import clamp, ratio
from .similarity import durable

#: Digits that similarities are rounded to before they are ranked, so that ties are ties everywhere.
DIGITS = 12
#: Rows of a group in a block, from which its pairs are dealt to several groups.
BLOCK = 2_000
#: Pairs of items whose common raters are counted in one pass (a pass shuffles some 7 bytes a pair), and in one of its tasks.
PASS, TASK = 150_000_000, 1_000_000


def split(ratings: DataFrame, test_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: test are those whose pair is listed; pairs without a rating vanish."""
    keys = test_pairs.select("user", "item").distinct()
    return ratings.join(keys, ["user", "item"], "left_anti"), ratings.join(keys, ["user", "item"], "left_semi")


def warm(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and item both occur in train."""
    return test.join(train.select("user").distinct(), "user", "left_semi").join(train.select("item").distinct(), "item", "left_semi")


def centred_rows(train: DataFrame) -> DataFrame:
    """user, item, c: ratings less their user's mean."""
    return train.groupBy("user").agg(F.avg("rating").alias("mean")).join(train, "user").select("user", "item", (F.col("rating") - F.col("mean")).alias("c"))


def meetings(rows: DataFrame, group: str, key: str, value: str, block: int = BLOCK) -> DataFrame:
    """a < b, x, y: pairs of ``key`` that occur with one ``group``, with their values.

    A group of more than ``block`` rows is cut by hash into blocks; each row meets each block in a
    group of its own, so that no task holds the square of a large group.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    cut = rows.join(sizes.where("size > 1"), group).withColumn("cuts", F.ceil(F.col("size") / block).cast("int"))
    left = cut.select(group, F.col(key).alias("a"), F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"))
    right = cut.select(group, F.col(key).alias("b"), F.col(value).alias("y"), F.pmod(F.xxhash64(key), F.col("cuts")).cast("int").alias("part"))
    return left.join(right, [group, "part"]).where("a < b").select("a", "b", "x", "y")


def directions(train: DataFrame) -> DataFrame:
    """user, item, c: ratings less their user's mean, over the norm of all of these; 0 for a user whose ratings are all equal."""
    rows = centred_rows(train)
    norms = rows.groupBy("user").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return rows.join(norms, "user").select("user", "item", F.coalesce(ratio(F.col("c"), F.col("norm")), F.lit(0.0)).alias("c"))


def settled(x: Column) -> Column:
    """``x``, and 0 where it is 0 at the digits that similarities are ranked at: what the order of a sum leaves of terms that cancel."""
    return F.when(F.abs(x) < 0.5 * 10.0**-DIGITS, F.lit(0.0)).otherwise(x)


def user_cosine(train: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """a < b, sim: cosine of users' centred rows, over co-rated items with norms over all items.

    Pairs without a co-rated item are absent (0); a user whose ratings are all equal has 0, and so has
    a pair whose products cancel. With
    ``pairs`` (a, b) only those are evaluated: each meets the ratings of its first user, then those
    of its second at the same items, so that work grows with the pairs asked for and not with the
    square of an item's raters.
    """
    rows = directions(train)
    if pairs is None:
        met = meetings(rows, "item", "user", "c")
    else:
        left, right = rows.select(F.col("user").alias("a"), "item", F.col("c").alias("x")), rows.select(F.col("user").alias("b"), "item", F.col("c").alias("y"))
        met = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "item"])
    return met.groupBy("a", "b").agg(settled(F.sum(F.col("x") * F.col("y"))).alias("sim"))


def pairs_are_fewer(train: DataFrame, test: DataFrame) -> bool:
    """Whether the pairs of a test user and a rater, each with the user's ratings, are fewer rows than all pairs of raters of an item."""
    raters = train.groupBy("item").agg(F.count("*").cast("double").alias("n"))
    every = raters.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    asked = test.join(raters, "item").join(train.groupBy("user").agg(F.count("*").cast("double").alias("own")), "user").agg(F.sum(F.col("n") * F.col("own"))).first()[0] or 0
    return asked < every


def nearest(candidates: DataFrame, k: int = 5, skip_top: int = 1) -> DataFrame:
    """Candidates (user, item, neighbour, sim, …) ranked by similarity, then neighbour; ``skip_top`` from the top are passed over."""
    order = Window.partitionBy("user", "item").orderBy(F.desc(F.round("sim", DIGITS)), "neighbour")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank").between(skip_top + 1, skip_top + k))


def _combine(test: DataFrame, chosen: DataFrame, means: DataFrame, key: str) -> DataFrame:
    sums = chosen.groupBy("user", "item").agg(F.sum(F.col("sim") * F.col("c")).alias("top"), F.sum("sim").alias("bottom"))
    moved = ratio(F.col("top"), settled(F.col("bottom")))
    out = test.join(means, key).join(sums, ["user", "item"], "left")
    return out.select("user", "item", "rating", F.when(moved.isNotNull(), clamp(F.col("mean") + moved)).otherwise(F.col("mean")).alias("prediction"))


def user_candidates(train: DataFrame, test: DataFrame, sims: DataFrame | None = None) -> DataFrame:
    """user, item, neighbour, sim, c: raters of the item, with 0 where users have no co-rated item.

    Without ``sims``, cosines are computed: of these pairs alone where counts say that it is less
    work than those of all co-raters. Both ways give the same rows.
    """
    rows = centred_rows(train).select(F.col("user").alias("neighbour"), "item", "c")
    pairs = test.select("user", "item").join(rows, "item").where("user <> neighbour")
    keyed = pairs.withColumn("a", F.least("user", "neighbour")).withColumn("b", F.greatest("user", "neighbour"))
    sims = user_cosine(train, keyed if pairs_are_fewer(train, test) else None) if sims is None else sims
    return keyed.join(sims, ["a", "b"], "left").select("user", "item", "neighbour", F.coalesce("sim", F.lit(0.0)).alias("sim"), "c")


def predict_user_based(train: DataFrame, test: DataFrame, k: int = 5, skip_top: int = 1) -> DataFrame:
    """user, item, rating, prediction for warm test rows: the user's mean moved by neighbours' centred ratings."""
    test = warm(test, train)
    means = train.groupBy("user").agg(F.avg("rating").alias("mean"))
    chosen = nearest(user_candidates(train, test), k, skip_top)
    return _combine(test, chosen, means, "user")


def rated_lists(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item, n, asked: an item's raters and whether ``test`` has it; and user, asked, asked_n, others, others_n: a user's items, those asked in the order of (n, item)."""
    owned = durable(train.where("user is not null").select("user", "item").repartition("user").groupBy("user").agg(F.collect_set("item").alias("items")))
    rated = owned.select("user", F.explode("items").alias("item"))
    wanted = test.select("item").distinct().withColumn("asked", F.lit(True))
    sizes = durable(rated.groupBy("item").agg(F.count("*").alias("n")).join(wanted, "item", "left").select("item", "n", F.coalesce("asked", F.lit(False)).alias("asked")))
    held = F.struct("n", "item")
    lists = rated.join(sizes, "item").repartition("user").groupBy("user").agg(F.sort_array(F.collect_list(F.when(F.col("asked"), held))).alias("x"), F.collect_list(F.when(~F.col("asked"), held)).alias("y"))
    return sizes, durable(lists.select("user", F.col("x.item").alias("asked"), F.col("x.n").alias("asked_n"), F.col("y.item").alias("others"), F.col("y.n").alias("others_n")).where("size(asked) > 0"))


def item_similarities(train: DataFrame, test: DataFrame, threshold: float, block: int = BLOCK, per_pass: int = PASS) -> DataFrame:
    """a < b, sim of at least ``threshold``: Jaccard similarities of raters' sets, of pairs with an item of ``test``.

    A user's item goes with the list of the user's items after it to the task that counts its pairs,
    so an item, not a pair, is a row of the shuffle. Items are in the order of their raters, so the
    first of a pair tells how many in common it takes at least, and the rest of the pairs go where they
    are counted. Passes over stored lists, each of other items, bound what is shuffled at a time.
    Lists of more than ``block`` items meet by blocks.
    """
    sizes, lists = rated_lists(train, test)
    n, m = F.size("asked").cast("double"), F.size("others").cast("double")
    total, longest = lists.agg(F.sum(n * (n - 1) / 2 + n * m), F.max(n + m)).first()
    passes = max(1, ceil((total or 0) / per_pass))
    parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil((total or 0) / passes / TASK))
    # a pair of asked items is counted at the one with fewer raters, a pair with another item at that one
    least = lambda n, asked: F.ceil((F.when(asked, 2 * threshold / (1 + threshold)).otherwise(threshold)) * n - 1e-9).cast("int").alias("least")
    short = lists.where(F.size("asked") + F.size("others") <= block)
    first = short.select("asked", "asked_n", F.posexplode("asked").alias("at", "a")).where(F.col("at") + 1 < F.size("asked"))
    first = first.select("a", least(F.get("asked_n", F.col("at")), F.lit(True)), F.slice("asked", F.col("at") + 2, F.size("asked")).alias("rest"))
    other = short.select("asked", F.explode(F.arrays_zip("others", "others_n")).alias("o")).select(F.col("o.others").alias("a"), least(F.col("o.others_n"), F.lit(False)), F.col("asked").alias("rest"))
    rows = first.union(other)
    if longest and longest > block:
        long = lists.where(F.size("asked") + F.size("others") > block)
        one = lambda items, asked: long.select("user", F.explode(F.arrays_zip(F.col(items).alias("item"), F.col(f"{items}_n").alias("n"))).alias("o")).select("user", "o.item", F.struct(F.lit(asked).alias("asked"), "o.n", "o.item").alias("own"))
        met = meetings(one("asked", True).union(one("others", False)), "user", "item", "own", block).where("x.asked or y.asked").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        rows = rows.union(met.select("x.item", least(F.col("x.n"), F.col("x.asked")), F.array("y.item").alias("rest")))

    def counted(own: DataFrame) -> DataFrame:
        common = own.repartition(parts, "a").select("a", "least", F.explode("rest").alias("b")).groupBy("a", "least", "b").agg(F.count("*").alias("c")).where("c >= least")
        both = common.join(sizes.select(F.col("item").alias("a"), F.col("n").alias("m")), "a").join(sizes.select(F.col("item").alias("b"), "n"), "b")
        sims = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("c") / (F.col("m") + F.col("n") - F.col("c"))).alias("sim"))
        return durable(sims.where(F.col("sim") >= threshold))

    return reduce(DataFrame.union, [counted(rows.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == p)) for p in range(passes)])


def similar_are_fewer(train: DataFrame, test: DataFrame, both: DataFrame) -> bool:
    """Whether the items similar to those of ``test`` are fewer rows than the items of its users."""
    similar = test.join(both.groupBy("item").agg(F.count("*").cast("double").alias("n")), "item").agg(F.sum("n")).first()[0] or 0
    own = test.join(train.groupBy("user").agg(F.count("*").cast("double").alias("n")), "user").agg(F.sum("n")).first()[0] or 0
    return similar < own


def item_candidates(train: DataFrame, test: DataFrame, sims: DataFrame) -> DataFrame:
    """user, item, neighbour, sim, c: the user's items that have a stored similarity with the item.

    Pairs of ``test`` meet the similar items first or the user's, whichever counts say are fewer.
    """
    means = train.groupBy("item").agg(F.avg("rating").alias("mean")).withColumnRenamed("item", "neighbour")
    rows = train.select("user", F.col("item").alias("neighbour"), "rating")
    both = sims.select("a", "b", "sim").union(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    both = both.select(F.col("a").alias("item"), F.col("b").alias("neighbour"), "sim").distinct()
    asked = test.select("user", "item")
    if similar_are_fewer(train, test, both):
        met = asked.join(both, "item").join(rows, ["user", "neighbour"])
    else:
        met = asked.join(rows, "user").join(both, ["item", "neighbour"])
    return met.join(means, "neighbour").select("user", "item", "neighbour", "sim", (F.col("rating") - F.col("mean")).alias("c"))


def predict_item_based(train: DataFrame, test: DataFrame, sims: DataFrame, k: int = 5, skip_top: int = 1) -> DataFrame:
    """user, item, rating, prediction for warm test rows: the item's mean moved by the user's ratings of similar items.

    ``sims`` (a, b, sim > 0) holds a pair in one direction or both.
    """
    test = warm(test, train)
    means = train.groupBy("item").agg(F.avg("rating").alias("mean"))
    return _combine(test, nearest(item_candidates(train, test, sims), k, skip_top), means, "item")
