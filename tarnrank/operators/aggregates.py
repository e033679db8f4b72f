"""Grouped means. Each is one partial and one final hash aggregate; equi-joins carry needed columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mean_by(df: DataFrame, key: str, value: str = "rating", alias: str = "rating_avg") -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(alias))


def mean_rating_per_item(ratings: DataFrame) -> DataFrame:
    """item, rating_avg, ascending."""
    return mean_by(ratings, "item").orderBy("item")


def mean_rating_per_tag(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, rating_avg, descending; a tag given twice to an item counts its ratings twice.

    Ratings are summed by item before the join, so it carries one row an item, not one a rating.
    """
    sums = ratings.groupBy("item").agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
    joined = tags.select("item", "tag").join(sums, "item")
    return joined.groupBy("tag").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("rating_avg")).orderBy(F.desc("tag"))


def centred(ratings: DataFrame, key: str) -> DataFrame:
    """Ratings with ``mean`` of their key and ``c``, the rating less it."""
    mean = F.avg("rating").over(Window.partitionBy(key))
    return ratings.withColumn("mean", mean).withColumn("c", F.col("rating") - F.col("mean"))
