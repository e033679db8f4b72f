"""Sources: CSV files with explicit schemas, read by Spark so that any store it reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS = "user long, item long, rating double, ts long"
TAGS = "user long, item long, tag string, ts long"
PAIRS = "user long, item long"
SIMILARITIES = "a long, b long, sim double"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, mode: str = "DROPMALFORMED", min_partitions: int | None = None, **options) -> DataFrame:
    """CSV by position under ``schema``; without one, types are inferred, which is a pass more.

    mode: DROPMALFORMED drops rows that do not fit, FAILFAST fails on them. ``escape`` and other
    options of the reader may be given. min_partitions repartitions where the file has fewer.
    """
    reader = spark.read.options(header=header, mode=mode, enforceSchema=True, **options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.repartition(min_partitions) if min_partitions and df.rdd.getNumPartitions() < min_partitions else df


def read_ratings(spark: SparkSession, path: str, mode: str = "FAILFAST", **options) -> DataFrame:
    return read_csv(spark, path, RATINGS, mode=mode, **options)


def read_tags(spark: SparkSession, path: str, mode: str = "DROPMALFORMED", **options) -> DataFrame:
    return read_csv(spark, path, TAGS, mode=mode, **options).drop("ts")


def read_test_pairs(spark: SparkSession, path: str, mode: str = "FAILFAST", **options) -> DataFrame:
    """User and item pairs as a set."""
    return read_csv(spark, path, PAIRS, mode=mode, **options).select("user", "item").distinct()


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, sim`` lines without a header, made symmetric."""
    return symmetric(read_csv(spark, path, SIMILARITIES, header=False, mode="FAILFAST", ignoreLeadingWhiteSpace=True))


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "sim").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def without_header(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines but those equal to the first line of the file, which the caller's frame starts with."""
    first = lines.first()
    return lines if first is None else lines.where(F.col(column) != first[column])


def orient(ratings: DataFrame, case: int) -> DataFrame:
    """basket, item of ratings: case 1 takes users as baskets of items, case 2 items as baskets of users."""
    columns = {1: ("user", "item"), 2: ("item", "user")}
    if case not in columns:
        raise ValueError("case must be 1 or 2")
    basket, item = columns[case]
    return ratings.select(F.col(basket).alias("basket"), F.col(item).alias("item"))


def one_rating(ratings: DataFrame) -> DataFrame:
    """One row for each user and item: the mean of repeated ratings."""
    return ratings.groupBy("user", "item").agg(F.avg("rating").alias("rating"))
