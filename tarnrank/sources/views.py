"""Rating-, tag- and basket-shaped views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, rating: quantities of a customer's orders of a part, tenths; pairs may repeat."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), (F.col("l_quantity") / 10).alias("rating"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    return lines.join(orders, "l_orderkey").select("user", "item", "rating")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_ratings(spark, sf_dir).groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, tag: type, brand and the words of the name of a part; a word may repeat."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("item"), F.explode(F.concat(F.array("p_type", "p_brand"), F.split("p_name", " "))).alias("tag"))


def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket, item: the brands of an order, as numbers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), "l_partkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("item"))
    return lines.join(part, "l_partkey").select("basket", "item")


def user_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket, item: the users of an hour, for the swapped orientation."""
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMddHH").cast("long").alias("basket"), F.col("user_id").alias("item"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, element: distinct lower-cased tokens between white space of each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " ")), " "))).alias("element")).where("element <> ''")


def is_test():
    """A tenth of the pairs, by their numbers."""
    return (F.col("user") * 7 + F.col("item") * 13) % 10 == 0
