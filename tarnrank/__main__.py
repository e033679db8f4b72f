"""The programs: CSV in, one file out. ``python -m tarnrank --help`` lists them.

Each prints the output's path and the seconds it took; the predictions' programs print their report.
"""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, evaluation, factorisation, itemsets, neighbours, similarity
from .sources import readers, sinks


def session(master: str | None = None, app: str = "tarnrank") -> SparkSession:
    """A session with adaptive execution; what the submitting side has set stands."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    spark = (builder.master(master) if master else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnrank", description="Ratings, tags and baskets on Spark.")
    top.add_argument("--master", help="Spark master, where none is configured")
    top.add_argument("--preview", type=int, default=0, metavar="N", help="show N rows of the result too")
    programs = top.add_subparsers(dest="program", required=True)

    def program(name: str, text: str, *arguments: str) -> argparse.ArgumentParser:
        own = programs.add_parser(name, help=text)
        for a in arguments:
            own.add_argument(a)
        return own

    program("mean-by-item", "mean rating of each item", "ratings", "output")
    program("mean-by-tag", "mean rating of each tag", "ratings", "tags", "output")
    own = program("itemsets", "frequent itemsets of baskets")
    own.add_argument("case", type=int, choices=(1, 2), help="1: users are baskets of items; 2: items are baskets of users")
    own.add_argument("ratings")
    own.add_argument("support", type=int, help="baskets that hold a set, absolute")
    own.add_argument("--folder", default="", help="folder of the output, whose name follows from the input")
    own.add_argument("--method", choices=("levels", "two-pass", "growth"), default="levels")
    own = program("similar-items", "pairs of items with similar raters", "ratings", "output")
    own.add_argument("--threshold", type=float, default=0.5)
    own.add_argument("--method", choices=("bands", "exact"), default="bands")
    own = program("predict-users", "predictions from similar users", "ratings", "pairs", "output")
    own.add_argument("--neighbours", type=int, default=5)
    own = program("predict-items", "predictions from similar items", "ratings", "pairs", "similarities", "output")
    own.add_argument("--neighbours", type=int, default=5)
    own = program("predict-factors", "predictions from factors of users and items", "ratings", "pairs", "output")
    own.add_argument("--unclamped", action="store_true")
    return top


def _predicted(args, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Predictions and the test pairs asked for."""
    asked = readers.read_test_pairs(spark, args.pairs)
    train, test = neighbours.split(readers.one_rating(readers.read_ratings(spark, args.ratings)), asked)
    if args.program == "predict-users":
        return neighbours.predict_user_based(train, test, args.neighbours), asked
    if args.program == "predict-items":
        return neighbours.predict_item_based(train, test, readers.read_similarities(spark, args.similarities), args.neighbours), asked
    return factorisation.predict(factorisation.fit(train), test, not args.unclamped), asked


def run(args, spark: SparkSession) -> list[str]:
    """Runs a program; the lines to print."""
    began, lines = time.perf_counter(), []
    if args.program == "mean-by-item":
        found, path = aggregates.mean_rating_per_item(readers.read_ratings(spark, args.ratings, mode="DROPMALFORMED")), args.output
        sinks.write_csv_file(found, path, "item")
    elif args.program == "mean-by-tag":
        ratings = readers.read_ratings(spark, args.ratings, mode="DROPMALFORMED")
        found, path = aggregates.mean_rating_per_tag(ratings, readers.read_tags(spark, args.tags)), args.output
        sinks.write_csv_file(found, path, F.desc("tag"))
    elif args.program == "itemsets":
        baskets = readers.orient(readers.read_ratings(spark, args.ratings), args.case)
        miner = {"levels": itemsets.frequent_itemsets, "two-pass": itemsets.frequent_two_pass, "growth": itemsets.frequent_by_growth}[args.method]
        found, path = miner(baskets, args.support), sinks.output_name("itemsets", args.ratings, args.case, args.support, args.folder)
        sinks.write_itemsets(found, path)
    elif args.program == "similar-items":
        sets = readers.read_ratings(spark, args.ratings).select(F.col("item").alias("id"), F.col("user").alias("element")).distinct()
        found, path = (similarity.jaccard_lsh if args.method == "bands" else similarity.jaccard_exact)(sets, args.threshold), args.output
        sinks.write_triples(found, path)
    else:
        found, asked = _predicted(args, spark)
        found, path = found.persist(), args.output
        sinks.write_triples(found.select("user", "item", "prediction"), path)
        lines += evaluation.report(found, asked)
    if args.preview:
        found.show(args.preview, truncate=False)
    return [*lines, f"Output: {os.path.normpath(path) if '://' not in path else path}", f"Time: {time.perf_counter() - began:.1f} sec"]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session(args.master)
    for line in run(args, spark):
        print(line)


if __name__ == "__main__":
    main()
