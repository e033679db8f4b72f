"""Sinks for small results: single files in fixed text forms, written by Spark and promoted by Hadoop's file system.

One file needs one sorted partition. Rows are counted first: up to ``SINGLE`` one task sorts and writes
them; beyond, they are sorted by all tasks and written as a folder of part files, in order, at the path.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import tuple_text

#: Rows up to which a sink writes a single file.
SINGLE = 10_000_000


def _promote(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the one part file of ``folder`` to ``path``, and deletes the folder.

    An older file at ``path`` is put aside first and deleted last; it is put back where the move
    fails, which raises and leaves the part file where it is.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(folder), hadoop.Path(path)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"{len(parts)} part files in {folder}")
    if target.getParent() is not None:
        files.mkdirs(target.getParent())
    old = hadoop.Path(f"{path}.old-{uuid.uuid4().hex}")
    aside = files.exists(target)
    if aside and not files.rename(target, old):
        raise RuntimeError(f"{path} cannot be replaced; the output is in {folder}")
    if not files.rename(parts[0], target):
        if aside:
            files.rename(old, target)
        raise RuntimeError(f"{path} cannot be written; the output is in {folder}")
    if aside:
        files.delete(old, False)
    files.delete(source, True)


def _write(df: DataFrame, path: str, order: tuple, columns: list[str], form: str, **options) -> None:
    if df.limit(SINGLE + 1).count() > SINGLE:
        df.orderBy(*order).select(*columns).write.mode("overwrite").options(**options).format(form).save(path)
        return
    folder = f"{path}.tmp-{uuid.uuid4().hex}"
    df.coalesce(1).sortWithinPartitions(*order).select(*columns).write.options(**options).format(form).save(folder)
    _promote(df.sparkSession, folder, path)


def write_csv_file(df: DataFrame, path: str, *order: Column | str) -> None:
    """One CSV file with a header, sorted by ``order``."""
    _write(df, path, order, df.columns, "csv", header=True)


def write_text_file(lines: DataFrame, path: str, *order: Column | str) -> None:
    """One text file of the column ``line``, sorted by ``order``."""
    _write(lines, path, order, ["line"], "text")


def write_triples(df: DataFrame, path: str) -> None:
    """``a, b, value`` lines of the first three columns, ascending."""
    a, b, value = df.columns[:3]
    write_text_file(df.select(a, b, F.concat_ws(", ", *[F.col(c).cast("string") for c in (a, b, value)]).alias("line")), path, a, b)


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """k and line for each level: its sets in ascending order, ``(a), (b)`` or ``(a, b), (c, d)``."""
    ordered = F.sort_array(F.collect_list(F.col("items")))
    return itemsets.groupBy("k").agg(F.array_join(F.transform(ordered, tuple_text), ", ").alias("line"))


def write_itemsets(itemsets: DataFrame, path: str) -> None:
    """A line for each level, each followed by an empty line."""
    write_text_file(itemset_report(itemsets).select("k", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("line").alias("line")), F.struct(F.lit(1).alias("o"), F.lit("").alias("line")))).alias("x")).select("k", "x.o", "x.line"), path, "k", "o")


def output_name(app: str, input_path: str, case: int, support: int, folder: str = "") -> str:
    """``<app>_<input base>.case<c>-<support>.txt`` in ``folder``."""
    base = os.path.splitext(os.path.basename(input_path))[0]
    return os.path.join(folder, f"{app}_{base}.case{case}-{support}.txt")
