"""What the operators share: the work folder, durable intermediates, Arrow mapping, components."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to one inner step of an Arrow mapping: bounds the memory of a batch of long texts.
CHUNK_CHARS = 4_000_000
#: Texts in an Arrow batch: Spark's default of 10,000 long texts would not fit a worker.
BATCH_ROWS = 1_000


def work_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent and the master is local, a temporary folder is set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tarnrank-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that would not find it on their path."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    context = spark.sparkContext
    if root == os.getcwd() or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or not os.path.isdir(package) or getattr(context, "_shipped", None) == package:
        return
    path = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    context.addPyFile(path)
    context._shipped = package


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Cuts the lineage durably: a lost executor costs nothing that was written. The shuffle files
    behind the table are released afterwards: the context's cleaner drops those of collected plans,
    which takes a second collection, as what the first one frees still holds them.
    """
    spark = df.sparkSession
    path = path or f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for wait in (0.2, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, fn: Callable[[], Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """Maps rows by Arrow batches.

    ``fn()`` makes a task's step; ``step(columns)`` gets a dict of Arrow arrays, one for each column of
    ``df``, with a bounded amount of text, and returns a dict of lists or arrays, one for each column of
    ``schema``, or None. A step's attribute ``finish``, if any, is called at the task's end.
    """
    ship(df.sparkSession)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, BATCH_ROWS)
    names = df.columns
    out_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            for part in _chunks(batch):
                got = step({n: part.column(i) for i, n in enumerate(names)})
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out_schema], schema=out_schema)
        last = getattr(step, "finish", None)
        got = last() if last else None
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_CHARS bytes, one row at least."""
    if batch.num_rows == 0:
        return
    n = max(1, int(batch.num_rows * min(1.0, CHUNK_CHARS / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars. Each round is a pair of
    grouped minima (pre-aggregated before the shuffle) and equi-joins that adaptive execution can
    split on a hub, and is written to the shared folder. Only two numbers a round reach the driver.
    Rounds end when the edges stay the same, which they do after a number that grows with the
    logarithm of the longest path at most squared; there is no other end.
    Nodes without an edge are absent; loops and null ends are ignored; no edges give no rows.
    """
    edges = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        kept = edges.join(low, "a")
        edges = kept.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(edges)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("b").agg(F.min("b").alias("root")).select(F.col("b").alias("node"), "root")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
