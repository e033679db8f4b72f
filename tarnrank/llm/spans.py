"""Spans of regular expressions as native columns: start, end (exclusive, code points) and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def with_spans(df: DataFrame, text: str, name: str, pattern: str, guard: Column | None = None) -> DataFrame:
    """Adds ``name``: the leftmost non-overlapping matches of ``pattern`` in ``text``.

    Spark's functions return matches and the pieces between them, not places; places are sums of
    their lengths. The sums are taken in blocks of about the square root of the number of matches,
    so a text with n matches costs n ** 1.5 small steps in its row, and no shuffle. Null text: none.
    """
    hit, size, block, base = (f"__{name}_{x}" for x in ("hit", "size", "block", "base"))
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn(hit, F.coalesce(F.when(guard, found) if guard is not None else found, none))
    lengths = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hit)), F.col(hit), lambda gap, x: F.length(gap) + F.length(x)
    )
    df = df.withColumn(size, F.when(F.size(hit) > 0, lengths).otherwise(F.array().cast("array<int>")))
    n = F.size(size)
    df = df.withColumn(block, F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int")))
    add = lambda a, x: a + x
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / F.col(block)).cast("int")),
        lambda b: F.aggregate(F.slice(F.col(size), b * F.col(block) + 1, F.col(block)), F.lit(0), add),
    )
    df = df.withColumn(base, F.when(n > 0, blocks))
    df = df.withColumn(base, F.when(n > 0, F.transform(base, lambda _, i: F.aggregate(F.slice(F.col(base), F.lit(1), i), F.lit(0), add))))

    def place(value, i):
        b = F.floor(i / F.col(block)).cast("int")
        end = F.element_at(F.col(base), b + 1) + F.aggregate(F.slice(F.col(size), b * F.col(block) + 1, i - b * F.col(block) + 1), F.lit(0), add)
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

    df = df.withColumn(name, F.when(n > 0, F.transform(hit, place)).otherwise(F.array().cast(SPAN)))
    return df.drop(hit, size, block, base)


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined. spans: structs with kind, start, end."""
    order = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
