"""Similar pairs of sets: MinHash signatures, bands and exact Jaccard; and an exact join by prefixes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.expressions import band_bucket, min_hashes


#: Buckets below this go four to a long, 15 bits each.
PACKED = 1 << 14
#: Elements of a set for each word of its sketch, and words at most.
PER_WORD, WORDS = 24, 64
#: Bands whose pairs are looked for at a time, and elements at least that a pass of checks shuffles.
AT_ONCE, PASS = 10, 20_000_000
#: Of the exact join: cells that elements are counted in to order them, words of a sketch at most, and elements of prefixes for a task.
CELLS, EXACT_WORDS, PER_TASK = 1 << 22, 1 << 12, 2_000_000
#: Elements of sets in a stored row of prefixes, and the columns of such a row and of what a task gets of it, with their numbers' kinds.
PER_ROW = 1_000_000
STORED = {"n": np.int32, "words": np.int32, "sketch": np.uint64, "edges": np.int32, "e": np.uint32, "row": np.int16, "at": np.int32}
SENT = {"n": np.int32, "words": np.int32, "sketch": np.uint64, "many": np.int32, "e": np.uint32, "at": np.int32}
#: Rows of a band's buckets for a task that makes their pairs.
IN_BAND = 100_000
#: Ids up to which a list of them is sent to all tasks.
LISTED = 1_000_000


@dataclass(frozen=True)
class LshParams:
    """Values of the hash family: h_j(row) = (multiplier * row + j) % modulus, and of the bands.

    The defaults are fixed values, for parity: with them every residue is met once sets have some
    hundred elements of a large universe, and unlike sets share buckets. :meth:`sized` fits the
    family to the number of rows, with independent hashes and as many buckets as 64 bits give.
    """

    hashes: int = 400
    bands: int = 40
    multiplier: int = 3
    modulus: int = 671
    buckets: int = 9066
    weights: tuple[int, ...] = (1, 227, 671, 2663, 3547, 6949, 10657, 17389, 32609, 59023)

    def __post_init__(self):
        if self.bands * len(self.weights) != self.hashes:
            raise ValueError("bands x rows must be the number of hashes")

    @staticmethod
    def sized(bands: int = 40, rows: int = 5) -> "LshParams":
        """Independent 64-bit hashes (modulus 0), for universes of any size."""
        return LshParams(hashes=bands * rows, bands=bands, multiplier=1, modulus=0, buckets=0, weights=(1,) * rows)


#: Whether a statement's shuffle files go at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, without the shuffle files that it took; or persisted where the session names none."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path, before = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dense_ranks(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` with ``rank`` from 0 in ascending order.

    Values are dealt by ranges and numbered within; only the partitions' sizes reach the driver, so
    no single task sorts them all. The numbers are written to the shared folder (``spark.checkpoint.dir``)
    where it is set, so that a lost executor cannot have ranges dealt anew; else they are persisted.
    """
    parts = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    marked = durable(parts.select(column, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    before, offsets = 0, []
    for row in marked.groupBy("part").count().orderBy("part").collect():
        offsets.append((row["part"], before))
        before += row["count"]
    starts = df.sparkSession.createDataFrame(offsets, "part int, start long")
    return marked.join(F.broadcast(starts), "part").select(column, (F.col("start") + F.col("at")).alias("rank"))


def signatures(sets: DataFrame, params: LshParams = LshParams()) -> DataFrame:
    """id, signature for sets (id, element)."""
    if not params.modulus:
        return independent_signatures(sets, params.hashes)
    ranked = sets.join(dense_ranks(sets, "element"), "element")
    rows = ranked.groupBy("id").agg(F.collect_set("rank").alias("rows"))
    return rows.select("id", min_hashes(F.col("rows"), params.hashes, params.multiplier, params.modulus).alias("signature"))


def independent_signatures(sets: DataFrame, hashes: int) -> DataFrame:
    """id, signature: the least of ``hashes`` seeded 64-bit hashes of a set's elements; no ranks are needed."""
    rows = sets.distinct().groupBy("id").agg(F.collect_set(F.xxhash64("element")).alias("rows"))
    least = F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda j: F.array_min(F.transform("rows", lambda r: F.xxhash64(r, j))))
    return rows.select("id", least.alias("signature"))


def vectors(signed: DataFrame, params: LshParams = LshParams()) -> DataFrame:
    """id, buckets: the bucket of every band of a signature, in order."""
    rows = len(params.weights)
    if params.buckets:
        one = lambda b: band_bucket(F.col("signature"), b, list(params.weights), params.buckets)
    else:
        one = lambda b: F.xxhash64(F.slice("signature", b * rows + 1, rows))
    return signed.select("id", F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), one).alias("buckets"))


def buckets(signed: DataFrame, params: LshParams = LshParams()) -> DataFrame:
    """id, band, bucket for every band of a signature."""
    return vectors(signed, params).select("id", F.posexplode("buckets").alias("band", "bucket"))


def packed(buckets: Column, params: LshParams) -> Column:
    """An array of buckets, four to a long where they are small enough."""
    if not 0 < params.buckets <= PACKED:
        return buckets
    lane = lambda k: F.coalesce(F.get(buckets, F.lit(k)).cast("long"), F.lit(0).cast("long"))
    return F.array(*[reduce(lambda x, y: x + y, [lane(k + j) * F.lit(1 << 15 * j) for j in range(4)]) for k in range(0, params.bands, 4)])


def dealt(rows: DataFrame, bands: range, block: int = 5_000) -> DataFrame:
    """Rows (id, v: packed buckets, buckets, more) for each of ``bands``, with band, bucket, part, lo, hi.

    Buckets of more than ``block`` ids are dealt by hash into parts, and each pair of parts (lo, hi) is
    a group of its own, so that no task holds a large bucket.
    """
    more = [c for c in rows.columns if c != "buckets"]
    flat = rows.select(*more, F.posexplode(F.slice("buckets", bands.start + 1, len(bands))).alias("at", "bucket")).withColumn("band", F.col("at") + F.lit(bands.start)).drop("at")
    large = durable(flat.groupBy("band", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > block))
    met = F.broadcast(large) if large.count() <= 200_000 else large
    cut = flat.join(met, ["band", "bucket"], "left").withColumn("cuts", F.coalesce(F.ceil(F.col("size") / block).cast("int"), F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return spread.select(*more, "band", "bucket", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))


def shared_first(v: np.ndarray, bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray, part: np.ndarray, cells: int = 4_000_000):
    """Pairs of places of rows, of one band, that are in one group (bucket, lo, hi) and differ in all bands before (v), each once.

    Where parts differ, rows of the one meet rows of the other. Large groups are compared as tables, a band at a time; small ones together.
    """
    order = np.lexsort((part, hi, lo, bucket))
    bucket, lo, hi, part = bucket[order], lo[order], hi[order], part[order]
    ends = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
    sizes, columns = np.diff(ends), np.ascontiguousarray(v[order].T)
    held, v = sizes <= 24, np.ascontiguousarray(v[order])
    at = np.flatnonzero(np.repeat(held, sizes))
    m = np.repeat(ends[1:], sizes)[at] - at - 1
    total, k = np.cumsum(m), 0
    while k < len(at):
        end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + 200_000, "right")))
        i = np.repeat(at[k:end], m[k:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m[k:end]) - m[k:end], m[k:end])
        fit = ((lo[i] == hi[i]) | (part[i] != part[j])) & ~(v[i] == v[j]).any(axis=1)
        yield order[i[fit]], order[j[fit]]
        k = end
    for start, end in zip(ends[:-1][~held].tolist(), ends[1:][~held].tolist(), strict=True):
        whole = lo[start] == hi[start]
        split = end if whole else start + int(np.searchsorted(part[start:end], hi[start]))
        k = start
        while k < split:
            right = k if whole else split  # of one part, the rows from here on
            stop = min(split, k + max(1, cells // max(1, end - right)))
            apart = np.triu(np.ones((stop - k, end - right), bool), 1) if whole else np.ones((stop - k, end - right), bool)
            for c in columns:
                apart &= c[k:stop, None] != c[None, right:end]
            i, j = np.nonzero(apart)
            yield order[i + k], order[j + right]
            k = stop


def banded_candidates(signed: DataFrame, params: LshParams = LshParams(), block: int = 5_000, per_task: int = IN_BAND) -> DataFrame:
    """a < b: pairs that share a bucket in a band or more, as :func:`candidates`, without a shuffle of pairs.

    A row goes to the task that has its bucket, for each band, with its buckets in the bands before, so a
    pair is left to the first band that it shares and is made once. Rows of buckets of more than ``block``
    ids are dealt by hash into parts, and each pair of parts (lo, hi) is a group of its own.
    """
    spark, kind, sent = signed.sparkSession, dict(signed.dtypes)["id"], {"bucket": np.int64, "lo": np.int32, "hi": np.int32, "part": np.int32}
    rows, narrow = durable(vectors(durable(signed), params)), np.dtype(np.uint16 if 0 < params.buckets <= 1 << 16 else np.int64)
    flat = rows.select(F.posexplode("buckets").alias("band", "bucket"))
    large = durable(flat.groupBy("band", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > block).orderBy("band", "bucket")).toArrow()
    large = large.sort_by([("band", "ascending"), ("bucket", "ascending")])
    bands, cuts = large["band"].to_numpy(), -(-large["size"].to_numpy() // block)
    known = spark.sparkContext.broadcast([(large["bucket"].to_numpy()[bands == b], cuts[bands == b]) for b in range(params.bands)])
    total = rows.count() * params.bands + int((large["size"].to_numpy() * (cuts - 1)).sum())
    parts = max(1, ceil(total / params.bands / per_task))

    def cut(batches):
        for batch in batches:
            ids, mixed = batch["id"], batch["mixed"].to_numpy()
            v = batch["buckets"].flatten().to_numpy().reshape(-1, params.bands)
            short = v.astype(narrow)
            for band in range(params.bands):
                bucket, (hot, pieces) = v[:, band], known.value[band]
                place = np.minimum(np.searchsorted(hot, bucket), max(0, len(hot) - 1))
                n = np.where(hot[place] == bucket, pieces[place], 1) if len(hot) else np.ones(len(bucket), np.int64)
                row = np.repeat(np.arange(len(bucket)), n)
                part, other = (mixed % n)[row], np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                lo, hi, key = np.minimum(part, other), np.maximum(part, other), bucket[row]
                spread = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + hi.view(np.uint64) * np.uint64(0x165667B19E3779F9)) >> np.uint64(33)
                task = (spread % np.uint64(parts)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                edges = np.searchsorted(task[order], np.arange(parts + 1))
                for t in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[t] : edges[t + 1]]
                    some = ids.take(pa.array(row[own]))
                    data = [x[own].astype(c).tobytes() for x, c in zip((key, lo, hi, part), sent.values(), strict=True)] + [short[row[own], :band].tobytes()]
                    columns = [pa.array([band * parts + t], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), some), *[pa.array([x], pa.binary()) for x in data]]
                    yield pa.RecordBatch.from_arrays(columns, names=["task", "ids", *sent, "v"])

    def found(batches):
        kept, band = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                band, ids = batch["task"][k].as_py() // parts, batch["ids"][k].values
                data = [np.frombuffer(batch[c][k].as_py(), t) for c, t in (sent | {"v": narrow}).items()]
                kept.append((ids.take(pa.array(np.arange(len(ids)))), *data[:-1], data[-1].reshape(len(ids), band)))
        if kept:
            ids, (bucket, lo, hi, part, v) = pa.concat_arrays([x[0] for x in kept]), [np.concatenate(x) for x in list(zip(*kept, strict=True))[1:]]
            kept.clear()
            for i, j in shared_first(v, bucket, lo, hi, part):
                for k in range(0, len(i), 500_000):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[k : k + 500_000])), ids.take(pa.array(j[k : k + 500_000]))], names=["x", "y"])

    dealt = rows.select("id", "buckets", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("mixed")).mapInArrow(cut, f"task int, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in [*sent, "v"]))
    met = dealt.repartitionById(params.bands * parts, "task").mapInArrow(found, f"x {kind}, y {kind}")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def sketches(whole: DataFrame) -> DataFrame:
    """id, n, sketch of sets (id, own: hashes): parities of the numbers of elements in cells, 64 to a word.

    Cells whose parities differ are at most the elements of one set alone, so sets that similar differ in few.
    """
    words = F.least(F.lit(WORDS).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("own") / PER_WORD, F.lit(1.0))))).cast("long"))
    flat = whole.select("id", F.size("own").alias("n"), words.alias("words"), F.explode("own").alias("e"))
    bit = F.get(F.array(*[F.lit(1 << j if j < 63 else -(1 << 63)).cast("long") for j in range(64)]), F.pmod(F.shiftrightunsigned("e", 32), F.lit(64)).cast("int"))
    cells = flat.groupBy("id", "n", "words", F.pmod("e", F.col("words")).alias("at")).agg(F.bit_xor(bit).alias("word"))
    made = cells.groupBy("id", "n", "words").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("held"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.col("words") - 1), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    return made.select("id", "n", filled.alias("sketch"))


def matrix(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    """The lists at ``at``, all of ``width`` numbers, as rows."""
    return column.values.to_numpy(zero_copy_only=False)[column.offsets.to_numpy()[at][:, None] + np.arange(width)]


def near_pairs(t: pa.Table, own: np.ndarray, threshold: float, lanes: bool):
    """Pairs of places in a group of dealt rows whose sizes and sketches leave the threshold possible and whose first shared band this is."""
    n, part, words = t["n"].to_numpy(), t["part"].to_numpy(), np.diff(t["sketch"].chunk(0).offsets.to_numpy())
    band, whole = t["band"][own[0]].as_py(), t["lo"][own[0]] == t["hi"][own[0]]
    sketch, v = t["sketch"].chunk(0), t["v"].chunk(0)
    kinds = [(int(w), own[words[own] == w]) for w in np.unique(words[own])]
    for k, (w, left) in enumerate(kinds):
        x = matrix(sketch, left, w)
        for wide, right in kinds[k:]:
            if n[left].max() < threshold * n[right].min() - 1e-9:
                continue
            y = np.bitwise_xor.reduce(matrix(sketch, right, wide).reshape(len(right), wide // w, w), axis=1)
            step = max(1, 1_000_000 // (len(right) * w))
            for at in range(0, len(left), step):
                some, m = left[at : at + step], n[left[at : at + step]][:, None]
                odd = np.bitwise_count((x[at : at + step][:, None, :] ^ y[None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int64)
                fit = (odd <= (1 - threshold) / (1 + threshold) * (m + n[right]) + 1e-9) & (np.minimum(m, n[right]) >= threshold * np.maximum(m, n[right]) - 1e-9)
                if wide == w:
                    fit &= some[:, None] < right
                if not whole:
                    fit &= part[some][:, None] != part[right]
                i, j = np.nonzero(fit)
                if len(i):
                    i, j = some[i], right[j]
                    size = len(v[int(own[0])])
                    p, q = matrix(v, i, size), matrix(v, j, size)
                    if lanes:
                        same = np.stack([((p ^ q) >> 15 * z) & 0x7FFF == 0 for z in range(4)], axis=2).reshape(len(i), -1)
                    else:
                        same = p == q
                    first = ~same[:, :band].any(axis=1)
                    yield i[first], j[first]


def near_in_bands(rows: DataFrame, params: LshParams, bands: range, threshold: float, block: int = 5_000) -> DataFrame:
    """a < b: pairs of ``rows`` (id, v: packed buckets, buckets, n, sketch) whose first shared band is among ``bands``, each once, without those that sizes and sketches show to be below ``threshold``."""
    key, kind, lanes = ["band", "bucket", "lo", "hi"], dict(rows.dtypes)["id"], 0 < params.buckets <= PACKED

    def matched(t: pa.Table, ends: np.ndarray):
        ids = t["id"].to_numpy()
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            if end - start > 1:
                for i, j in near_pairs(t, np.arange(start, end), threshold, lanes):
                    a, b = ids[i], ids[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def found(batches):
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if kept is None else pa.concat_tables([kept, t])).combine_chunks()
            if not t.num_rows:
                continue
            keys = np.stack([t[c].to_numpy() for c in key], axis=1)
            ends = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
            yield from matched(t, ends)
            kept = pa.Table.from_batches([t.slice(int(ends[-1])).combine_chunks().to_batches()[0]])
            kept = kept.take(pa.array(np.arange(kept.num_rows)))  # a copy, without the rest of the batch
        if kept is not None:
            t = kept.combine_chunks()
            yield from matched(t, np.array([0, t.num_rows]))

    spread = dealt(rows, bands, block).repartition(*key).sortWithinPartitions(*key)
    return spread.mapInArrow(found, f"a {kind}, b {kind}")


def candidates(bucketed: DataFrame, block: int = 5_000) -> DataFrame:
    """a < b: pairs that share a bucket in a band or more.

    Buckets of more than ``block`` ids are dealt by hash into blocks, and each pair of blocks is a
    group of its own, so that no task holds a large bucket.
    """
    sizes = bucketed.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    cut = bucketed.join(sizes, ["band", "bucket"]).withColumn("cuts", F.ceil(F.col("size") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    spread = spread.select("id", "band", "bucket", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    key = ["band", "bucket", "lo", "hi"]
    left = spread.select(*key, F.col("id").alias("a"), F.col("own").alias("p"))
    right = spread.select(*key, F.col("id").alias("b"), F.col("own").alias("q"))
    met = left.join(right, key).where("a < b and (p <> q or lo = hi)")
    return met.select("a", "b").distinct()


def hashed(sets: DataFrame) -> DataFrame:
    """id, own: a set's elements as 64-bit hashes, in a table."""
    return durable(sets.groupBy("id").agg(F.collect_set(F.xxhash64("element")).alias("own")))


def verified(sets: DataFrame, pairs: DataFrame, threshold: float = 0.5, whole: DataFrame | None = None, per_pass: int = PASS) -> DataFrame:
    """a, b, sim for pairs with a Jaccard similarity of at least ``threshold``.

    Elements are compared as 64-bit hashes, unverified, so what is shuffled and intersected are
    longs; two elements of a pair's sets are taken for one with a probability of 2 ** -64 each.
    Pairs are stored, then checked in passes, each of pairs with about as many elements as all sets
    have, or ``per_pass`` where that is more; so no more is on disk at a time, however many pairs there are.
    """
    whole, pairs = hashed(sets) if whole is None else whole, durable(pairs.select("a", "b"))
    listed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if listed.count() <= LISTED:  # sets of no pair stay where they are
        whole = whole.join(F.broadcast(listed), "id", "left_semi")
    sizes = whole.select(F.col("id").alias("a"), F.size("own").alias("n"))
    held, asked = whole.agg(F.sum(F.size("own").cast("long"))).first()[0] or 0, pairs.groupBy("a").agg(F.count("*").alias("k")).join(sizes, "a").agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
    passes = max(1, ceil(asked / max(held, per_pass)))

    def checked(some: DataFrame) -> DataFrame:
        joined = some.join(whole.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        sim = both / (F.size("x") + F.size("y") - both)
        return durable(joined.select("a", "b", sim.alias("sim")).where(F.col("sim") >= threshold))

    return reduce(DataFrame.union, [checked(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == p)) for p in range(passes)])


def jaccard_lsh(sets: DataFrame, threshold: float = 0.5, params: LshParams = LshParams()) -> DataFrame:
    """a, b, sim: banded candidates, verified.

    Pairs that meet in a bucket go at once where sizes or sketches show that they cannot be that similar.
    """
    whole = hashed(sets)
    rows = durable(vectors(durable(signatures(sets, params)), params)).join(sketches(whole), "id")  # bands read a signature, and packing a vector, 40 times
    rows = durable(rows.select("id", "buckets", packed(F.col("buckets"), params).alias("v"), "n", "sketch"))
    left = [durable(near_in_bands(rows, params, range(k, min(k + AT_ONCE, params.bands)), threshold)) for k in range(0, params.bands, AT_ONCE)]
    return verified(sets, reduce(DataFrame.union, left), threshold, whole)


def commonness(whole: DataFrame) -> np.ndarray:
    """How common the elements of a cell (the lowest bits of their hashes) are: some 8 times the binary logarithm of their number in ``whole``, a byte a cell."""
    cell = F.col("e").bitwiseAND(F.lit(CELLS - 1))
    counted = whole.select(F.explode("own").alias("e")).groupBy(cell.alias("cell")).agg(F.count("*").alias("k"))
    level = F.least(F.lit(255.0), F.round(F.log2(F.col("k") + F.lit(1)) * 8)).cast("short")
    folded = durable(counted.select(F.shiftright("cell", 12).alias("block"), F.struct(F.col("cell").cast("int").alias("cell"), level.alias("level")).alias("x")).groupBy("block").agg(F.collect_list("x").alias("xs")))
    out = np.zeros(CELLS, np.uint8)
    for row in folded.toArrow()["xs"].chunks:
        out[row.values.field("cell").to_numpy()] = row.values.field("level").to_numpy()
    return out


def prefixes(batch: pa.RecordBatch, common: np.ndarray, threshold: float, tasks: int):
    """One row for sets (id, own): their ids, sizes and sketches, and the elements of their prefixes, rarest first, in the order of tasks (edges), with the set's place (row) and their own in it (at)."""
    h, ends = batch["own"].values.to_numpy(), batch["own"].offsets.to_numpy()
    n = np.diff(ends).astype(np.int32)
    h, ends = h[ends[0] : ends[-1]], ends - ends[0]
    row = np.repeat(np.arange(len(n)), n)
    words = np.minimum(EXACT_WORDS, 2 ** np.ceil(np.log2(np.maximum(n / PER_WORD, 1))).astype(np.int32))
    starts = np.r_[0, np.cumsum(words)]
    sketch = np.zeros(starts[-1], np.uint64)
    np.bitwise_xor.at(sketch, starts[row] + (h & (words[row] - 1)), np.uint64(1) << ((h >> 32) & 63).astype(np.uint64))
    order = np.lexsort((h, common[h & (CELLS - 1)], row))
    h, at = h[order], (np.arange(len(h)) - ends[row]).astype(np.int32)
    kept = at < (n - np.ceil(n * threshold - 1e-9) + 1)[row]
    h, row, at = h[kept], row[kept].astype(np.int16), at[kept]
    task = ((h >> 38) & 0x3FFFFFF) % tasks
    order = np.argsort(task, kind="stable")
    edges = np.searchsorted(task[order], np.arange(tasks + 1)).astype(np.int32)
    # half a hash: elements that share it are met as one, which costs a check of their sets at most
    parts = [n, words.astype(np.int32), sketch, edges, (h[order] & 0xFFFFFFFF).astype(np.uint32), row[order], at[order]]
    ids = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), batch["id"])
    return pa.RecordBatch.from_arrays([ids, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["ids", *STORED])


def sent(batch: pa.RecordBatch, tasks: range):
    """task, ids, and the columns of SENT: what each of ``tasks`` has of a row of :func:`prefixes`, with the sets and sketches that it takes, and how many elements are a set's."""
    n, words, sketch, edges, e, row, at = (np.frombuffer(batch[c][0].as_buffer(), kind) for c, kind in STORED.items())
    starts, ids = np.cumsum(words) - words, batch["ids"].values
    rows = []
    for task in tasks:
        own = slice(edges[task], edges[task + 1])
        some, many = np.unique(row[own], return_counts=True)
        if len(some):
            w = words[some]
            at_words = np.repeat(starts[some] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            rows.append((ids.take(pa.array(some)), n[some], w, sketch[at_words], many.astype(np.int32), e[own], at[own], task))
    if rows:
        edges = pa.array(np.cumsum([0, *[len(x[0]) for x in rows]]), pa.int32())
        columns = [pa.array([x[-1] for x in rows], pa.int32()), pa.ListArray.from_arrays(edges, pa.concat_arrays([x[0] for x in rows]))]
        columns += [pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in range(1, 7)]
        yield pa.RecordBatch.from_arrays(columns, names=["task", "ids", *SENT])


def meeting(size: np.ndarray, words: np.ndarray, sketch: np.ndarray, many: np.ndarray, e: np.ndarray, at: np.ndarray, threshold: float):
    """Pairs of places of sets in a task that share an element, where sizes, positions and sketches leave the threshold possible.

    Places of an element are in the order of sizes, so each meets the ones after it up to the largest size that will do.
    """
    size, starts, doc = size.astype(np.int64), np.cumsum(words, dtype=np.int64) - words, np.repeat(np.arange(len(size), dtype=np.int32), many)
    order = np.lexsort((size[doc], e))
    e, doc = e[order], doc[order]
    n = size[doc]
    # a pair's first shared element leaves no more than what follows it in either set, so this is the largest size of the other
    room = (n - at[order]) * ((1 + threshold) / threshold) - n + 1e-6
    run, top = np.cumsum(np.r_[False, e[1:] != e[:-1]]), int(size.max(initial=0)) + 1
    last = np.searchsorted(run * top + n, run * top + np.minimum(np.minimum(room, n / threshold + 1e-6), top - 1).astype(np.int64), "right")
    after, of = np.maximum(last - np.arange(len(e)) - 1, 0), words[doc]
    del order, e, run, last
    seen = [np.zeros(0, np.int64)]
    for w in np.unique(of[after > 0]).tolist():
        own = np.flatnonzero(words >= w)
        place, rows = np.full(len(words), -1, np.int32), np.empty((len(own), w), np.uint64)
        place[own] = np.arange(len(own))
        for wide in np.unique(words[own]).tolist():
            some = own[words[own] == wide]
            for k in range(0, len(some), max(1, 4_000_000 // wide)):
                part = some[k : k + max(1, 4_000_000 // wide)]
                rows[place[part]] = np.bitwise_xor.reduce(sketch[starts[part][:, None] + np.arange(wide)].reshape(len(part), wide // w, w), axis=1)
        on = np.flatnonzero((of == w) & (after > 0))
        ends, k = np.cumsum(after[on]), 0
        while k < len(on):
            end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + max(10_000, 1_000_000 // w), "right")))
            m = after[on[k:end]]
            i = np.repeat(on[k:end], m)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            fit = n[i] <= room[j]
            i, j = i[fit], j[fit]
            a, b, least = doc[i], doc[j], (1 - threshold) / (1 + threshold) * (n[i] + n[j]) + 1e-9
            odd = np.bitwise_count(rows[place[a]] ^ rows[place[b]]).sum(axis=1, dtype=np.int32)
            fit = (odd <= least) & (a != b)
            a, b = a[fit].astype(np.int64), b[fit].astype(np.int64)
            seen.append(np.minimum(a, b) * len(size) + np.maximum(a, b))
            k = end
            if len(seen) > 1_000 or sum(map(len, seen[1:])) > 5_000_000:
                seen = [np.unique(np.concatenate(seen))]
    found = np.unique(np.concatenate(seen))
    for k in range(0, len(found), 100_000):
        yield found[k : k + 100_000] // len(size), found[k : k + 100_000] % len(size)


def near_by_prefixes(whole: DataFrame, threshold: float, per_task: int = PER_TASK, at_once: int | None = None) -> DataFrame:
    """a < b: pairs of sets (id, own: hashes) that share an element of their prefixes, without those that sizes and sketches show to be below ``threshold``.

    A set goes once to each task that has some element of its prefix, so sets are shuffled and not
    the pairs that meet. Prefixes are stored, and tasks take their sets in passes of ``at_once`` (else
    two to a core), so that a set's sketch is on disk for the tasks of a pass and not for all.
    """
    spark, kind = whole.sparkSession, dict(whole.dtypes)["id"]
    common = spark.sparkContext.broadcast(commonness(whole))
    total = whole.agg(F.sum(F.size("own").cast("long"))).first()[0] or 0
    tasks, at_once = max(1, ceil(total * (1 - threshold) / per_task)), at_once or 2 * spark.sparkContext.defaultParallelism

    def cut(batches):
        for batch in batches:
            ends, k = batch["own"].offsets.to_numpy(), 0
            while k < batch.num_rows:
                end = min(batch.num_rows, k + 1_000, max(k + 1, int(np.searchsorted(ends, ends[k] + PER_ROW, "right")) - 1))
                some = batch.slice(k, end - k).to_struct_array().take(pa.array(np.arange(end - k)))
                yield prefixes(pa.RecordBatch.from_struct_array(some), common.value, threshold, tasks)
                k = end

    stored = durable(whole.select("id", "own").mapInArrow(cut, f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in STORED)))

    def dealt(own: range):
        def each(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from sent(pa.RecordBatch.from_struct_array(batch.slice(k, 1).to_struct_array().take(pa.array([0]))), own)

        return each

    def pairs(parts: list):
        ids = pa.concat_arrays([ids for ids, *_ in parts])
        columns = [np.concatenate(x) for x in list(zip(*parts, strict=True))[1:]]
        parts.clear()
        for a, b in meeting(*columns, threshold):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["x", "y"])

    def found(batches):
        kept = []
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch["ids"][k].values
                kept.append((ids.take(pa.array(np.arange(len(ids)))), *[np.frombuffer(batch[c][k].as_py(), t) for c, t in SENT.items()]))
        if kept:
            yield from pairs(kept)

    def met(own: range) -> DataFrame:
        rows = stored.mapInArrow(dealt(own), f"task int, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in SENT))
        mine = rows.repartitionById(len(own), F.col("task") - F.lit(own.start)).mapInArrow(found, f"x {kind}, y {kind}")
        return durable(mine.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    passes = [met(range(k, min(k + at_once, tasks))) for k in range(0, tasks, at_once)]
    return reduce(DataFrame.union, passes).distinct() if len(passes) > 1 else passes[0]


def classes(keyed: DataFrame, *key: str) -> DataFrame:
    """root, members: the ids (in order, in a table) of rows that are equal in ``key``, of two and more; root is the smallest."""
    return durable(keyed.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("members")).where("size(members) > 1").select(F.col("members")[0].alias("root"), "members"))


def roots(rows: DataFrame, same: DataFrame) -> DataFrame:
    """``rows`` (id, more) without those that have the same as one of a smaller id, by :func:`classes`."""
    copies = same.select("root", F.explode("members").alias("id")).where("id <> root").select("id")
    return rows.join(F.broadcast(copies) if copies.count() <= LISTED else copies, "id", "left_anti")


def members(pairs: DataFrame, same: DataFrame, *more: str) -> DataFrame:
    """a < b: ``pairs`` (a, b, more) of roots, for all their members; lists are cut and dealt, rows are not shuffled."""
    own = pieces(same)
    for c in ("a", "b"):
        pairs = pairs.join(own.select(F.col("root").alias(c), F.col("some").alias(f"{c}s")), c, "left").withColumn(f"{c}s", F.coalesce(f"{c}s", F.array(c)))
    spread = pairs.select("as", "bs", *more).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = spread.select(F.explode("as").alias("x"), "bs", *more).select("x", F.explode("bs").alias("y"), *more)
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *more)


def pieces(same: DataFrame, piece: int = 1_000) -> DataFrame:
    """root, some: the members of classes, at most ``piece`` to a row."""
    starts = F.sequence(F.lit(1), F.size("members"), F.lit(piece))
    return same.select("root", "members", F.explode(starts).alias("start")).select("root", F.slice("members", F.col("start"), F.lit(piece)).alias("some"))


def among(same: DataFrame) -> DataFrame:
    """a < b: pairs of members of a class."""
    own = pieces(same)
    met = own.select("root", F.col("some").alias("as")).join(own.select("root", F.col("some").alias("bs")), "root").where(F.col("as")[0] <= F.col("bs")[0])
    spread = met.repartition(int(same.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.select(F.explode("as").alias("a"), "bs").select("a", F.explode("bs").alias("b")).where("a < b")


def jaccard_exact(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """a, b, sim: all pairs at the threshold, without MinHash.

    Elements are ordered from the rarest; sets that similar share an element within the first
    size - ceil(threshold * size) + 1, so only those few, rare elements are met on. Equal sets are
    one until the rows are made.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    whole = hashed(sets.where("id is not null and element is not null"))
    own = F.sort_array("own")
    same = classes(whole.select("id", F.size("own").alias("n"), F.xxhash64(own).alias("p"), F.xxhash64(F.lit(1), own).alias("q")), "n", "p", "q")
    single = roots(whole, same)
    found = verified(sets, near_by_prefixes(single, threshold), threshold, single)
    return members(found, same, "sim").union(among(same).withColumn("sim", F.lit(1.0)))
