"""Removal of passages that an earlier document holds already, by Rabin-Karp window hashes.

Words become two independent 64-bit hashes; rolling polynomial hashes of every window of ``WINDOW``
words are counted in Spark, in packed form: a task sorts the hashes of ``FLUSH`` windows and combines
equal ones, as a map-side combine does. An occurrence in any document but the smallest of those is
settled there and then. The others go, dealt by hash to buckets, through the only shuffle of windows,
as compressed blobs of some 13 bytes a window; a bucket's task finds the smallest id of every hash, and each
occurrence in another document is marked. So a window in a third of all rows reaches its bucket once
for each ``FLUSH`` windows, not once a row. Marks, 64 starts a number, are merged by document into
maximal intervals, which are removed.

A window's key has 96 bits, 64 of one polynomial over one hash of the words and 32 of another over
the other, so among n windows a false match is as likely as n * n / 2 ** 97; words are not compared.

Rows: null text has no words; texts shorter than a window lose nothing; rows with null id are
returned whole and remove nothing elsewhere. Repeated rows of one id are one document with several
texts: neither removes words of the other, each loses what its own windows lose, and equal rows are
returned each time. Columns but the two named are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, ship

WINDOW = 50
#: Windows that a task sorts and combines at once, and windows that a bucket is meant to hold: bounds on memory, of some 60 bytes each.
FLUSH, BUCKET = 1_000_000, 2_000_000
#: Ids with several texts up to which they are broadcast; beyond, every text is told apart by its hash.
BROADCAST_IDS = 1_000_000
#: Word hashes kept in each worker: a bound on memory, not on input.
CACHED = 500_000
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


class _Words(dict):
    """Word to its place in ``pairs``, where its two 64-bit hashes are; filled on first use."""

    def __init__(self):
        self.pairs, self.fresh = np.zeros((1024, 2), np.uint64), bytearray()

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh += xxhash.xxh3_128_digest(word)
        return at

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= CACHED:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            new = np.frombuffer(bytes(self.fresh), np.uint64).reshape(-1, 2)
            while len(self.pairs) < len(self):
                self.pairs = np.concatenate((self.pairs, np.zeros_like(self.pairs)))
            self.pairs[len(self) - len(new) : len(self)] = new
            self.fresh = bytearray()
        return self.pairs[at, 0], self.pairs[at, 1]


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks and the controls 9 to 13, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of every run of ``size`` numbers, modulo 2 ** 64, mixed at the end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    done = 0
    block, width = hashes, 1  # block: hashes of runs of width words
    while width <= size:
        if size & width:
            out = out * np.uint64(pow(base, width, 1 << 64)) + block[done : done + n]
            done += width
        if 2 * width <= size:
            block = block[: len(block) - width] * np.uint64(pow(base, width, 1 << 64)) + block[width:]
        width *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


#: Fixed layouts of a blob: its arrays in order, those of documents (ascending by id, as differences), then those of windows or marks.
_DOCS = [("doc", "<i8", 0), ("version", "<i8", 0)]
_WINDOWS = [*_DOCS, ("h1", "<u8", 1), ("h2", "<u4", 1), ("at", "<u4", 1), ("start", "<u4", 1)]
_MARKS = [*_DOCS, ("at", "<u4", 1), ("block", "<i4", 1), ("bits", "<i8", 1)]


def _pack(arrays: dict[str, np.ndarray], layout: list) -> tuple[bytes, int]:
    """The arrays byte plane by byte plane, so that the alike high bytes of sorted numbers lie together; compressed, with their size before."""
    out = [np.array([len(arrays["doc"]), len(arrays[layout[-1][0]])], "<i8").tobytes()]
    for name, kind, _ in layout:
        x = arrays[name].astype(kind)
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    whole = b"".join(out)
    return pa.compress(whole, "zstd", asbytes=True), len(whole)


def _unpack(blob: bytes, size: int, layout: list) -> dict[str, np.ndarray]:
    blob = pa.decompress(blob, size, "zstd", asbytes=True)
    sizes, at, out = np.frombuffer(blob, "<i8", 2), 16, {}
    for name, kind, which in layout:
        n, width = int(sizes[which]), np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        at += n * width
    return out


def _runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal windows together, by h1 first, and where each run of them starts."""
    order = np.argsort(h1, kind="stable")
    one, two = h1[order], h2[order]
    if np.any((one[1:] == one[:-1]) & (two[1:] != two[:-1])):
        order = np.lexsort((h2, h1))
        one, two = h1[order], h2[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(one)), bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))


def _later(order: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each occurrence, in ``order``, lies in a document with a larger id than its window's smallest."""
    low = np.minimum.reduceat(doc[order], first)
    return doc[order] > np.repeat(low, np.diff(np.append(first, len(order))))


def _marks(at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' places, blocks and bits: window starts, 64 a number."""
    key = at.astype(np.uint64) << np.uint64(32) | start.astype(np.uint64) >> np.uint64(6)
    order = np.argsort(key, kind="stable")
    key, bit = key[order], (np.uint64(1) << (start[order].astype(np.uint64) & np.uint64(63)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key = key[first]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int32), np.bitwise_or.reduceat(bit, first).view(np.int64)


def _windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """All windows of ``docs`` (doc, version, text): blobs of those to be counted by bucket, and marks of those settled (bucket below 0)."""
    flush = FLUSH

    def factory():
        known, held, size = _Words(), [], 0

        def combined():
            nonlocal held, size
            docs = np.array([(d, v) for d, v, *_ in held], np.int64).reshape(-1, 2)
            rank = np.empty(len(held), np.int64)
            rank[np.lexsort((docs[:, 1], docs[:, 0]))] = np.arange(len(held))
            docs = docs[np.argsort(rank)]
            sizes = [len(x[2]) for x in held]
            at = np.repeat(rank, sizes)
            start = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
            h1, h2 = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            held, size = [], 0
            order, first = _runs(h1, h2)
            gone = _later(order, first, docs[at, 0])
            rows: dict[str, list] = {"bucket": [], "size": [], "blob": []}

            def emit(bucket: int, layout: list, **arrays):
                """A blob, with those of the documents that its places ``at`` name."""
                used = np.zeros(len(docs), bool)
                used[arrays["at"]] = True
                own = docs[used]
                arrays["at"] = (np.cumsum(used) - 1)[arrays["at"]]
                blob, n = _pack(arrays | {"doc": np.diff(own[:, 0], prepend=0), "version": own[:, 1]}, layout)
                for k, v in (("bucket", bucket), ("size", n), ("blob", blob)):
                    rows[k].append(v)

            settled = order[gone]
            if len(settled):
                place, block, bits = _marks(at[settled], start[settled])
                emit(-1 - int(h1[0] % np.uint64(buckets)), _MARKS, at=place, block=block, bits=bits)
            order = order[~gone]
            h1, h2, at, start = h1[order], h2[order], at[order], start[order]
            bucket = ((h1 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                emit(int(bucket[low]), _WINDOWS, h1=h1[low:high], h2=h2[low:high], at=at[low:high], start=start[low:high])
            return rows

        def step(cols):
            nonlocal size
            for doc, version, text in zip(cols["doc"].to_pylist(), cols["version"].to_pylist(), cols["text"].to_pylist(), strict=True):
                words = words_of(text)
                if len(words) >= window:
                    one, two = known.hashes(words)
                    held.append((doc, version, rolling(one, window, _B1), (rolling(two, window, _B2) >> np.uint64(32)).astype(np.uint32)))
                    size += len(words) - window + 1
            return combined() if size >= flush else None

        step.finish = lambda: combined() if size else None
        return step

    return map_texts(docs, factory, "bucket int, size int, blob binary")


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket's blobs to marks: of windows that start in a document with a smaller id too, a row each; those settled before, as they are."""
    settled = table.column("bucket")[0].as_py() < 0
    layout, parts, shift = (_MARKS if settled else _WINDOWS), [], 0
    for size, blob in zip(table.column("size").to_pylist(), table.column("blob"), strict=True):
        x = _unpack(blob.as_buffer(), size, layout)
        x["doc"], x["at"] = np.cumsum(x["doc"]), x["at"].astype(np.int64) + shift
        shift += len(x["doc"])
        parts.append(x)
    x = {name: np.concatenate([p[name] for p in parts]) for name, *_ in layout}
    del parts
    if not settled:
        order, first = _runs(x["h1"], x["h2"])
        gone = order[_later(order, first, x["doc"][x["at"]])]
        start = x["start"][gone]
        x |= {"at": x["at"][gone], "block": (start >> np.uint32(6)).astype(np.int32), "bits": (np.uint64(1) << (start.astype(np.uint64) & np.uint64(63))).view(np.int64)}
    return pa.table({"doc": x["doc"][x["at"]], "version": x["version"][x["at"]], "block": x["block"], "bits": x["bits"]})


def _removed(docs: DataFrame, window: int, id_col: str) -> DataFrame:
    """Counts and what is kept, from a document's text and its ``gone`` window starts: (block, bits), 64 starts each."""

    def factory():
        def step(cols):
            out: dict[str, list] = {id_col: cols["doc"], "n_words": [], "n_removed": [], "kept_text": [], "kept_sha256": [], "intervals": []}
            for text, gone in zip(cols["text"].to_pylist(), cols["gone"], strict=True):
                words = words_of(text)
                mark = np.zeros(len(words) + 1, np.int64)
                if gone.is_valid:
                    blocks, bits = gone.values.field("block").to_numpy(), gone.values.field("bits").to_numpy()
                    k, j = np.nonzero(np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, 64))
                    starts = blocks[k].astype(np.int64) * 64 + j
                    mark[starts] += 1
                    mark[starts + window] -= 1
                cut = np.cumsum(mark)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], cut.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                kept, last = [], 0
                for lo, hi in edges:
                    kept += words[last:lo]
                    last = hi
                left = b" ".join(kept + words[last:])
                out["n_words"].append(len(words))
                out["n_removed"].append(int(cut.sum()))
                out["kept_text"].append(left.decode("utf-8", "replace"))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["intervals"].append([{"start": a, "end": b} for a, b in edges])
            return out

        return step

    return map_texts(docs, factory, f"{id_col} long, n_words long, n_removed long, kept_text string, kept_sha256 string, intervals array<struct<start: int, end: int>>")


def marked_windows(known: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, version, block, bits (a bit for each start, 64 a block): windows of ``known`` (doc, version, text) that start in a smaller id too."""
    n = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(n // (5 * BUCKET)) + 1  # words and their gaps take 5 bytes or so
    ship(known.sparkSession)
    return _windows(known, window, buckets).groupBy("bucket").applyInArrow(_repeated, "doc long, version long, block int, bits long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text, kept_sha256, intervals (words)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # texts of one id are told apart by their hash; the others, mostly all, need none
    hashed = source.withColumn("version", F.xxhash64("text"))
    several = materialize(hashed.groupBy("doc").agg(F.min("version").alias("x"), F.max("version").alias("y")).where("doc is not null and x < y").select("doc", F.lit(True).alias("several")))
    if several.count() <= BROADCAST_IDS:
        hashed = hashed.join(F.broadcast(several), "doc", "left").select("doc", F.when(F.col("several"), F.col("version")).otherwise(F.lit(0).cast("long")).alias("version"), "text")
    marks = marked_windows(hashed.where("doc is not null and text is not null"), window)
    # a document's marks, merged before they are listed, are a number for 64 words of its text at most
    merged = marks.repartition("doc", "version").groupBy("doc", "version", "block").agg(F.bit_or("bits").alias("bits"))
    gone = materialize(merged.groupBy("doc", "version").agg(F.collect_list(F.struct("block", "bits")).alias("gone")))
    # marks grow with the corpus: they are never broadcast, at no size
    return _removed(hashed.join(gone.hint("merge"), ["doc", "version"], "left").select("doc", "text", "gone"), window, id_col)
