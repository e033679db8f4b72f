"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared by exclusive-or and bit counts in tiles. Two fingerprints differ in at
least as many bits as their population counts do, word by word, so tile pairs whose counts are
further apart than the radius are skipped; no other pair is. Tiles that grow past a cell's size
are cut by hash, and every pair of cells is a task of bounded size.

Rows: null text is the empty text and has fingerprint zero, which links like any other. Repeated
rows are returned each time. Null ids never become a component's id unless all its ids are null.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_texts, materialize, ship

RADIUS, SHINGLE = 3, 3
#: Fingerprints in a cell, the largest side of one comparison task.
CELL = 1 << 18
#: Products of sides from which a comparison is cut further by finer population counts.
FINE = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64 bits; bit set if set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), 42)
    hashes = np.fromiter((digest(b" ".join(x), 42) for x in zip(words, words[1:], words[2:], strict=False)), np.uint64, len(words) - 2)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, version (hash of the text, to tell rows of one id apart) and ``fp`` (64 bits as a long); no shuffle."""

    def factory():
        def step(cols):
            fps = np.fromiter(map(fingerprint, cols["text"].to_pylist()), np.uint64)
            return {id_col: cols["id"], "version": cols["version"], "fp": fps.view(np.int64)}

        return step

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return map_texts(source, factory, f"{id_col} {source.schema['id'].dataType.simpleString()}, version long, fp long")


def _counts(fps: np.ndarray, words: int) -> np.ndarray:
    """Population counts of the 1, 2, 4 or 8 equal words of each fingerprint."""
    bits = np.bitwise_count(fps.astype(">u8").view(np.uint8).reshape(-1, 8)).astype(np.int16)
    return bits.reshape(-1, words, 8 // words).sum(2)


def _split(fps: np.ndarray, index: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    counts, which = np.unique(_counts(fps[index], words), axis=0, return_inverse=True)
    order = np.argsort(which := which.ravel(), kind="stable")
    return list(zip(counts, np.split(index[order], np.cumsum(np.bincount(which))[:-1]), strict=True))


def _compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, words: int, join) -> None:
    """Calls ``join(i, j)`` with the positions within the radius, block by block."""
    if len(a) * len(b) > FINE and words < 8:
        left = _split(fps, a, 2 * words)
        right = left if a is b else _split(fps, b, 2 * words)
        centres = np.array([c for c, _ in right])
        for k, (c, own) in enumerate(left):
            for m in np.flatnonzero(np.abs(centres - c).sum(1) <= radius):
                if a is not b or m >= k:
                    _compare(fps, own, right[m][1], radius, 2 * words, join)
        return
    step = max(1, FINE // max(1, len(b)))
    for low in range(0, len(a), step):
        near = np.bitwise_count(fps[a[low : low + step], None] ^ fps[b][None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            join(a[low + i], b[j])


def links_within(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of two sides (or one, if side is all 0) to a spanning forest of links."""
    label = np.arange(len(fps))

    def join(i, j):
        while True:
            li, lj = label[i], label[j]
            apart = li != lj
            if not apart.any():
                return
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while not np.array_equal(label, up := label[label]):
                label[:] = up

    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    _compare(fps, a, b if len(b) else a, radius, 1, join)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """``fps`` (fp) to edges (a, b) that connect all distinct values within the radius.

    Only a spanning forest of each task is returned, never all pairs of a group. The driver sees
    the tiles' sizes, of which there are at most 83,521.
    """
    ship(fps.sparkSession)
    distinct = materialize(fps.select("fp").distinct())
    high = lambda bits, k: F.bit_count(F.shiftrightunsigned("fp", 64 - bits * (k + 1)).bitwiseAND((1 << bits) - 1))
    for words in (1, 2, 4):
        tile = [F.bit_count("fp")] if words == 1 else [high(64 // words, k) for k in range(words)]
        sizes = {tuple(r["tile"]): r["n"] for r in distinct.groupBy(F.array(*tile).alias("tile")).agg(F.count("*").alias("n")).collect()}
        if max(sizes.values(), default=0) <= cell:
            break
    cuts = {t: -(-n // cell) for t, n in sizes.items()}
    steps = [d for d in np.ndindex(*[2 * radius + 1] * words) if sum(abs(x - radius) for x in d) <= radius]
    steps = [tuple(x - radius for x in d) for d in steps]

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy()
            tiles = _counts(fp.view(np.uint64), words)
            keys, sides, rows = [], [], []
            for i, t in enumerate(map(tuple, tiles.tolist())):
                own = int(fp[i]) * 0x9E3779B97F4A7C15 % (1 << 64) * cuts[t] >> 64
                for d in steps:
                    other = tuple(x + y for x, y in zip(t, d, strict=True))
                    if other not in cuts:
                        continue
                    for k in range(cuts[other]):
                        here, there = (t, own), (other, k)
                        low, up = min(here, there), max(here, there)
                        keys.append(",".join(map(str, (*low[0], low[1], *up[0], up[1]))))
                        sides.append(int(here != low))
                        rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sides, pa.int32()), pa.array(fp[rows] if rows else [], pa.int64())], ["task", "side", "fp"])

    def compare(table):
        import pandas as pd

        a, b = links_within(table["fp"].to_numpy().view(np.uint64), table["side"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "task string, side int, fp long")
    return dealt.groupBy("task").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, version, fp, root (a component's smallest fingerprint) and component_id (smallest id reachable) for each row."""
    fps = materialize(fingerprints(docs, id_col, text_col))
    first = fps.groupBy("fp").agg(F.min(id_col).alias("first"))
    found = materialize(components(links(fps, radius)))
    known = first.join(found, first.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = known.join(least, "root").select("fp", "root", "component_id")
    return fps.join(classes, "fp", "left").select(id_col, "version", "fp", "root", "component_id")
