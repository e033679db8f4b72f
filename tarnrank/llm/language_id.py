"""Language identification by hyperdimensional profiles.

Each letter (and the gap between words) is a random vector of +1 and -1. A trigram is the product
of its letters' vectors, rotated by their places (binding); a text is the sum of its trigrams'
vectors (bundling); a language's prototype is the sum over its training texts. The language with
the largest cosine wins; ties go to the name that sorts first.

Rows: null text, or text without a letter, gets ``und`` and score 0; with nothing to learn from,
every text does. Whole texts of any length count. Repeated rows count and are returned each time.
Null ids are never held out of what they are asked for: they are learnt from like other rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

DIM, SEED, UND = 1024, 17, "und"
#: Trigram vectors kept in each worker (1 KB each): a bound on memory, not on input. Trigrams are bound in blocks of BLOCK.
CACHED, BLOCK = 30_000, 8_192
#: Texts bundled at once, and code points that are counted at once.
TEXTS, CODES = 64, 1 << 20


class Encoder:
    """Texts to hypervectors; the same seed gives the same vectors in every worker."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.keys, self.vectors = np.zeros(0, np.int64), np.zeros((0, dim), np.int8)
        self.lettered = _letters()

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dim, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams (three code points packed in 63 bits, 0 for a gap) and their counts.

        Counted piece by piece, with the two codes before each piece, so that a long text costs its
        own length and its distinct trigrams only.
        """
        text = text.lower()
        keys, counts, tail = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        for low in range(0, len(text) + 1, CODES):
            codes = np.frombuffer(text[low : low + CODES].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            codes = np.concatenate((tail[-1:], np.where(self.lettered[codes], codes, 0), [0] if low + CODES > len(text) else []))
            codes = np.concatenate((tail[:-1], codes[:1], codes[1:][(codes[1:] != 0) | (codes[:-1] != 0)])).astype(np.int64)
            tail = codes[-2:]
            if len(codes) > 2:
                own, n = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
                keys, at = np.unique(np.concatenate((keys, own)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        return keys, counts

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for sorted distinct trigrams, at most a block; unseen ones are bound and kept.

        Never more than CACHED and a block are held: what was kept goes before that.
        """
        at = np.searchsorted(self.keys, keys)
        new = keys[(at >= len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)] if len(self.keys) else keys
        if len(new):
            if len(self.keys) + len(new) > CACHED:
                self.keys, self.vectors, new = self.keys[:0], self.vectors[:0], keys
            if len(self.letters) > CACHED:
                self.letters = {}
            codes, at = np.unique(np.stack((new >> 42, new >> 21 & 0x1FFFFF, new & 0x1FFFFF)), return_inverse=True)
            letters, at = np.stack([self.letter(c) for c in codes.tolist()]), at.reshape(3, -1)
            made = np.roll(letters, 2, 1)[at[0]] * np.roll(letters, 1, 1)[at[1]] * letters[at[2]]
            order = np.argsort(both := np.concatenate((self.keys, new)))
            self.keys, self.vectors = both[order], np.concatenate((self.vectors, made))[order]
            at = np.searchsorted(self.keys, keys)
        return at

    def encode(self, texts: list[str], weight: bool = False) -> np.ndarray:
        """A hypervector for each text (float32); zero without letters. weight: each of unit counts."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for low in range(0, len(texts), TEXTS):
            found = [self.trigrams(t) for t in texts[low : low + TEXTS]]
            scale = [np.sqrt(float((c * c).sum())) if weight and len(c) else 1 for _, c in found]
            every = np.unique(np.concatenate([k for k, _ in found]))
            # a block of trigrams at a time: counts and vectors of no more are ever held
            for part in range(0, len(every), BLOCK):
                keys = every[part : part + BLOCK]
                counts = np.zeros((len(found), len(keys)), np.float32)
                for i, (k, c) in enumerate(found):
                    first, last = np.searchsorted(k, (keys[0], keys[-1] + 1))
                    counts[i, np.searchsorted(keys, k[first:last])] = c[first:last] / scale[i]
                at = self.rows(keys)
                out[low : low + TEXTS] += counts @ self.vectors[at].astype(np.float32)
        return out


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _table[0]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by language, from all rows with text and language.

    Each task bundles its rows, so one vector a language and task is shuffled, and one a language
    reaches the driver: languages x dim numbers, whatever the corpus.
    """

    def factory():
        encoder, sums = Encoder(dim, seed), {}

        def step(cols):
            by: dict[str, list[str]] = {}
            for lang, text in zip(cols["lang"].to_pylist(), cols["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                sums[lang] = sums.get(lang, 0) + encoder.encode(texts, weight=True).sum(0, dtype=np.float64)

        step.finish = lambda: {"lang": list(sums), "v": [np.round(v * 1024).astype(np.int64) for v in sums.values()]} if sums else None
        return step

    source = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    parts = map_texts(source, factory, "lang string, v array<long>")
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    out = {r["lang"]: np.array([x["x"] for x in r["v"]], np.float64) for r in rows}
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep_text: bool = False, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: its columns (its own of these names go), lang_pred, score (0 to 1).

    The text is among them with ``keep_text`` only.
    """
    langs = sorted(prototypes)
    unit = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in langs], np.float32).reshape(len(langs), dim)

    def factory():
        encoder = Encoder(dim, seed)

        def step(cols):
            vectors = encoder.encode([t or "" for t in cols["__text"].to_pylist()])
            norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
            if not langs:
                norm[:] = 0
            cosine = vectors @ unit.T if langs else np.zeros((len(vectors), 1))
            best = cosine.argmax(1)
            score = np.clip(cosine[np.arange(len(best)), best] / np.where(norm > 0, norm, 1), 0, 1)
            names = [langs[b] if n > 0 else UND for b, n in zip(best, norm, strict=True)]
            return {k: v for k, v in cols.items() if k != "__text"} | ({text_col: cols["__text"]} if keep_text else {}) | {"lang_pred": names, "score": np.where(norm > 0, score, 0.0)}

        return step

    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    source = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept] + [f"`{text_col}` string"] * keep_text)
    return map_texts(source, factory, f"{kinds}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text leaves 1 when divided by 3. Null: no."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
