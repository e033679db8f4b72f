"""Word-piece lengths by a linear longest-match automaton.

A trie of the vocabulary's pieces (word starts, and continuations below a second root) carries
failure links: where a byte does not continue the piece being read, the link gives the state after
the longest pieces that end before have been taken off, and the number of those is stored with it.
One pass over a word then counts its greedy longest-match pieces without building any.

Rows: null text is the empty text with no words; repeated rows are returned each time; null ids are
kept; words of any length are read whole. A word that no pieces cover counts as one unknown token.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Words kept counted in each of a worker's two generations, and the longest kept: a bound on memory.
CACHED_WORDS, CACHED_LENGTH = 500_000, 64
UNKNOWN = -1


def pieces_of_ranks(data: bytes) -> tuple[list[bytes], list[bytes]]:
    """Word starts and continuations from a ``.tiktoken`` rank file: tokens after a blank start words, and so does any single byte."""
    tokens = [base64.b64decode(line.split()[0]) for line in data.splitlines() if line]
    rest = [t for t in tokens if t[:1] != b" "]
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1] + [t for t in rest if len(t) == 1], rest


class Automaton:
    """Counts greedy longest-match pieces of a word in one pass over its bytes."""

    def __init__(self, starts: list[bytes], rest: list[bytes]):
        goto: dict[int, int] = {}
        nodes = [(0, 0), (0, 0)]  # (parent, byte); 0: word start, 1: continuation
        whole = set()
        for root, words in ((0, starts), (1, rest)):
            for word in words:
                at = root
                for byte in word:
                    key = at << 8 | byte
                    if key not in goto:
                        goto[key] = len(nodes)
                        nodes.append((at, byte))
                    at = goto[key]
                if at > 1:
                    whole.add(at)
        self.goto, self.link, self.popped = goto, [-1] * len(nodes), [0] * len(nodes)
        depth = [0] * len(nodes)
        for node in range(2, len(nodes)):  # parents come before children
            depth[node] = depth[nodes[node][0]] + 1
        for node in sorted(range(2, len(nodes)), key=depth.__getitem__):
            parent, byte = nodes[node]
            if node in whole:
                self.link[node], self.popped[node] = 1, 1
                continue
            at, count = self.link[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in goto:
                count += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = goto[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Pieces of a word of one byte or more, UNKNOWN if they do not cover it."""
        goto, link, popped = self.goto, self.link, self.popped
        at = count = 0
        for byte in word:
            while (to := goto.get(at << 8 | byte)) is None:
                if link[at] < 0:
                    return UNKNOWN
                count += popped[at]
                at = link[at]
            at = to
        while at != 1:
            if link[at] < 0:
                return UNKNOWN
            count += popped[at]
            at = link[at]
        return count


class _Counts(dict):
    """Word to its number of pieces, filled on first use."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: bytes) -> int:
        found = self.older.get(word)
        if found is None:
            found = self.automaton.count(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens (unknown words count one each), n_unknown for each row; no shuffle."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def factory():
        counts = _Counts(_loaded(ranks))

        def step(cols):
            words, tokens, unknown = [], [], []
            for text in cols["text"].to_pylist():
                own = (text or "").encode("utf-8", "surrogatepass").split()
                n = np.fromiter(map(counts.__getitem__, own), np.int64, len(own))
                missed = int((n == UNKNOWN).sum())
                words.append(len(own))
                tokens.append(int(n.sum()) + 2 * missed)
                unknown.append(missed)
            return {id_col: cols["id"], "n_words": words, "n_tokens": tokens, "n_unknown": unknown}

        return step

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(source, factory, f"{id_col} {source.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


_held: list = []


def _loaded(ranks) -> Automaton:
    """One automaton for each worker process."""
    if not _held or _held[0] is not ranks.value:
        _held[:] = [ranks.value, Automaton(*pieces_of_ranks(ranks.value))]
    return _held[1]
