"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the encoding
of ``x`` is that of a shorter prefix plus one token ``t``, where ``t`` and the token before it stay
apart when their joint bytes are merged. Storing that last token for every prefix gives the encoding
by walking back, lets bytes be appended without touching what is stored, and confines re-encoding
after an edit to the stretch until the stored tokens agree again.

Rows: null text is the empty text; no tokens give the hash of nothing; a repeated row is encoded
again; whole texts are encoded whatever their length; columns other than the two named are dropped.
"""

from __future__ import annotations

import array
import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Pieces kept encoded in each of a worker's two generations, and the longest piece kept: a bound on
#: memory, not on input.
CACHED_PIECES, CACHED_LENGTH = 250_000, 64
#: Steps of the automaton and tested pairs of tokens kept in each worker.
CACHED_STEPS = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a ``.tiktoken`` file: base64 of the token, blank, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixBPE:
    """Encodes pieces by ranks; ``tokens[id]`` are a token's bytes.

    A trie of the tokens with failure links gives, byte by byte, the tokens that end there.
    """

    def __init__(self, ranks: dict[bytes, int], steps: int = CACHED_STEPS):
        self.ranks, self.steps = ranks, steps
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._apart: dict[int, bool] = {}
        self._goto: dict[int, int] = {}
        self._step: dict[int, int] = {}
        own, self._fail = [-1], [0]
        for token, i in ranks.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                if key not in self._goto:
                    self._goto[key] = len(own)
                    own.append(-1)
                    self._fail.append(0)
                state = self._goto[key]
            own[state] = i
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in self._goto.items():
            below.setdefault(key >> 8, []).append((key & 255, state))
        self._ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)  # tokens and their lengths
        level = [0]
        while level:
            level = [(parent, byte, state) for parent in level for byte, state in below.get(parent, ())]
            for parent, byte, state in level:
                self._fail[state] = self._next(self._fail[parent], byte) if parent else 0
                self._ends[state] = (((own[state], self.size[own[state]]),) if own[state] >= 0 else ()) + self._ends[self._fail[state]]
            level = [state for _, _, state in level]

    def _next(self, state: int, byte: int) -> int:
        """The state after a byte, followed along failure links and kept."""
        key, at = state << 8 | byte, state
        found = self._step.get(key)
        if found is None:
            while (found := self._goto.get(at << 8 | byte)) is None and at:
                at = self._fail[at]
            if len(self._step) > self.steps:
                self._step.clear()
            self._step[key] = found = found or 0
        return found

    def _merged(self, data: bytes) -> list[int]:
        """Merging as defined: the adjacent pair of lowest rank first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: nothing) in an encoding."""
        key = before << 32 | token
        known = self._apart.get(key)
        if known is None:
            own = [token] if before < 0 else [before, token]
            known = self._merged(b"".join(self.tokens[i] for i in own)) == own
            if len(self._apart) > self.steps:
                self._apart.clear()
            self._apart[key] = known
        return known

    def extend(self, data: bytes | bytearray, last: list[int], upto: int | None = None) -> None:
        """Fills ``last`` (``last[i]``: the token that ends the prefix of i + 1 bytes) to ``upto``."""
        step, ends, known = self._step.get, self._ends, self._apart.get
        state, end = 0, len(last)
        for byte in data[max(0, end - self.longest) : end]:
            state = self._next(state, byte)
        for byte in data[end : len(data) if upto is None else upto]:
            end += 1
            to = step(state << 8 | byte)
            state = self._next(state, byte) if to is None else to
            for token, size in ends[state]:
                before = last[end - size - 1] if end > size else -1
                fits = known(before << 32 | token)
                if self.apart(before, token) if fits is None else fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the ranks lack a byte")

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token is that token, as in the public library."""
        if data in self.ranks:
            return [self.ranks[data]]
        last: list[int] = []
        self.extend(data, last)
        return self.walk(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The stored prefixes of one piece, for appends and edits. ``ids()`` is its encoding."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(data), []
        bpe.extend(self.data, self.last)

    def append(self, more: bytes) -> None:
        """Adds bytes; what is stored stays right, as prefixes do not look ahead."""
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of bytes start to end; returns how many prefixes were computed.

        A prefix looks back by one token and by that token's predecessor, so once as many
        consecutive prefixes as the longest token agree with those stored, all later ones do.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data[start:end] = new
        self.last, alike, at = old[:start], 0, start
        while at < len(self.data):
            at += 1
            self.bpe.extend(self.data, self.last, at)
            was = at - 1 - shift
            alike = alike + 1 if at - 1 >= start + len(new) and old[was] == self.last[-1] else 0
            if alike >= self.bpe.longest:
                self.last += old[was + 1 :]
                break
        return at - start

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class _Pieces(dict):
    """Piece to its ids packed as little-endian 32-bit integers, filled on first use."""

    def __init__(self, bpe: PrefixBPE, most: int = CACHED_PIECES):
        self.bpe, self.older, self.most = bpe, {}, most

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array.array("I", self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, cached: int = CACHED_PIECES, steps: int = CACHED_STEPS
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, with ``keep_ids`` also ids.

    The ids are decoded again and the hash of the decoded bytes is returned, so equality with the
    hash of the text shows the round trip. No shuffle; the rank file goes to each worker as a
    broadcast of its bytes (the vocabulary's size, whatever the corpus). cached, steps: what a worker
    keeps of encoded pieces and of the automaton; less takes longer and gives the same ids.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def factory():
        import regex

        pieces = _loaded(ranks, cached, steps)
        bpe, find = pieces.bpe, regex.compile(pattern).findall
        tokens = [bpe.tokens.get(i, b"") for i in range(max(bpe.tokens) + 1)]

        def step(cols):
            n, a, b, kept = [], [], [], []
            for text in cols["text"].to_pylist():
                packed = b"".join(map(pieces.__getitem__, find(text or "")))
                ids = array.array("I", packed)
                n.append(len(ids))
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(packed, "<u4").astype(np.int32))
            out = {id_col: cols["id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
            return out | ({"ids": kept} if keep_ids else {})

        return step

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return map_texts(source, factory, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


_held: list = []


def _loaded(ranks, cached: int, steps: int) -> _Pieces:
    """One vocabulary and one cache for each worker process, whatever tasks it runs."""
    key = [len(ranks.value), hash(ranks.value), cached, steps]
    if _held[:-1] != key:
        _held[:] = [*key, _Pieces(PrefixBPE(read_ranks(ranks.value), steps), cached)]
    return _held[-1]
