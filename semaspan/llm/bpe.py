"""Byte-level BPE by longest matches and backtracking, with memoised compatibility of adjacent tokens.

A text is split by a pattern; the bytes of each piece are read as Latin-1, so that one automaton pass
gives the tokens that start at every byte. The encoder then walks left to right with the longest token
and steps back to shorter ones, or to the token before, until each two neighbours are compatible: two
tokens are compatible if merging their bytes by rank gives back just these two. Positions from which no
encoding goes on are marked, so a piece takes time linear in its bytes, however long it is. The result is
the one of merging by rank.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.llm.workers import remembers, tidied

# Pieces that a worker remembers in each of its two generations; a bound on memory, not on results.
REMEMBERED_PIECES = 150_000
REMEMBERED_PAIRS = 400_000
ROWS_AT_ONCE = 500  # texts whose ids are held before they go on


class Vocabulary:
    """Ranks, the automaton over reversed tokens, and how each token is made of two lower ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys()))
        self.above = max(ranks.values(), default=0) + 1
        self.length = {t: len(b) for b, t in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.starting, self.leading = ahocorasick.Automaton(), ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if self._learn(token, rank):
                self.starting.add_word(token[::-1].decode("latin-1"), rank)
                self.leading.add_word(token.decode("latin-1"), rank)
        self.starting.make_automaton()
        self.leading.make_automaton()
        for token, rank in ranks.items():
            self.shorter[rank] = next(
                (s for n in range(len(token) - 1, 0, -1) if (s := ranks.get(token[:n])) is not None and s in self.parts), None
            )
        self.recent, self.older = {}, {}

    def _learn(self, token: bytes, rank: int) -> bool:
        """Find the last merge of a token; false if merging by rank never ends in it."""
        if len(token) == 1:
            self.parts[rank] = (rank, rank)
            return True
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            if a in self.parts and b in self.parts and a < rank and b < rank and self._agree(a, b):
                self.parts[rank] = (a, b)
                self.merged[a, b] = rank
                return True
        return False

    def _agree(self, a: int, b: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges inside them.

        Undoes the latest merge of either token again and again and looks at what touches the border.
        """
        limit = self.above
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < limit:
                return False
            for right in (a <= b, a > b):  # the later of the two is undone, the other if that one is a byte
                if right:
                    part = self.parts[b][0]
                    if part != b:
                        limit, b = b + 1, part
                        break
                else:
                    part = self.parts[a][1]
                    if part != a:
                        limit, a = a, part
                        break
            else:
                return True

    def _remember(self, a: int, b: int) -> bool:
        if len(self.compatible) >= REMEMBERED_PAIRS:
            self.compatible.clear()
        self.compatible[a, b] = fits = self._agree(a, b)
        return fits

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size = len(piece)
        known, length, shorter = self.compatible, self.length, self.shorter
        out = [token for _, token in self.leading.iter_long(piece.decode("latin-1"))]
        if sum(map(length.__getitem__, out)) == size:
            for pair in zip(out, out[1:]):
                fits = known.get(pair)
                if not (self._remember(*pair) if fits is None else fits):
                    break
            else:  # the longest tokens one after the other are compatible, so there is nothing to step back from
                return tuple(out)
        longest: list[int | None] = [None] * (size + 1)
        last = size - 1
        for end, token in self.starting.iter(piece[::-1].decode("latin-1")):
            at = last - end  # the reversed match ends where the token starts; the longest one comes first
            if longest[at] is None:
                longest[at] = token
        out: list[int] = []
        open_ = bytearray(b"\x01") * (size + 1)
        at, before, token = 0, None, longest[0]
        while True:
            while token is not None:
                end = at + length[token]
                if open_[end]:
                    fits = True
                    if before is not None and (fits := known.get((before, token))) is None:
                        fits = self._remember(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                if end == size:
                    break
                at, before, token = end, token, longest[end]
            else:  # nothing fits here: this position is closed, the token before gets a shorter form
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else None
        return tuple(out)

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a text, as 32-bit numbers."""
        pieces = self.pieces(text)
        found = list(map(self.recent.get, pieces))
        if None in found:
            for i in [i for i, known in enumerate(found) if known is None]:
                found[i] = self._piece(pieces[i])
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def _piece(self, piece: str) -> bytes:
        known = self.recent.get(piece) or self.older.get(piece)
        if known is None:
            known = array("i", self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:  # longer ones seldom come again
            if len(self.recent) >= REMEMBERED_PIECES:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = known
        return known


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The tables of a rank file, once per worker."""
    return Vocabulary(ranks_of(path), pattern)


@lru_cache(maxsize=2)
def spellings(path: str) -> dict[int, bytes]:
    """The bytes of each token: all that decoding needs, so its workers hold no automata."""
    return {rank: token for token, rank in ranks_of(path).items()}


def forget() -> None:
    vocabulary.cache_clear()
    spellings.cache_clear()


remembers("bpe", forget)


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """Token ids of a whole text (array of int), without special tokens.

    path: a rank file that every executor has at the same place. Null and empty texts give an empty array.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path, pattern)
        for batch in tidied(batches, "bpe"):
            for part in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, len(batch), ROWS_AT_ONCE)):
                ids = [known.ids(value.as_py() or "") for value in part]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return encoded(text)


def spelled_out(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    """The bytes of each list of token ids, ROWS_AT_ONCE lists at once."""
    table = spellings(path)
    for batch in tidied(batches, "bpe"):
        for part in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, len(batch), ROWS_AT_ONCE)):
            ends = part.offsets.to_numpy()
            first = ends[0]
            flat = part.values.slice(first, ends[-1] - first).to_numpy().tolist()
            filled = zip((ends[:-1] - first).tolist(), (ends[1:] - first).tolist())
            yield pa.array([b"".join(map(table.__getitem__, flat[a:b])) for a, b in filled], pa.binary())


def decode(ids: Column | str, path: str, pattern: str) -> Column:
    """The bytes of an array of token ids (binary); null and empty arrays give no bytes."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from spelled_out(batches, path)

    return decoded(ids)


def with_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`docs` with the token ids of each text; a column that already has that name is replaced.

    Rows, their order inside a partition and all other columns stay. An empty table stays empty, repeated
    rows give repeated results. Texts are encoded one by one and whole.
    """
    return docs.withColumn(ids, encode(F.col(text), path, pattern))
