"""Byte-level BPE encoding and decoding in linear time.

A pre-token's bytes are read as Latin-1 so that an Aho-Corasick automaton over the vocabulary finds every token in it. From the
longest match at each position the encoder goes forward, and back to shorter matches when two neighbours could not have come out
of the merges side by side; whether they could is worked out from the merges once per pair and remembered. The result is the one
that merging by rank gives.

Defined cases: a null text is empty (no ids); repeated rows give one row each; other columns are ignored whatever their names;
an empty table gives an empty result. Texts are encoded whole; the memory needed is a few times the longest text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.batches import slices
from ocellus.llm.pretokens import split

#: What a worker remembers of pre-tokens, in bytes, in each of two generations: when the young one is full, it replaces the old one.
#: A pre-token counts with its text, 4 bytes an id and MEMO_ENTRY for the objects and their place in the table.
MEMO_BYTES, MEMO_ENTRY = 24 << 20, 170
#: Pairs of neighbours remembered, of about 130 bytes each.
MEMO_PAIRS = 150_000
#: Bytes of texts whose ids are held at once, at least one text's.
PIECE = 1 << 20
#: Ids take less than this many bits, so that a pair of them fits a small integer key.
ID_BITS = 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Token ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairCoder:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.joined: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.prefixes: dict[int, int | None] = {}
        self.sizes = [0] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.memo: dict[str, bytes] = {}  # ids as four bytes each
        self.older: dict[str, bytes] = {}
        self.held = 0
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._split_of(token, rank)

    def _split_of(self, token: bytes, rank: int) -> None:
        """Find the last merge that makes ``token``, if merging makes it at all."""
        self.parts[rank] = (rank, rank)
        for k in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
            if left is not None and right is not None and left < rank and right < rank and self._compatible(left, right):
                self.joined[left << ID_BITS | right], self.parts[rank] = rank, (left, right)
                return

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` apart when they stand side by side.

        Undoes the merges of the two from the latest to the first. The border must never have met a pair that merges before
        the piece at it was itself merged away.
        """
        latest = len(self.tokens) + 2**31
        while True:
            if self.joined.get(left << ID_BITS | right, latest) < latest:
                return False
            left_atom, right_atom = self.parts[left][0] == left, self.parts[right][0] == right
            if left_atom and right_atom:
                return True
            # The later of the two was made last; of equals the left one was made first.
            if right_atom or (not left_atom and left > right):
                latest, left = left, self.parts[left][1]
            else:
                latest, right = right + 1, self.parts[right][0]

    def _shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of token ``rank``."""
        if rank not in self.prefixes:
            token = self.tokens[rank]
            self.prefixes[rank] = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), None)
        return self.prefixes[rank]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, fits = len(piece), self.sizes, self.fits
        longest = [-1] * (n + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[rank]] = rank  # of one start, later ends come later
        open_at = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + sizes[token]
            if open_at[end]:
                key = last << ID_BITS | token
                fit = last < 0 or fits.get(key)
                if fit is None:
                    if len(fits) >= MEMO_PAIRS:
                        fits.clear()
                    fit = fits[key] = self._compatible(last, token)
                if fit:
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            shorter = self.prefixes.get(token, -1)
            token = self._shorter(token) if shorter == -1 else shorter
            if token is None:
                open_at[at] = 0  # no way on from here
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
        return out

    def _piece_bytes(self, piece: str) -> bytes:
        """Ids of a pre-token as four bytes each, remembered from now on."""
        ids = self.memo.get(piece)  # it may have come twice
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = array("i", self.encode_piece(piece.encode())).tobytes()
            if len(piece) <= 64:
                if self.held >= MEMO_BYTES:
                    self.memo, self.older, self.held = {}, self.memo, 0
                self.memo[piece] = ids
                self.held += MEMO_ENTRY + len(piece) + len(ids)
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text, each pre-token on its own, as four bytes each."""
        pieces = split(text)
        found = list(map(self.memo.get, pieces))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self._piece_bytes(pieces[i])
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return array("i", self.encode_bytes(text)).tolist()


@lru_cache(maxsize=1)
def coder(path: str) -> BytePairCoder:
    """The coder for a file of ranks, made once per process."""
    return BytePairCoder(read_ranks(path))


@lru_cache(maxsize=1)
def spellings(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What decoding needs of a file of ranks: the bytes of all tokens on end, and by id where a token begins and its length (-1: no
    such id)."""
    ranks = sorted(read_ranks(path).items(), key=lambda x: x[1])
    size = np.full(ranks[-1][1] + 1, -1, np.int64)
    size[[i for _, i in ranks]] = [len(b) for b, _ in ranks]
    return np.frombuffer(b"".join(b for b, _ in ranks), np.uint8), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), size


def decode_ids(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes that ``ids`` stand for."""
    flat, begin, size = spellings(path)
    n = size[ids]
    if (n < 0).any():
        raise ValueError("an id that stands for no token")
    before = np.cumsum(n) - n
    return flat[np.repeat(begin[ids] - before, n) + np.arange(int(n.sum()))]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for part in slices(batches, PIECE):
            ids = [own.encode_bytes(text) if text else b"" for text in part.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes its ids stand for; null ids stand for none. An unknown or null id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                back = [decode_ids(x.values.to_numpy(), path).tobytes() if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(back, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")
