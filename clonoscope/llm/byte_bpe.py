"""Byte-level BPE encoding and decoding over an Aho-Corasick automaton, in time linear in the text.

Bytes are mapped to Latin-1 characters so that an automaton over strings can hold the vocabulary. It gives the longest token
that starts at a byte. The encoder goes from longest match to longest match; a token may follow another
only if merging could not have produced anything else across their border (a compatibility that is decided by undoing
merges, and memoised per pair), else it is shortened, and where no shorter one is left the token before is taken back. The first
chain that gets through is the one the ranked merges give. Longest tokens that the first chain of longest matches passes over are
only looked for where a shortened token leads there.

Defined results: null text counts as empty, with no tokens; repeated rows and null doc_ids are rows like others; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the memos: characters of a piece, pieces (of each of two memos), and pairs of tokens.
MEMO_CHARS, MEMO_PIECES, MEMO_PAIRS = 64, 200_000, 300_000


class Codec(dict):
    """Packed identifiers (unsigned 32-bit, little-endian) of a piece of text, as a memo."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        order = sorted(self.ranks, key=self.ranks.get)
        self.ranked = [self.ranks[t] for t in order]  # by place in the order of merging
        self.tokens, self.lengths = order, [len(t) for t in order]
        place = {t: i for i, t in enumerate(order)}
        self.place = place
        self.bytes_of = {self.ranks[t]: t for t in order}
        self.automaton = ahocorasick.Automaton()
        for t, i in place.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        # shorter[i]: the longest token that is a proper prefix of token i, or -1.
        self.shorter = [next((place[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in place), -1) for t in order]
        self.halves = [(i, i) for i in range(len(order))]
        self.joined: dict[tuple[int, int], int] = {}
        for i, t in enumerate(order):
            left = self.shorter[i]
            while left >= 0:
                right = place.get(t[self.lengths[left]:], i)
                if left < i and right < i and self.undone(left, right):
                    self.halves[i], self.joined[left, right] = (left, right), i
                    break
                left = self.shorter[left]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.before: dict[str, bytes] = {}  # the memo that the present one follows: frequent pieces outlive it
        self.pieces = regex.compile(pattern).findall

    def undone(self, left: int, right: int) -> bool:
        """True if merging leaves a border between these two: undo the later merge on either side, step by step; no pair
        across the border may have been merged before."""
        latest = len(self.halves)
        while True:
            if self.joined.get((left, right), latest) < latest:
                return False
            # The token made last is the first to be undone; at equal age the left one was merged first.
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.halves[left][1] != left:
                    latest, left = left, self.halves[left][1]
                    break
                if side == "right" and self.halves[right][0] != right:
                    latest, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.undone(left, right)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Identifiers of one piece, which the pattern has cut out."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if not piece:
            return []
        text = piece.decode("latin-1")
        # Longest match after longest match; most of the time the pairs of a short chain fit.
        chain = [i for _, i in self.automaton.iter_long(text)]
        lengths, shorter, pairs, fits = self.lengths, self.shorter, self.pairs, self.fits
        n, at, good, last = len(piece), 0, 0, -1
        longest: dict[int, int] = {}  # by place, as far as known
        for i in chain:
            longest[at] = i
            at += lengths[i]
        if at != n:
            raise ValueError("the vocabulary lacks a byte")
        for i in chain:
            if last >= 0 and not (pairs.get((last, i)) or fits(last, i)):
                break
            last = i
            good += 1
        else:
            return [self.ranked[i] for i in chain]
        token = chain[good]
        del chain[good:]
        at = sum([lengths[i] for i in chain])
        closed = set()  # places from which no way forward is left
        while at < n:
            last = chain[-1] if chain else -1
            while token >= 0 and (at + lengths[token] in closed or not (last < 0 or pairs.get((last, token)) or fits(last, token))):
                token = shorter[token]
            if token >= 0:
                chain.append(token)
                at += lengths[token]
                if at < n:
                    token = longest.get(at, -1)
                    if token < 0:
                        token = longest[at] = next(self.automaton.iter_long(text, at))[1]
            elif chain:
                closed.add(at)
                token = chain.pop()
                at -= lengths[token]
            else:
                raise ValueError("the vocabulary lacks a byte")
        return [self.ranked[i] for i in chain]

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.pop(piece, None)
        if packed is None:
            ids = self.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def unpacked(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[int, Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = hash((ranks_file, pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def forget() -> None:
    """Frees the worker's codec, when other stages follow in the same worker."""
    _codecs.clear()


def shared_ranks(docs: DataFrame, path: str | None = None):
    """The vocabulary file (bounded, under a few MB) as a broadcast."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return docs.sparkSession.sparkContext.broadcast((file.read(), public_tokenizers.PATTERN))


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> Column:
    """The identifiers of a text column, packed as little-endian unsigned 32-bit integers."""
    shared = shared_ranks(docs, path)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(*shared.value)
        for batch in batches:
            yield pd.Series([own.packed(x) if x else b"" for x in batch], dtype=object)

    return encode(F.coalesce(F.col(text), F.lit("")))


def decoded(docs: DataFrame, packed: str, path: str | None = None) -> Column:
    """The bytes that a column of packed identifiers stands for."""
    shared = shared_ranks(docs, path)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(*shared.value)
        for batch in batches:
            yield pd.Series([own.unpacked(x) if x else b"" for x in batch], dtype=object)

    return decode(F.coalesce(F.col(packed), F.lit(b"")))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text)."""
    shared = shared_ranks(docs, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(*shared.value)
        for batch in batches:
            rows = []
            for x in batch:
                packed = own.packed(x) if x else b""
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.unpacked(packed)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64"})

    return docs.select("doc_id", both(F.coalesce(F.col("text"), F.lit(""))).alias("made")).select("doc_id", "made.*")
