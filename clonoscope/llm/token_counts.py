"""Token counts by heap-and-linked-list byte-pair merging; identifiers are never emitted.

A text is cut at the special strings (one token each), then by the byte-level pattern; in each piece the adjacent pair of
lowest rank is popped from a heap and merged in a linked list until none is left. The piece counts its symbols minus its
merges. Counts of short pieces are kept in a bounded memo in the worker; a long piece costs n log n and is not kept.

Defined results: null text counts as empty, with no tokens; repeated rows and null doc_ids are rows like others; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the memo: bytes of a piece, and pieces.
MEMO_BYTES, MEMO_PIECES = 64, 400_000


def printable_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Counter(dict):
    """Tokens of a piece of text, as a memo."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        self.symbols = [ids[c] for _, c in sorted(printable_bytes().items())]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall

    def merged(self, piece: bytes) -> int:
        n = len(piece)
        at = [self.symbols[b] for b in piece]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if found := self.merges.get((at[i], at[i + 1])):
                heap.append((found[0], i, at[i], at[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if at[i] != left or j < 0 or at[j] != right:
                continue  # one of the two has been merged since
            at[i], at[j] = made, -1
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if found := self.merges.get((made, at[k])):
                    heapq.heappush(heap, (found[0], i, made, at[k], found[1]))
            if (h := before[i]) >= 0 and (found := self.merges.get((at[h], made))):
                heapq.heappush(heap, (found[0], h, at[h], made, found[1]))
        return n - merges

    def __missing__(self, piece: str) -> int:
        count = self.merged(piece.encode())
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = count
        return count

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)


_counters: dict[int, Counter] = {}


def counter(vocabulary: bytes) -> Counter:
    """One counter per worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def token_count(docs: DataFrame, path: str, text: str = "text") -> Column:
    """The number of tokens of a column. The vocabulary file at path (bounded, a few MB) is broadcast."""
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(shared.value).count
        for batch in batches:
            yield pd.Series([count(x) if x else 0 for x in batch], dtype="int64")

    return counted(F.coalesce(F.col(text), F.lit("")))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select("doc_id", "text")
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(docs, path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
