"""Removal of repeated substrings by suffix arrays.

Each byte is removed that a string of LENGTH bytes covers which also starts in a document with a smaller doc_id. All occurrences of a
string must meet in one suffix array, and no task may hold them all, so windows are dealt out by content: the k-gram of smallest hash
in a window (its minimizer) is the same wherever the window occurs. Neighbouring windows with one minimizer are one piece of text.

1. Texts are packed into batches (a table of compressed rows). Minimizers of each batch go to partitions by hash, which answer for each if
   another text has it, too, and for each text if it is a copy of one with a smaller doc_id.
2. The pieces of shared minimizers go to partitions, each distinct one of a batch once with its smallest doc_id. There equal pieces are
   merged; where a minimizer has several, they are joined into a string, the k-gram that all have as one symbol, and sorted as
   suffixes (suffix_order). Suffixes next to each other with the same LENGTH bytes are one window; its smallest doc_id is the answer.
   A minimizer that many batches have is dealt out window by window, by the windows' own hashes, so it never makes one large string.
3. Each batch marks the bytes of windows that a smaller doc_id has, and is emitted per document.

Defined results: null text counts as empty; texts under LENGTH bytes lose nothing; rows with the same doc_id don't take from each
other, so repeated rows get the same result; a null doc_id comes after all others; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .suffix_order import suffix_arrays

#: Bytes of a repeated string, of a minimizer, and of the text in a batch.
LENGTH, GRAM, BATCH = 50, 24, 2 << 20
#: Bytes of text for which there is one partition, the least number of them, and batches from which a minimizer is dealt out by windows.
PER_PART, LEAST_PARTS, HOT = 48 << 20, 64, 256
#: Places that are hashed at once; what stands for the place of the k-gram in a window that is dealt out by itself.
STRETCH, WINDOW = 1 << 14, 255
LAST = np.iinfo(np.int64).max
SPAN = LENGTH - GRAM + 1  # k-grams of a window
HALF = (LENGTH - GRAM) // 2  # a window has so many bytes at least before or after its minimizer


class Dealt:
    """Numbers by partition."""

    def __init__(self, part: np.ndarray, parts: int):
        part = part.astype(np.uint16) if parts < 1 << 16 else part  # sorted by counting
        self.order = np.argsort(part, kind="stable")
        self.bounds = np.searchsorted(part[self.order], np.arange(parts + 1, dtype=part.dtype))

    def __getitem__(self, p: int) -> np.ndarray:
        return self.order[self.bounds[p] : self.bounds[p + 1]]

    def there(self) -> list[int]:
        return np.flatnonzero(np.diff(self.bounds)).tolist()


def packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([x.nbytes for x in arrays], "<i8")
    return zstandard.compress(b"".join([sizes.tobytes(), *(x.tobytes() for x in arrays)]), 1)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, "<i8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(b) - GRAM + 1
    part = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part ^= part >> np.uint64(29)
    width, at, out, rest = 1, 0, None, GRAM
    while rest:  # doubling the width, and taking the widths that GRAM is made of
        if rest & 1:
            out = part[at : at + n].copy() if out is None else out * np.uint64(0x94D049BB133111EB) + part[at : at + n]
            at += width
        rest >>= 1
        if rest:
            part = part[:-width] * np.uint64(0xBF58476D1CE4E5B9) + part[width:]
            part ^= part >> np.uint64(31)
            width *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def runs(b: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer, in texts that lie in b from starts to ends: first and last window, place and hash of
    the minimizer, and the text."""
    none = np.empty(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, none.astype(np.uint64), none
    n = len(b) - GRAM + 1
    windows = n - SPAN + 1
    h, least = np.empty(n, np.uint64), np.empty(windows, np.int64)
    for lo in range(0, n, STRETCH):  # so many places at once that they stay in the processor's cache
        h[lo : lo + STRETCH] = gram_hashes(b[lo : lo + STRETCH + GRAM - 1])
    for lo in range(0, windows, STRETCH):
        key = h[lo : lo + STRETCH + SPAN - 1] >> np.uint64(32) << np.uint64(32)
        key |= np.arange(len(key), dtype=np.uint64)
        # The least of so many keys from each place on, doubling their number; the last two overlap.
        width = 1
        while width * 2 <= SPAN:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])
        least[lo : lo + STRETCH] = (key & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
    ok = np.zeros(len(b) + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - LENGTH + 1, -1)
    ok = np.cumsum(ok[:windows]).astype(bool)
    change = np.ones(windows, bool)
    change[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], windows) - 1
    good = ok[first]
    first, last = first[good], last[good]
    place = least[first]
    return first, last, place, h[place], np.searchsorted(ends, first, side="right")


def batches_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in batches: (batch, data); data: ids, flags of null ids, lengths, bytes."""

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, texts, size, number = [], [], 0, 0
        part = TaskContext.get().partitionId()

        def out() -> pd.DataFrame:
            null = np.array([pd.isna(x) for x in ids])
            own = np.array([LAST if z else int(x) for x, z in zip(ids, null, strict=True)], np.int64)
            data = packed(own, null, np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
            return pd.DataFrame({"batch": [part << 32 | number], "data": [data]})

        for frame in frames:
            for i, t in zip(frame["doc_id"].astype(object), frame["text"], strict=True):
                t = t.encode("utf-8", "replace") if t else b""
                if texts and size + len(t) > BATCH:
                    yield out()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(gathered, "batch long, data binary")


class Batch:
    """A batch as its partitions see it: the same in every pass."""

    def __init__(self, data: bytes):
        self.ids, self.null, sizes, self.bytes = unpacked(data, "i8", "?", "i8", "u1")
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        raw = self.bytes.tobytes()
        self.texts = [raw[a:z] for a, z in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        digests = [xxhash.xxh3_128_digest(t) for t in self.texts]
        least: dict[bytes, int] = {}
        for d, i in zip(digests, self.ids.tolist(), strict=True):
            least[d] = min(i, least.get(d, LAST))
        # Copies of a text with a smaller doc_id in the batch, and of equal texts all but the first row with the smallest doc_id, which
        # stands for them.
        self.copy = np.array([least[d] < i for d, i in zip(digests, self.ids.tolist(), strict=True)], bool)
        stands: dict[bytes, int] = {}
        for t, d in enumerate(digests):
            if self.ids[t] == least[d]:
                stands.setdefault(d, t)
        self.stands = [stands[d] for d in digests]
        self.again = np.array([f != t for t, f in enumerate(self.stands)], bool)
        self.digests = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        self.raw = raw
        self.least = np.array([least[d] for d in digests], np.int64)

    def find(self) -> None:
        self.first, self.last, self.place, self.hash, self.text = runs(self.bytes, self.ends, self.starts)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, ascending; whether several texts of the batch have it; one text; of each run the hash's number (0 in rows that
        another one stands for)."""
        mine = np.flatnonzero(~self.again[self.text])
        order = mine[np.argsort(self.hash[mine])]
        h, t = self.hash[order], self.text[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        heads = np.flatnonzero(head)
        if not len(heads):
            return h[:0], np.zeros(0, bool), t[:0], np.zeros(len(self.hash), int)
        several = np.minimum.reduceat(t, heads) != np.maximum.reduceat(t, heads)
        number = np.zeros(len(self.hash), int)
        number[order] = np.cumsum(head) - 1
        return h[heads], several, t[heads], number

    def pieces(self, shared: np.ndarray, hot: np.ndarray, number: np.ndarray, dead: np.ndarray, parts: int):
        """Distinct pieces of runs whose minimizer is shared, in texts that aren't dead: for each its bytes, where its k-gram is (WINDOW:
        a single window that was dealt out by its own hash), its partition, the smallest doc_id; and for each occurrence text, place and piece."""
        use = np.flatnonzero(shared[number] & ~dead[self.text] & ~self.again[self.text]) if len(number) else np.empty(0, int)
        first, last, place, text = self.first[use], self.last[use], self.place[use], self.text[use]
        part = (self.hash[use] >> np.uint64(7)) % np.uint64(parts)
        is_hot = hot[number[use]] if len(use) else np.zeros(0, bool)
        if is_hot.any():  # one piece per window
            count = np.where(is_hot, last - first + 1, 1)
            own = np.repeat(np.arange(len(use)), count)
            step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            first, last = first[own] + step, np.where(is_hot[own], first[own] + step, last[own])
            place, text, part, is_hot = place[own], text[own], part[own], is_hot[own]
        raw = self.raw
        known: dict[bytes, int] = {}
        piece = np.array([known.setdefault(raw[a:z], len(known)) for a, z in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], np.int64)
        n = len(known)
        grams, where, least = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, LAST)
        grams[piece], where[piece] = place - first, part
        np.minimum.at(least, piece, self.ids[text])
        if is_hot.any():
            names = list(known)
            for k in np.unique(piece[is_hot]).tolist():
                where[k], grams[k] = xxhash.xxh64_intdigest(names[k]) % parts, WINDOW
        return list(known), grams, where, least, text, first, piece


def asked(frames: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """For each partition the minimizers and the texts of a batch."""
    for frame in frames:
        for batch, data in zip(frame["batch"], frame["data"], strict=True):
            own = Batch(data)
            own.find()
            h, several, text, _ = own.minimizers()
            dealt = Dealt((h >> np.uint64(7)) % np.uint64(parts), parts)
            told = np.flatnonzero(~own.again)
            texts_dealt = Dealt(own.digests[told, 0] % np.uint64(parts), parts)
            rows = []
            for p in sorted({*dealt.there(), *texts_dealt.there()}):
                i, j = dealt[p], told[texts_dealt[p]]
                if len(i) or len(j):
                    texts, own_text = np.unique(text[i], return_inverse=True)
                    key = (h[i] >> np.uint64(32)).astype(np.uint32)
                    rest = (h[i] & np.uint64(0xFFFF)).astype(np.uint16)  # with p, 48 bits and more tell hashes apart
                    rows.append((p, batch, packed((key >> 16).astype(np.uint16), key.astype(np.uint16), rest, several[i], own_text.astype(np.uint32), own.digests[texts].ravel(), own.digests[j].ravel(), own.least[j])))
            yield pd.DataFrame(rows, columns=["part", "batch", "data"]).astype({"part": "int32", "batch": "int64"})


def answered(frame: pd.DataFrame, hot: int) -> pd.DataFrame:
    """Of one partition: which of each batch's minimizers other texts have, which are hot, and which texts are copies."""
    rows = [unpacked(d, "u2", "u2", "u2", "?", "u4", "u8", "u8", "i8") for d in frame["data"]]
    key = np.concatenate([np.uint64(1 << 32) * a.astype(np.uint64) + np.uint64(1 << 16) * b.astype(np.uint64) + c.astype(np.uint64) for a, b, c, *_ in rows])
    several = np.concatenate([r[3] for r in rows])
    names = np.concatenate([r[5].reshape(-1, 2)[r[4]] for r in rows])
    order = np.argsort(key, kind="stable")
    head = np.ones(len(key), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(head)
    shared, is_hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(heads):
        sorted_names = names[order]
        differ = np.zeros(len(heads), bool)
        for column in (0, 1):
            x = sorted_names[:, column]
            differ |= np.minimum.reduceat(x, heads) != np.maximum.reduceat(x, heads)
        differ |= np.logical_or.reduceat(several[order], heads)
        count = np.diff(np.append(heads, len(key)))
        shared[order], is_hot[order] = np.repeat(differ, count), np.repeat(count >= hot, count)
    digests = np.concatenate([r[6].reshape(-1, 2) for r in rows])
    ids = np.concatenate([r[7] for r in rows])
    least: dict[bytes, int] = {}
    pairs = [d.tobytes() for d in digests]
    for d, i in zip(pairs, ids.tolist(), strict=True):
        least[d] = min(i, least.get(d, LAST))
    best = np.array([least[d] for d in pairs], np.int64)
    a = np.cumsum([0, *(len(r[3]) for r in rows)])
    z = np.cumsum([0, *(len(r[7]) for r in rows)])
    out = [packed(np.packbits(shared[a[k] : a[k + 1]]), np.packbits(is_hot[a[k] : a[k + 1]]), best[z[k] : z[k + 1]]) for k in range(len(rows))]
    return pd.DataFrame({"batch": frame["batch"], "part": frame["part"], "reply": out})


def understood(own: Batch, replies: list, parts: int) -> tuple[np.ndarray, ...]:
    """shared and hot per minimizer, the number of each run's, and the smallest doc_id with each text."""
    own.find()
    h, _, _, number = own.minimizers()
    dealt = Dealt((h >> np.uint64(7)) % np.uint64(parts), parts)
    shared, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    told = np.flatnonzero(~own.again)
    texts_dealt = Dealt(own.digests[told, 0] % np.uint64(parts), parts)
    best = {}
    for r in replies:
        i, j = dealt[r["part"]], told[texts_dealt[r["part"]]]
        a, b, least = unpacked(r["reply"], "u1", "u1", "i8")
        shared[i], hot[i] = np.unpackbits(a)[: len(i)], np.unpackbits(b)[: len(i)]
        best.update((own.digests[t].tobytes(), x) for t, x in zip(j.tolist(), least.tolist(), strict=True))
    return shared, hot, number, np.array([best[d.tobytes()] for d in own.digests], np.int64)


def sent(frames: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """For each partition the distinct shared pieces of a batch; as partition -1 where in the batch they are, for `covered`."""
    for frame in frames:
        for batch, data, replies in zip(frame["batch"], frame["data"], frame["replies"], strict=True):
            own = Batch(data)
            shared, hot, number, best = understood(own, replies, parts)
            dead = best < own.ids
            pieces, grams, where, least, text, place, piece = own.pieces(shared, hot, number, dead, parts)
            rows = [(-1, batch, packed(dead, where, text.astype(np.uint32), place, piece.astype(np.uint32)))]
            dealt = Dealt(where, parts)
            for p in dealt.there():
                k = dealt[p]
                some = [pieces[x] for x in k.tolist()]
                sizes = np.array([len(x) for x in some], np.uint8)
                rows.append((p, batch, packed(sizes, grams[k].astype(np.uint8), least[k], np.frombuffer(b"".join(some), np.uint8))))
            yield pd.DataFrame(rows, columns=["part", "batch", "data"]).astype({"part": "int32", "batch": "int64"})


def window_minima(pieces: list[bytes], gram: np.ndarray, least: np.ndarray, windows: np.ndarray, groups: list[list[int]]) -> tuple[np.ndarray, ...]:
    """For the pieces of groups (pieces with one minimizer) runs of windows: piece, length, and the smallest doc_id that has them."""
    every = np.concatenate([np.array(g) for g in groups])
    raw = np.frombuffer(b"".join([pieces[k] for k in every.tolist()]), np.uint8)
    sizes = windows[every] + LENGTH - 1
    starts_of = np.cumsum(sizes) - sizes
    # Bytes as symbols from 2 on, the common k-gram as one symbol, a separator 1 after each piece, an end 0 after each group.
    keep = np.ones(len(raw), bool)
    core = starts_of + gram[every]
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, core + 1, 1)
    np.add.at(inside, core + GRAM, -1)
    keep &= np.cumsum(inside[:-1]) == 0
    symbol = raw.astype(np.int64) + 2
    symbol[core] = 300
    last_of_group = np.zeros(len(every), bool)
    last_of_group[np.cumsum([len(g) for g in groups]) - 1] = True
    length = sizes - GRAM + 1
    room = length + 1 + last_of_group
    at = np.cumsum(room) - room
    symbols = np.ones(int(room.sum()), np.int64)
    symbols[(at + room - 1)[last_of_group]] = 0
    places = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())
    symbols[places] = symbol[keep]
    owner, place = np.full(len(symbols), -1), np.zeros(len(symbols), np.int64)
    owner[places] = np.repeat(np.arange(len(every)), length)
    place[places] = places - np.repeat(at, length)
    starts = at[np.append(True, last_of_group[:-1])]
    order = suffix_arrays(symbols, starts)
    # Suffixes at which a window starts, in order; neighbours with the same SPAN symbols are the same window.
    order = order[(owner[order] >= 0) & (place[order] < windows[every][owner[order]])]
    view = np.lib.stride_tricks.sliding_window_view(np.append(symbols, np.zeros(SPAN, np.int64)).astype(np.int16), SPAN)
    head = np.ones(len(order), bool)
    string = np.searchsorted(starts, order, side="right")
    step = 1 << 16
    for lo in range(1, len(order), step):
        x, y = order[lo : lo + step], order[lo - 1 : lo - 1 + len(order[lo : lo + step])]
        head[lo : lo + step] = (view[x] != view[y]).any(axis=1) | (string[lo : lo + step] != string[lo - 1 : lo - 1 + len(x)])
    heads = np.flatnonzero(head)
    ids = least[every][owner[order]]
    best = np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.append(heads, len(order))))
    by = np.lexsort((place[order], owner[order]))
    best, who = best[by], owner[order][by]
    heads = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (best[1:] != best[:-1])))
    return every[who[heads]], np.diff(np.append(heads, len(who))), best[heads]


def kin(pieces: list[bytes], grams: list[int], group: list[int]) -> list[int]:
    """Of pieces with one minimizer those that may share a window: a window has HALF bytes at least on one side of the minimizer, so
    another one must have the same HALF bytes there."""
    sides = []
    count: dict[tuple[bool, bytes], int] = {}
    for k in group:
        piece, g = pieces[k], grams[k]
        own = []
        if g >= HALF:
            own.append((True, piece[g - HALF : g]))
        if len(piece) >= g + GRAM + HALF:
            own.append((False, piece[g + GRAM : g + GRAM + HALF]))
        for x in own:
            count[x] = count.get(x, 0) + 1
        sides.append(own)
    return [k for k, own in zip(group, sides, strict=True) if any(count[x] > 1 for x in own)]


def sorted_out(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: for each batch's pieces runs of windows and the smallest doc_id that has them."""
    known: dict[bytes, int] = {}
    rows, all_grams, all_ids = [], [], []
    for data in frame["data"]:
        sizes, places, ids, raw = unpacked(data, "u1", "u1", "i8", "u1")
        raw, ends = raw.tobytes(), np.cumsum(sizes, dtype=np.int64)
        rows.append(np.array([known.setdefault(raw[a:z], len(known)) for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64))
        all_grams.append(places)
        all_ids.append(ids)
    pieces, own = list(known), np.concatenate(rows)
    gram, least = np.empty(len(pieces), np.int64), np.full(len(pieces), LAST)
    gram[own] = np.concatenate(all_grams)
    np.minimum.at(least, own, np.concatenate(all_ids))
    grams = gram.tolist()
    by_gram: dict[bytes, list[int]] = {}
    for k, (piece, g) in enumerate(zip(pieces, grams, strict=True)):
        if g != WINDOW:  # the others are whole windows, all distinct: no suffix of one is a window of another
            by_gram.setdefault(piece[g : g + GRAM], []).append(k)
    # Runs of windows with one answer: mostly one per piece.
    size = np.array([len(x) for x in pieces], np.int64) - LENGTH + 1
    split: list[tuple[np.ndarray, ...]] = []
    some, much = [], 0
    groups = [g for g in by_gram.values() if len(g) > 1]
    for at, group in enumerate(groups):
        group = kin(pieces, grams, group)
        if group:
            some.append(group)
            much += sum(len(pieces[k]) for k in group)
        if some and (much > 1 << 20 or at == len(groups) - 1):
            split.append(window_minima(pieces, gram, least, size, some))
            some, much = [], 0
    if some:
        split.append(window_minima(pieces, gram, least, size, some))
    who = np.concatenate([x[0] for x in split]) if split else np.empty(0, np.int64)
    whole = np.ones(len(pieces), bool)
    whole[who] = False
    plain = np.flatnonzero(whole)
    who = np.concatenate([plain, who])
    length = np.concatenate([size[plain], *(x[1] for x in split)])
    answer = np.concatenate([least[plain], *(x[2] for x in split)])
    order = np.argsort(who, kind="stable")
    length, answer = length[order], answer[order]
    count = np.bincount(who, minlength=len(pieces))
    start = np.cumsum(count) - count
    out = []
    for own in rows:
        n = count[own]
        run = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(packed(n.astype(np.uint8), length[run].astype(np.uint8), answer[run]))
    return pd.DataFrame({"batch": frame["batch"], "part": frame["part"], "reply": out})


def covered(own: Batch, notes: bytes, answers: list, parts: int) -> np.ndarray:
    """A flag for each byte of a batch: whether it goes."""
    dead, where, text, place, piece = unpacked(notes, "?", "i8", "u4", "i8", "u4")
    by_part = {r["part"]: r["reply"] for r in answers}
    counts = np.zeros(len(where), np.int64)
    parts_of, lengths, ids = [], [], []
    dealt = Dealt(where, parts)
    for p in dealt.there():
        k = dealt[p]
        c, n, i = unpacked(by_part[p], "u1", "u1", "i8")
        counts[k] = c
        parts_of.append(np.repeat(k, c))
        lengths.append(n)
        ids.append(i)
    edge = np.zeros(len(own.bytes) + 1, np.int32)
    if len(where):
        order = np.argsort(np.concatenate(parts_of), kind="stable")
        lengths, ids = np.concatenate(lengths)[order].astype(np.int64), np.concatenate(ids)[order]
        start = np.cumsum(counts) - counts
        before = np.cumsum(lengths) - lengths
        before -= np.repeat(before[start], counts)
        # Each occurrence of a piece with each of its runs.
        n = counts[piece]
        run = np.repeat(start[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        use = ids[run] < np.repeat(own.ids[text], n)
        at = np.repeat(place, n)[use] + before[run[use]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + lengths[run[use]] - 1 + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    # Texts that another row of the batch stands for: as that row, unless their doc_id is larger.
    for t, f in enumerate(own.stands):
        a, z = own.starts[t], own.ends[t]
        if z - a < LENGTH:
            gone[a:z] = False
        elif dead[t]:
            gone[a:z] = True
        elif f != t:
            gone[a:z] = gone[own.starts[f] : own.ends[f]] if not dead[f] else gone[a:z]
    return gone


def emitted(frames: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for data, notes, answers in zip(frame["data"], frame["notes"], frame["answers"], strict=True):
            own = Batch(data)
            gone = covered(own, notes, answers if answers is not None else [], parts)
            rows = []
            for i, null, a, z in zip(own.ids.tolist(), own.null.tolist(), own.starts.tolist(), own.ends.tolist(), strict=True):
                g = gone[a:z]
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                rows.append((None if null else i, z - a, int(g.sum()), spans, own.bytes[a:z][~g].tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield out.astype({"doc_id": "Int64"})


def kept_bytes(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes), or kept_sha256 instead, of each row of docs (doc_id, text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // PER_PART))
    hot = HOT
    table = cut(batches_of(docs), rows=1000)
    keyed = table.mapInPandas(lambda x: asked(x, parts), "part int, batch long, data binary")
    replies = keyed.groupBy("part").applyInPandas(lambda x: answered(x, hot), "batch long, part int, reply binary")
    replies = cut(replies, rows=100).groupBy("batch").agg(F.collect_list(F.struct("part", "reply")).alias("replies"))
    replies = cut(replies)
    told = table.join(replies, "batch").mapInPandas(lambda x: sent(x, parts), "part int, batch long, data binary")
    told = cut(told, rows=4)
    notes = told.where("part < 0").select("batch", F.col("data").alias("notes"))
    answers = told.where("part >= 0").groupBy("part").applyInPandas(sorted_out, "batch long, part int, reply binary")
    answers = cut(answers, rows=4).groupBy("batch").agg(F.collect_list(F.struct("part", "reply")).alias("answers"))
    answers = cut(answers)

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in emitted(frames, parts):
            if digest:
                out["kept"] = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
            yield out

    kind = "kept string" if digest else "kept binary"
    out = table.join(notes, "batch").join(answers, "batch", "left").mapInPandas(final, f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")
    return cut(out.withColumnRenamed("kept", "kept_sha256") if digest else out, rows=4)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text)."""
    return kept_bytes(docs, digest=True)
