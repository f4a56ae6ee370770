"""MinHash near-dedup by bottom-k sketches from one hash function.

A document's set is the hashes of its distinct 5-word shingles; its sketch is the K smallest of them. Equal sets are one class
from the start. Inverted lists of the retained values give candidates: of two sets with similarity T, about T * K values are
retained by both, and SHARED of them practically always (a chance below 1e-6 otherwise), so each class needs to be listed only under its
rarest K - SHARED + 1 values (all of a small set is retained, and the bound is exact there). Values that one class has need no list.

Candidates are taken list by list: first every class against the list's smallest one, which joins most of a group of near copies with as
many candidates as members. What is then in one component needs no further look. Short lists give their pairs between components;
long ones are taken against another member, and what still isn't one component after that is compared in blocks of bounded size, each
pair in one list only. A pair of blocks is a product of presence matrices and returns just links that join components.
The sketches estimate the similarity and filter; full sets decide.

Defined results: null text, and text without words, has no shingles and is linked with nothing; with 1 to 4 words, the whole
sequence is the one shingle; repeated rows have one component and are all kept if the doc_id is; a row with a null doc_id is
linked with nothing, and kept; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut

WORDS, T100 = 5, 75
#: The size of a sketch, and how many retained values two sets of similarity 0.75 share at the very least (mean 36, deviation 3).
K, SHARED = 48, 19
#: Members of a list that is short, rounds over long ones, members of a block, and cells of a presence matrix.
SHORT, ROUNDS, BLOCK, CELLS = 32, 1, 256, 1 << 20
#: Words of which a worker remembers the hash.
MEMO = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


#: Odd multipliers for the places of a shingle's words.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
hashes = WordHashes()
SKETCH = T.StructType([T.StructField(k, T.LongType()) for k in ("n", "s1", "s2")] + [T.StructField("sketch", T.ArrayType(T.LongType()))])


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes (63 bits, ascending) of a text's shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: A-Z and [\x20\x09-\x0D] only
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < WORDS:
        x = np.array([(h * PLACES[:n]).sum() + np.uint64(n)], np.uint64)
    else:
        x = h[: n - 4] * PLACES[0]
        for i in range(1, WORDS):
            x = x + h[i : n - 4 + i] * PLACES[i]
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unique(x >> np.uint64(1)).astype(np.int64)


@F.pandas_udf(SKETCH)
def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch:
            x = shingles(text)
            s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) if len(x) else (None, None)
            rows.append((len(x), s1, s2, x[:K]))
        out = pd.DataFrame(rows, columns=["n", "s1", "s2", "sketch"])
        yield out.astype({"n": "int64", "s1": "Int64", "s2": "Int64"})
    hashes.clear()  # the worker goes on to other stages


@F.pandas_udf(T.ArrayType(T.LongType()))
def _full(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([shingles(x) for x in batch], dtype=object)
    hashes.clear()


def least_shared(n: Column) -> Column:
    """How many retained values a set of n shingles shares with any set of similarity 0.75 or more."""
    return F.when(n * 4 <= 3 * K, F.ceil(n * T100 / 100)).otherwise(F.lit(SHARED))


def alike(n: Column, m: Column) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * T100


def lists(classes: DataFrame) -> DataFrame:
    """(value, rep, n): each class (rep, n, sketch) under the rarest of its retained values that other classes have, too."""
    posted = classes.select("rep", "n", F.explode("sketch").alias("value"))
    counts = cut(posted.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    common = posted.join(counts, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    # The values that no other class has come first in the order; they take up places of the prefix.
    length = F.least(F.col("n"), F.lit(K))
    places = length - least_shared(F.col("n")) + 1 - (length - F.size("values"))
    common = common.withColumn("places", places.cast("int")).where("places > 0")
    return common.select("rep", "n", F.explode(F.slice("values", F.lit(1), F.col("places"))).alias("x")).select(F.col("x.value").alias("value"), "rep", "n")


def starred(members: DataFrame, pivot: Column) -> DataFrame:
    """Candidates (a, b): the members (value, rep, n) of each list against the one for which pivot is least."""
    centre = members.groupBy("value").agg(F.min(F.struct(pivot.alias("p"), "rep", "n")).alias("c"), F.count("*").alias("cnt")).where("cnt > 1")
    centre = centre.select("value", F.col("c.rep").alias("cr"), F.col("c.n").alias("cn"))
    found = members.join(centre, "value").where("rep <> cr").where(alike(F.col("n"), F.col("cn")))
    return found.select(F.least("rep", "cr").alias("a"), F.greatest("rep", "cr").alias("b"))


def paired(members: DataFrame) -> DataFrame:
    """Candidates (a, b): pairs between components within short lists (value, rep, n, comp)."""
    other = members.select("value", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("comp").alias("d"))
    found = members.join(other, "value").where("rep < b AND comp <> d").where(alike(F.col("n"), F.col("m")))
    return found.select(F.col("rep").alias("a"), "b")


def shared_counts(sets: list[np.ndarray], m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and m + j: by products of presence matrices over what several sets have, a stretch of
    columns at a time, or pair by pair where that is less work."""
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[keep]]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[keep]
    width = int(column.max(initial=-1)) + 1
    if len(i) * (150_000 + 200 * len(place) / len(sets)) < width * m * (len(sets) - m):  # in tenths of a nanosecond, about
        return np.array([len(np.intersect1d(sets[p], sets[m + q], assume_unique=True)) for p, q in zip(i, j, strict=True)])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((m, len(sets) - m), np.float32)
    step = max(1, CELLS // len(sets))
    for lo in range(0, width, step):
        a, z = np.searchsorted(column, [lo, lo + step])
        has = np.zeros((len(sets), min(step, width - lo)), np.float32)
        has[row[a:z], column[a:z] - lo] = 1
        both += has[:m] @ has[m:].T
    return both[i, j]


def block_links(value: int, x: list, y: list, same: bool) -> list[tuple[int, int]]:
    """Links between two blocks of the list of a value: pairs that no list of a smaller value has, too; of the links found
    those that join components which others of them haven't joined."""
    m = len(x)
    rows = [*x, *y]
    rep, n, comp = (np.array([r[k] for r in rows]) for k in ("rep", "n", "comp"))
    i, j = np.meshgrid(np.arange(m), np.arange(len(y)), indexing="ij")
    i, j = i.ravel(), j.ravel()
    least, most = np.minimum(n[i], n[m + j]), np.maximum(n[i], n[m + j])
    ok = (least * 100 >= most * T100) & (comp[i] != comp[m + j]) & ((rep[i] < rep[m + j]) | (not same))
    i, j, least = i[ok], j[ok], least[ok]
    if len(i):
        need = np.where(least * 4 <= 3 * K, np.ceil(least * T100 / 100), SHARED)
        ok = shared_counts([np.asarray(r["sketch"]) for r in rows], m, i, j) >= need
        i, j = i[ok], j[ok]
    if len(i):
        earlier = [np.array([v for v in r["values"] if v < value], np.int64) for r in rows]
        ok = shared_counts(earlier, m, i, j) == 0 if any(map(len, earlier)) else np.ones(len(i), bool)
        i, j = i[ok], j[ok]
    if len(i):
        both = shared_counts([np.asarray(r["full"]) for r in rows], m, i, j)
        ok = both * 100 >= (n[i] + n[m + j] - both) * T100
        i, j = i[ok], j[ok]
    parent = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for p, q in zip(i.tolist(), (m + j).tolist(), strict=True):
        a, b = find(int(comp[p])), find(int(comp[q]))
        if a != b:
            parent[a] = b
            out.append((int(rep[p]), int(rep[q])))
    return out


def blocked(members: DataFrame, classes: DataFrame, full: DataFrame) -> DataFrame:
    """Links (u, v) between components within long lists (value, rep, n, comp, cnt), block against block."""
    values = members.groupBy("rep").agg(F.collect_set("value").alias("values"))  # at most K of them
    about = cut(values.join(classes.select("rep", "sketch"), "rep").join(full, "rep"))
    rows = members.join(about, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("cnt") / BLOCK)))
    blocks = cut(rows.groupBy("value", "block").agg(F.collect_list(F.struct("rep", "n", "comp", "sketch", "values", "full")).alias("x")))
    pairs = blocks.join(blocks.select("value", F.col("block").alias("other"), F.col("x").alias("y")), "value").where("block <= other")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for value, x, y, same in zip(batch["value"], batch["x"], batch["y"], batch["same"], strict=True):
                yield pd.DataFrame(block_links(value, x, y, same), columns=["u", "v"]).astype("int64")

    found = pairs.select("value", "x", "y", (F.col("block") == F.col("other")).alias("same")).mapInPandas(compare, "u long, v long")
    return cut(found, rows=2)


def verified(pairs: DataFrame, classes: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches' union lets their sets be similar and whose sets are, as links (u, v)."""
    side = lambda name, of, what: of.select(F.col("rep").alias(name), F.col(what).alias(f"x{name}"))
    near = pairs.distinct().join(side("b", classes, "sketch"), "b").join(side("a", classes, "sketch"), "a")
    union = F.slice(F.array_sort(F.array_union("xa", "xb")), 1, K)
    near = near.withColumns({"u": union, "i": F.array_intersect("xa", "xb")})
    both = F.size(F.filter("i", lambda v: v <= F.element_at("u", -1)))
    near = near.where(both >= F.when(F.size("u") == K, F.lit(SHARED)).otherwise(F.ceil(F.size("u") * T100 / 100))).select("a", "b")
    near = near.join(side("b", full, "full"), "b").join(side("a", full, "full"), "a")
    i = F.size(F.array_intersect("xa", "xb"))
    return near.where(i * 100 >= (F.size("xa") + F.size("xb") - i) * T100).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = cut(docs.select("doc_id", _sketch("text").alias("x")).select("doc_id", "x.*"), rows=1000)
    known = made.where("doc_id IS NOT NULL AND n > 0")
    classes = cut(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("docs")))
    listed = cut(lists(classes))
    full = docs.join(listed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    full = cut(full.select(F.col("doc_id").alias("rep"), _full("text").alias("full")), rows=250)
    links = cut(verified(starred(listed, F.col("rep")), classes, full))
    for turn in range(ROUNDS + 1):
        joined = components(links)
        comp = F.coalesce("v", "rep")
        members = listed.join(joined.withColumnRenamed("u", "rep"), "rep", "left").select("value", "rep", "n", comp.alias("comp"))
        mixed = members.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("cnt")).where("lo < hi").select("value", "cnt")
        members = cut(members.join(cut(mixed), "value"))
        long = members.where(F.col("cnt") > SHORT)
        some = not long.isEmpty()
        if turn == 0:
            pairs = paired(members.where(F.col("cnt") <= SHORT))
            if some and turn < ROUNDS:
                pairs = pairs.union(starred(long, F.xxhash64("comp", "rep", F.lit(turn))))
            links = links.union(verified(pairs, classes, full))
        elif some and turn < ROUNDS:
            links = links.union(verified(starred(long, F.xxhash64("comp", "rep", F.lit(turn))), classes, full))
        if some and turn == ROUNDS:
            links = links.union(blocked(long, classes, full))
        links = cut(links)
        if not some:
            break
    joined = components(links)
    whole = classes.join(joined.withColumnRenamed("u", "rep"), "rep", "left").where("docs > 1 OR v IS NOT NULL")
    whole = cut(whole.select("s1", "s2", F.coalesce("v", "rep").alias("least")))
    made = made.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), F.when(F.col("doc_id").isNotNull(), F.col("s2")).alias("s2"))
    out = made.join(whole, ["s1", "s2"], "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: For small tables only: it meets all documents of a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 75 * (a.n + b.n - i)
), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), m AS (
  SELECT u AS doc_id, min(v) AS least FROM r GROUP BY u
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(least, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
