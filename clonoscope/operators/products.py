"""Sums over what two examples have in common, for all pairs of examples, by products of blocks of a sparse matrix.

A pair of examples that share many items would be as many rows of a join. Here an example is one row with its items and their values
as arrays, examples are dealt out into blocks, and a task gets two blocks and gives the pairs of their examples. So an
example's distinct items have to fit into a task (as arrays of numbers), and what is shuffled grows with the number of blocks.
Items are hashes of 64 bits: two of 1e8 different items are taken for one with a chance of 3e-4.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Examples and items of a block; examples from which several blocks pay; results made at once; numbers of a dense part.
BLOCK, BLOCK_ITEMS, SMALL, AT_ONCE, DENSE = 10_000, 3_000_000, 500, 1 << 20, 1 << 23
#: Seconds of a product of two numbers one by one, and within a dense matrix.
ONE_BY_ONE, WITHIN = 2.5e-8, 4e-11


def item_id(*columns: str) -> Column:
    """A number for the values of columns, NULL being one of them unless there is one column only."""
    if len(columns) == 1:
        return F.when(F.col(columns[0]).isNotNull(), F.xxhash64(columns[0]))
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def block_count(rows: DataFrame, key: str, item: str) -> int:
    """How many blocks the examples of rows (key, item) make; from estimated numbers of examples and items."""
    n, examples, items = rows.agg(F.count("*"), F.approx_count_distinct(key), F.approx_count_distinct(item)).first()
    return max(1, min(4, ceil(examples / SMALL)), ceil(examples / BLOCK), ceil(min(n, 1.2 * examples * items) / BLOCK_ITEMS))


def dealt(packed: DataFrame, blocks: int, key: str, left: list[Column], right: list[Column]) -> DataFrame:
    """(pair, side, key, ...) of packed: each example once for each pair of blocks, taken once, that its block is in; the columns of a row are
    those of its side."""
    b, n = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.lit(blocks)
    one = lambda i, j, s: F.struct((F.floor(j * (j + 1) / 2).cast("int") + i).alias("pair"), F.lit(s).alias("side"))
    first = F.transform(F.sequence(F.col("__b"), n - 1), lambda j: one(F.col("__b"), j, 0))
    second = F.transform(F.sequence(F.lit(0), F.col("__b")), lambda i: one(i, F.col("__b"), 1))
    rows = packed.withColumn("__b", b).withColumn("__p", F.explode(F.concat(first, second)))
    sided = [F.when(F.col("__p.side") == 0, x).otherwise(y).alias(f"c{i}") for i, (x, y) in enumerate(zip(left, right, strict=True))]
    return rows.select("__p.pair", "__p.side", F.col(key).alias("key"), *sided).repartitionById(blocks * (blocks + 1) // 2, F.col("pair")).sortWithinPartitions("pair")


class Side:
    """One block's examples by key: keys, kinds and values of all their items, the example of each item; n is their number of items."""

    def __init__(self, t: pa.Table) -> None:
        t = t.take(pc.sort_indices(t, [("key", "ascending")]))
        self.keys, lists = t["key"].combine_chunks(), t["c0"].combine_chunks()
        self.kinds = lists.flatten().to_numpy(zero_copy_only=False)
        self.at = np.repeat(np.arange(len(t), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
        self.other, self.size = t["c1"].combine_chunks(), len(t)
        self.also = {c: t[c].combine_chunks() for c in t.column_names if c > "c1" and c in ("c2", "c3")}
        self.values = np.ones(len(self.kinds), dtype=np.float32)

    def weighted(self) -> Side:
        """With the second column as values; those that are NULL are not known."""
        flat = self.other.flatten()
        self.known = flat.is_valid().to_numpy(zero_copy_only=False)
        self.values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
        return self


def _coded(names: np.ndarray, side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a side's items are among names, their examples, and their places there."""
    if not len(names):
        none = np.zeros(0, dtype=np.int32)
        return np.zeros(len(side.kinds), dtype=bool), none, none
    code = np.searchsorted(names, side.kinds).astype(np.int32)
    np.minimum(code, len(names) - 1, out=code)
    there = names[code] == side.kinds
    return there, side.at[there], code[there]


def _products(a: Side, b: Side, weights: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(i, j, one matrix for each of weights): the sums of products over equal kinds, for rows of a from i and of b from j on."""
    names = np.unique(b.kinds)
    both, rows, kinds = _coded(names, a)
    used = np.unique(kinds)
    kinds = np.searchsorted(used, kinds).astype(np.int32)
    mine, columns, post = _coded(names[used], b)
    order = np.argsort(post, kind="stable")
    post, columns = post[order], columns[order]
    weights = [(x[both], y[mine][order]) for x, y in weights]
    del names, both, mine, order
    count = np.bincount(post, minlength=len(used))
    starts = np.concatenate([[0], np.cumsum(count)])
    bounds = np.searchsorted(rows, np.arange(a.size + 1))
    work = float(count[kinds].sum()) if len(used) else 0.0
    finite = all(np.isfinite(x).all() and np.isfinite(y).all() for x, y in weights)
    if finite and work * ONE_BY_ONE > a.size * b.size * len(used) * WITHIN:
        wide = min(b.size, max(8, DENSE // len(used)))
        high = max(1, min(a.size, DENSE // len(used), AT_ONCE // wide))
        # Whole numbers whose sums stay below 2 ** 24 are exact in single precision, too.
        small = [all((v == np.rint(v)).all() for v in (x, y)) and np.abs(x).max() * np.abs(y).max() * len(used) < 2**24 for x, y in weights]
        kinds_of = [np.float32 if s else np.float64 for s in small]
        for j in range(0, b.size, wide):
            w = min(wide, b.size - j)
            here = (columns >= j) & (columns < j + w)
            at = post[here].astype(np.int64) * w + columns[here] - j
            right = [np.bincount(at, y[here], len(used) * w).astype(t).reshape(len(used), w) for (_, y), t in zip(weights, kinds_of, strict=True)]
            for i in range(0, a.size, high):
                h = min(high, a.size - i)
                some = slice(bounds[i], bounds[i + h])
                at = (rows[some] - i).astype(np.int64) * len(used) + kinds[some]
                left = [np.bincount(at, x[some], h * len(used)).astype(t).reshape(h, len(used)) for (x, _), t in zip(weights, kinds_of, strict=True)]
                yield i, j, [(x @ y).astype(np.float64) for x, y in zip(left, right, strict=True)]
        return
    high, i = max(1, AT_ONCE // max(b.size, 1)), 0
    for i in range(0, a.size, high):
        h = min(high, a.size - i)
        out = [np.zeros(h * b.size) for _ in weights]
        lo = bounds[i]
        while lo < bounds[i + h]:
            # As many items as make a bounded number of products; one alone has a block's examples at most.
            sizes = count[kinds[lo : bounds[i + h]]]
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[:AT_ONCE]), 4 * AT_ONCE, "right")))
            some, sizes = slice(lo, hi), sizes[: hi - lo]
            from_ = np.repeat(starts[kinds[some]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            at = np.repeat((rows[some] - i).astype(np.int64), sizes) * b.size + columns[from_]
            for o, (x, y) in zip(out, weights, strict=True):
                o += np.bincount(at, np.repeat(x[some], sizes) * y[from_], len(o))
            lo = hi
        yield i, 0, [o.reshape(h, b.size) for o in out]


def _by_pair(work: Callable[[Side, Side, bool], Iterator[pa.RecordBatch]], same: Callable[[int], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by pair, as work on the two sides of each pair."""

    def done(parts: list[pa.RecordBatch], pair: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        a, b = (t.filter(pc.equal(t["side"], s)) for s in (0, 1))
        if len(a) and len(b):
            yield from work(Side(a), Side(b), same(pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            pairs = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and pairs[lo] != now:
                    yield from done(held, now)
                    held = []
                now = int(pairs[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done(held, now)

    return run


def _same(blocks: int) -> Callable[[int], bool]:
    """Whether a pair is one block twice."""
    alone = {b * (b + 1) // 2 + b for b in range(blocks)}
    return lambda pair: pair in alone


def _packed_items(present: DataFrame, item: list[str], key: str) -> tuple[DataFrame, int]:
    """(key, kinds, n) of each example that has a key, and the number of blocks; an item with a NULL in it counts but is shared by none."""
    present = present.where(F.col(key).isNotNull())
    whole = F.lit(True)
    for c in item:
        whole = whole & F.col(c).isNotNull()
    whole_number = len(item) == 1 and present.schema[item[0]].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = present.select(key, F.col(item[0]).cast("long").alias("kind") if whole_number else F.when(whole, F.xxhash64(*item)).alias("kind"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("kind")).alias("kinds"), F.count("*").alias("n")), block_count(rows, key, "kind")


def shared(present: DataFrame, item: list[str], key: str = "repertoire_id") -> DataFrame:
    """(r1, r2, shared, n1, n2) of all pairs r1 <= r2 of examples, those that share nothing included; present: key, item..."""
    packed, blocks = _packed_items(present, item, key)
    kind = present.schema[key].dataType.simpleString()

    def work(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_arrays([a.keys, b.keys])
        rank = np.empty(len(keys), dtype=np.int64)
        rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        n = np.concatenate([a.other.to_numpy(), b.other.to_numpy()])
        for i, j, (m,) in _products(a, b, [(a.values, b.values)]):
            x, y = i + np.arange(m.shape[0]), j + np.arange(m.shape[1])
            if same:
                r, c = np.nonzero(x[:, None] <= y[None, :])
                x, y, m = x[r], a.size + y[c], m[r, c]
            else:
                x, y = np.repeat(x, len(y)), np.tile(a.size + y, len(x))
                turned = rank[x] > rank[y]
                x, y, m = np.where(turned, y, x), np.where(turned, x, y), m.ravel()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y)), pa.array(m.astype(np.int64)), pa.array(n[x]), pa.array(n[y])], ["r1", "r2", "shared", "n1", "n2"])

    sides = [F.col("kinds"), F.col("n")]
    return dealt(packed, blocks, key, sides, sides).mapInArrow(_by_pair(work, _same(blocks)), f"r1 {kind}, r2 {kind}, shared long, n1 long, n2 long")


def nearest(present: DataFrame, item: list[str], among: DataFrame, k: int, key: str = "repertoire_id") -> DataFrame:
    """(id, other, distance) by Jaccard's distance of examples' items: for each example at least its k nearest others of those in among (key),
    at a tie the ones with the smaller key. Each task gives the k nearest of its block, so no table of all pairs is made."""
    packed, blocks = _packed_items(present, item, key)
    packed = packed.join(among.select(key).distinct().withColumn("among", F.lit(True)), key, "left")
    kind = present.schema[key].dataType.simpleString()

    def work(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        n1, n2 = a.other.to_numpy().astype(float), b.other.to_numpy().astype(float)
        not_a, not_b = (~x.also["c2"].to_numpy(zero_copy_only=False).astype(bool) for x in (a, b))

        def made(x: np.ndarray, y: np.ndarray, d: np.ndarray, one: Side, two: Side) -> pa.RecordBatch:
            some = d < np.inf
            return pa.RecordBatch.from_arrays([one.keys.take(pa.array(x[some])), two.keys.take(pa.array(y[some])), pa.array(d[some])], ["id", "other", "distance"])

        held, at = None, 0  # the nearest of b's examples from `at` on, over the rows so far
        for i, j, (m,) in _products(a, b, [(a.values, b.values)]):
            h, w = m.shape
            d = 1 - m / (n1[i : i + h, None] + n2[None, j : j + w] - m)
            if not same:
                far = np.where(not_a[i : i + h, None], np.inf, d)
                if held is not None and at != j:
                    yield from (made(at + np.arange(len(x)), x, v, b, a) for v, x in zip(*held, strict=True))
                    held = None
                new = []
                for _ in range(min(k, h)):
                    best = far.argmin(axis=0)
                    new.append((far[best, np.arange(w)], i + best))
                    far[best, np.arange(w)] = np.inf
                v, x = (np.concatenate([*([held[c]] if held else []), np.stack([t[c] for t in new])]) for c in (0, 1))
                # Rows come by key, and a stable sort leaves the smaller key first at a tie.
                order = np.argsort(v, axis=0, kind="stable")[:k]
                held, at = (np.take_along_axis(v, order, 0), np.take_along_axis(x, order, 0)), j
            d[:, not_b[j : j + w]] = np.inf
            if same:
                own = i + np.arange(h) - j
                here = np.flatnonzero((own >= 0) & (own < w))
                d[here, own[here]] = np.inf
            for _ in range(min(k, w)):
                best = d.argmin(axis=1)  # the first of equal ones, which has the smallest key
                yield made(i + np.arange(h), j + best, d[np.arange(h), best], a, b)
                d[np.arange(h), best] = np.inf
        if held is not None:
            yield from (made(at + np.arange(len(x)), x, v, b, a) for v, x in zip(*held, strict=True))

    sides = [F.col("kinds"), F.col("n"), F.coalesce("among", F.lit(False))]
    return dealt(packed, blocks, key, sides, sides).mapInArrow(_by_pair(work, _same(blocks)), f"id {kind}, other {kind}, distance double")


def numbered(kinds: DataFrame, most: int = 100_000) -> DataFrame | None:
    """(id, no): small numbers for the ids of kinds, to be broadcast, if there are few."""
    if kinds.limit(most + 1).count() > most:
        return None
    return F.broadcast(kinds.select("id", F.row_number().over(W.orderBy("id")).alias("no")))


def overlaps(rows: DataFrame, pairs: DataFrame, key: str, blocks: int, every: bool = False) -> DataFrame:
    """(r1, r2, overlap, t1, t2) of all pairs of examples with a like pair of items: the sum of the products of their values, and the sums of each
    one's values. rows: key, kind, n, once for each example and kind; pairs (id_1, id_2): which kinds are like, in both directions. every: all pairs
    r1 <= r2 instead, those without an overlap too, and with o1, o2, each one's overlap with itself."""
    from .joins import bounded

    if every:
        rows = rows.where(F.col(key).isNotNull())
    number = pairs.schema["id_1"].dataType.simpleString()
    likes = bounded(pairs.groupBy(F.col("id_1").alias("kind")).agg(F.collect_list("id_2").alias("likes")))
    both = rows.join(likes, "kind", "left").withColumn("n", F.col("n").cast("double"))
    # Each item as itself, on the right side, and as all kinds that are like it, on the left.
    one = lambda k, here: F.struct(k.alias("k"), F.lit(here).alias("right"))
    both = both.select(key, "n", F.explode(F.concat(F.array(one(F.col("kind"), True)), F.transform(F.coalesce("likes", F.array().cast(f"array<{number}>")), lambda k: one(k, False)))).alias("x"))
    x, y = F.when(~F.col("x.right"), F.col("n")), F.when(F.col("x.right"), F.col("n"))
    sums = both.groupBy(key, F.col("x.k").alias("k")).agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.count_if(~F.col("x.right")).alias("xs"), F.count_if("x.right").alias("ys"))
    listed = lambda v: F.sort_array(F.collect_list(F.when((F.col(f"{v}s") > 0) & F.col("k").isNotNull(), F.struct("k", F.col(v).alias("v")))))
    packed = sums.groupBy(key).agg(listed("x").alias("left"), listed("y").alias("right"), F.sum("y").alias("t"), F.coalesce(F.sum(F.when((F.col("xs") > 0) & F.col("k").isNotNull(), F.col("x") * F.col("y"))), F.lit(0.0)).alias("o"))
    kind = rows.schema[key].dataType.simpleString()

    def work(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        a, b = a.weighted(), b.weighted()
        plain = bool((a.values > 0).all() and (b.values > 0).all())
        weights = [(a.values, b.values)]
        if not plain:
            weights += [(np.ones(len(a.kinds)), np.ones(len(b.kinds))), (a.known.astype(float), b.known.astype(float))]
        keys = pa.concat_arrays([a.keys, b.keys])
        rank = np.empty(len(keys), dtype=np.int64)
        rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        per = [pa.concat_arrays([a.also[c], b.also[c]]) for c in (("c2", "c3") if every else ("c2",))]

        def made(x: np.ndarray, y: np.ndarray, value: pa.Array) -> pa.RecordBatch:
            i, j = pa.array(x), pa.array(y)
            return pa.RecordBatch.from_arrays([keys.take(i), keys.take(j), value, *[v.take(at) for v in per for at in (i, j)]], names)

        for i, j, (m, *more) in _products(a, b, weights):
            if every:
                r, c = np.nonzero((i + np.arange(m.shape[0]))[:, None] <= (j + np.arange(m.shape[1]))[None, :]) if same else np.divmod(np.arange(m.size), m.shape[1])
            else:
                r, c = np.nonzero(m if plain else more[0])
            value = pa.array(m[r, c], mask=None if plain or every else more[1][r, c] == 0)
            x, y = i + r, a.size + j + c
            if every:
                turned = (rank[x] > rank[y]) & (not same)
                x, y = np.where(turned, y, x), np.where(turned, x, y)
            yield made(x, y, value)
            if not same and not every:
                yield made(y, x, value)

    names = ["r1", "r2", "overlap", "t1", "t2", *(["o1", "o2"] if every else [])]
    also = [F.col("t"), *([F.col("o")] if every else [])]
    left, right = ([F.transform(s, lambda x: x["k"]), F.transform(s, lambda x: x["v"]), *also] for s in ("left", "right"))
    schema = f"r1 {kind}, r2 {kind}, {', '.join(f'{c} double' for c in names[2:])}"
    return dealt(packed, blocks, key, left, right).mapInArrow(_by_pair(work, _same(blocks)), schema)
