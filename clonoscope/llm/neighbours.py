"""Approximate nearest neighbours by balanced posting lists with boundary replicas.

Inner products are searched as distances: each vector gets one more component that brings all of them to the largest norm, queries get
a zero there. A bounded sample is clustered with a penalty on large clusters; the centroids and a graph over them (each one's
nearest, and a few far ones) are broadcast. The ratio up to which lists are looked at is measured on the sample. Beam search in that graph, for a block of vectors at once, finds the
nearest centroids, as many as it needs. A vector is put on the lists of its nearest centroid and of those hardly farther (boundary vectors are on several
lists); a query looks at the lists whose distance is within a ratio of the nearest one's. Lists are split into blocks of bounded
size, as are the queries of a list; a pair of blocks is one matrix product in double precision, which leaves each query's best. A query's nearest
list is searched first, and the others give only vectors that are as good as the last place there.

Equal vectors are one class from the start, listed once with its smallest ids; equal queries are searched once. So neither
a vector that a third of the rows hold nor a query of that kind makes a large group.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take no part;
rows that repeat vec_id and vector count once, and null vec_ids take no part; ties go to the smaller vec_id; an empty table
gives no rows; other columns don't matter. With one list the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Bounds of the sample: vectors per list, vectors, bytes. Least sampled vectors per list, which bounds the lists.
PER_LIST, SAMPLE, SAMPLE_BYTES, LEAST = 64, 65_536, 64 << 20, 4
#: Lists per root of the number of vectors; links of a centroid, and how many of them are far; centroids that a search looks for at first.
SHARE, LINKS, FAR, FIRST = 0.5, 24, 4, 16
#: Replicas of a vector, and how much farther their centroids may be.
REPLICAS, REPLICA_RATIO = 4, 1.01
#: The share of a sample's nearest neighbours whose lists the ratio for queries has to reach, and queries of that sample.
AIM, TRIED = 0.96, 400
#: Vectors and queries of a block.
BLOCK, QUERIES = 4096, 1024


@dataclass
class Index:
    """Centroids (lists x dim + 1), their graph (lists x LINKS), where a search starts, and the largest squared norm."""

    centroids: np.ndarray
    graph: np.ndarray
    start: np.ndarray
    norm2: float

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that brings them to the largest norm."""
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))[:, None]], 1)

    def within(self, x: np.ndarray, ratio: float, enough: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, centroid, place) of the centroids whose distance is within `ratio` of the nearest one's, and of as many nearest ones as hold
        `least` postings (enough: of each centroid); and how many centroids were looked for. Each row's search is as wide as it has to
        be: rows whose widest find still belongs to the result search again, twice as wide."""
        rows, found, width, looked = np.arange(len(x)), [], min(FIRST, len(self.centroids)), 0
        while len(rows):
            at, d = self.nearest(x[rows], width)
            held = np.cumsum(enough[at], axis=1) - enough[at]
            ok = (d <= ratio**2 * d[:, :1] + 1e-12) | (held < least)
            open_ = ok[:, -1] & (width < len(self.centroids))
            i, j = np.nonzero(ok & ~open_[:, None])
            found.append((rows[i], at[i, j], j))
            looked += int(width * (~open_).sum())
            rows, width = rows[open_], min(2 * width, len(self.centroids))
        return *(np.concatenate([x[k] for x in found] or [rows]) for k in range(3)), looked

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each row and their squared distances, ascending, by beam search in the graph."""
        if len(x) > 512:  # bounds the block of link vectors
            parts = [self.nearest(x[lo : lo + 512], k) for lo in range(0, len(x), 512)]
            return np.concatenate([a for a, _ in parts]), np.concatenate([d for _, d in parts])
        n, lists = len(x), len(self.centroids)
        c2 = (self.centroids * self.centroids).sum(1)
        x2 = (x * x).sum(1)
        beam = min(lists, max(k + k // 2, 32))
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, lists), bool)
        opened = np.zeros((n, lists), bool)
        ids = np.broadcast_to(self.start[:beam], (n, min(beam, len(self.start)))).copy()
        dist = x2[:, None] + c2[ids] - 2 * (x @ self.centroids[ids[0]].T) if n else np.zeros(ids.shape)
        seen[rows, ids] = True
        while n:
            # The nearest four unopened centroids of each beam give their links.
            closed = np.where(opened[rows, ids], np.inf, dist)
            width = min(4, ids.shape[1])
            turn = np.argpartition(closed, width - 1, axis=1)[:, :width]
            if not np.isfinite(np.take_along_axis(closed, turn, 1)).any():
                break
            at = np.take_along_axis(ids, turn, 1)
            fresh = np.isfinite(np.take_along_axis(closed, turn, 1))
            opened[rows, at] |= fresh
            more = self.graph[at].reshape(n, -1)
            new = ~seen[rows, more] & np.repeat(fresh, self.graph.shape[1], axis=1)
            order = np.argsort(np.where(new, more, lists), axis=1, kind="stable")
            twice = np.zeros_like(new)
            ordered = np.take_along_axis(more, order, 1)
            twice[rows, order[:, 1:]] = ordered[:, 1:] == ordered[:, :-1]
            new &= ~twice
            fresh_row, fresh_at = np.nonzero(new)
            seen[fresh_row, more[fresh_row, fresh_at]] = True
            d = x2[:, None] + c2[more] - 2 * np.einsum("nd,nkd->nk", x, self.centroids[more])
            ids, dist = np.concatenate([ids, more], 1), np.concatenate([dist, np.where(new, d, np.inf)], 1)
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)


def clustered(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of a balanced clustering: a cluster above the mean size is charged for it in the next round."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    charge = np.zeros(lists)
    x2 = (x * x).sum(1)
    for turn in range(rounds):
        own = np.empty(len(x), int)
        spread = 0.0
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            d = x2[lo : lo + 4096, None] + (centroids * centroids).sum(1) - 2 * part @ centroids.T
            own[lo : lo + 4096] = (d + charge).argmin(1)
            spread += d[np.arange(len(part)), own[lo : lo + 4096]].sum()
        size = np.bincount(own, minlength=lists)
        charge += 0.02 * spread / len(x) * np.clip(size * lists / len(x) - 1, -1, 3)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        full = size > 0
        centroids[full] = total[full] / size[full, None]
        if turn < rounds - 1:
            centroids[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centroids[full]


def built(sample: np.ndarray, norm2: float, lists: int) -> Index:
    index = Index(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 1), int), np.zeros(1, int), norm2)
    raised = index.raised(sample)
    lists = max(1, min(lists, len(raised)))
    index.centroids = clustered(raised, lists) if lists > 1 else raised.mean(0, keepdims=True)
    lists = len(index.centroids)
    rng = np.random.default_rng(1)
    links = min(LINKS, lists - 1)
    if links:
        c = index.centroids
        d = (c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, :links]
        near[:, links - min(FAR, links // 3) :] = rng.integers(0, lists, (lists, min(FAR, links // 3)))
        # A ring through all makes every centroid reachable.
        index.graph = np.concatenate([near, (np.arange(lists)[:, None] + 1) % lists], 1)
    index.start = rng.choice(lists, min(lists, 32), replace=False)
    return index


def ratio_for(index: Index, sample: np.ndarray, k: int) -> float:
    """How much farther than the nearest list a query must look, so that AIM of a sample's k nearest neighbours are on its lists."""
    lists = len(index.centroids)
    if lists == 1 or len(sample) <= k:
        return np.inf
    at, d = index.nearest(index.raised(sample), REPLICAS)
    held = np.zeros((lists, len(sample)), bool)
    i, j = np.nonzero(d <= REPLICA_RATIO**2 * d[:, :1] + 1e-12)
    held[at[i, j], i] = True
    tried = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
    product = sample[tried] @ sample.T
    product[np.arange(len(tried)), tried] = -np.inf
    best = np.argsort(-product, axis=1)[:, :k]
    x = np.concatenate([sample[tried], np.zeros((len(tried), 1))], 1)
    far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (index.centroids * index.centroids).sum(1) - 2 * x @ index.centroids.T, 0))
    far /= np.maximum(far.min(1, keepdims=True), 1e-12)
    need = [np.where(held[:, best[i]], far[i][:, None], np.inf).min(0) for i in range(len(tried))]
    return float(np.quantile(np.concatenate(need), AIM))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    v = v.where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0))
    dim = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return v.where(F.size("embedding") == (dim["dim"] if dim else 0))


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the k other vectors of vectors (vec_id, embedding) with
    the largest inner product. lists: their number, instead of one that follows the number of vectors."""
    spark = vectors.sparkSession
    v = valid(vectors)
    dim = len(first["embedding"]) if (first := v.first()) else 1
    ids = cut(v.select("vec_id", F.xxhash64("embedding").alias("e1"), F.xxhash64("embedding", F.lit(1)).alias("e2")).distinct())
    # The k + 1 smallest ids of each class; a limit per group is applied before the shuffle, too.
    place = F.row_number().over(W.partitionBy("e1", "e2").orderBy("vec_id"))
    some = ids.withColumn("place", place).where(F.col("place") <= k + 1)
    some = cut(some.groupBy("e1", "e2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.element_at("ids", 1)))
    classes = v.join(some.select("cid", "ids"), F.col("vec_id") == F.col("cid")).select("cid", "ids", "embedding").dropDuplicates(["cid"])
    classes = cut(classes)
    n, norm2 = classes.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    lists = lists or max(1, int(SHARE * n**0.5))
    size = max(1, min(max(lists * PER_LIST, 8192), SAMPLE, SAMPLE_BYTES // (8 * dim)))
    lists = max(1, min(lists, size // LEAST))
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(size).select("embedding").toPandas()["embedding"]
    sample = np.stack(picked) if len(picked) else np.ones((1, dim))
    index = built(sample, float(norm2 or 1), lists)
    ratio = ratio_for(index, sample, max(1, -(-k * len(sample) // max(n, 1))))
    shared = spark.sparkContext.broadcast(index)  # a LEAST-th of the sample's bytes, and LINKS links a list, at most

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                at, d = own.nearest(own.raised(np.stack(part["embedding"])), REPLICAS)
                ok = d <= REPLICA_RATIO**2 * d[:, :1] + 1e-12
                i, j = np.nonzero(ok)
                yield pd.DataFrame({"list": at[i, j], "cid": part["cid"].to_numpy()[i], "ids": part["ids"].to_numpy()[i], "embedding": part["embedding"].to_numpy()[i]})

    vector = "array<double>"
    postings = cut(classes.mapInPandas(posted, f"list long, cid long, ids array<long>, embedding {vector}"))
    sizes = postings.groupBy("list").agg(F.count("*").alias("size"))
    filled = np.zeros(len(index.centroids), int)
    for row in sizes.collect():  # a row per list
        filled[row["list"]] = row["size"]

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                x = np.stack(part["embedding"])
                # Lists enough to hold k + 1 vectors, replicas taken off.
                i, at, place, _ = own.within(np.concatenate([x, np.zeros((len(x), 1))], 1), ratio, filled, REPLICAS * (k + 1))
                yield pd.DataFrame({"list": at, "qid": part["qid"].to_numpy()[i], "embedding": part["embedding"].to_numpy()[i], "first": place == 0})

    queries = ids.where(F.col("vec_id") % every == 0).join(some.select("e1", "e2", F.col("cid").alias("qid")), ["e1", "e2"]).select("vec_id", "qid")
    queries = cut(queries)
    asked = queries.select("qid").distinct().join(classes.select(F.col("cid").alias("qid"), "embedding"), "qid")
    asked = cut(asked.mapInPandas(probed, f"list long, qid long, embedding {vector}, first boolean"))

    def blocks(rows: DataFrame, key: str, most: int) -> DataFrame:
        """(list, ids, vectors, more): the rows of a list in blocks, as bytes; more: how many ids each class has, and the ids, or
        of queries the score that a vector must have."""
        count = cut(rows.groupBy("list").agg(F.ceil(F.count("*") / most).alias("parts")))
        rows = rows.join(count, "list").withColumn("part", F.pmod(F.xxhash64(key), "parts"))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(key)
            more = frame["bound"].to_numpy(float).tobytes() if key == "qid" else np.array([len(x) for x in frame["ids"]], np.int64).tobytes() + np.concatenate(list(frame["ids"])).astype(np.int64).tobytes()
            return pd.DataFrame({"list": frame["list"].iloc[:1], "ids": [frame[key].to_numpy(np.int64).tobytes()], "vectors": [np.stack(frame["embedding"]).tobytes()], "more": [more]})

        return cut(rows.groupBy("list", "part").applyInPandas(pack, "list long, ids binary, vectors binary, more binary"), rows=8)

    right = blocks(postings, "cid", BLOCK)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qids, q, bounds, ids, x, more in batch[["qids", "q", "bounds", "ids", "vectors", "more"]].itertuples(index=False):
                bounds = np.frombuffer(bounds)
                qids, cid = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                qv, xv = np.frombuffer(q).reshape(len(qids), -1), np.frombuffer(x).reshape(len(cid), -1)
                more = np.frombuffer(more, np.int64)
                count, held = more[: len(cid)], more[len(cid) :]
                start = np.cumsum(count) - count
                most = min(k + 1, len(cid))
                product = qv @ xv.T
                # Everything at the last place's score, up to rounding, is scored again in one fixed order of summation.
                limit = np.maximum(np.partition(product, len(cid) - most, axis=1)[:, len(cid) - most], bounds)
                i, j = np.nonzero(product >= (limit - 1e-12 * np.abs(product).max())[:, None])
                score = (qv[i] * xv[j]).sum(1)
                ok = score >= bounds[i]
                i, j, score = i[ok], j[ok], score[ok]
                order = np.lexsort((cid[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, np.arange(len(qids)))
                ok = np.arange(len(i)) - first[i] < most
                i, j, score = i[ok], j[ok], score[ok]
                n = count[j]
                member = held[np.repeat(start[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                yield pd.DataFrame({"qid": np.repeat(qids[i], n), "vec_id": member, "score": np.repeat(score, n)})

    def searched(rows: DataFrame) -> DataFrame:
        left = blocks(rows, "qid", QUERIES).select("list", F.col("ids").alias("qids"), F.col("vectors").alias("q"), F.col("more").alias("bounds"))
        return cut(left.join(right, "list").mapInPandas(scored, "qid long, vec_id long, score double"), rows=4)

    # The nearest list first: the others have to give only what is as good as its last place.
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    near = searched(asked.where("first").withColumn("bound", F.lit(float("-inf"))))
    bounds = cut(near.withColumn("place", F.row_number().over(best)).where(F.col("place") == k + 1).select("qid", F.col("score").alias("bound")))
    rest = asked.where("NOT first").join(bounds, "qid", "left").na.fill(float("-inf"), ["bound"])
    found = near.union(searched(rest)).distinct()
    found = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"))
    out = queries.withColumnRenamed("vec_id", "query_id").join(found, "qid").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
