"""Toxicity as ordinal severity: cumulative-link regression on sparse text features.

Features are a text's distinct words (runs of letters, lower-cased) and their beginnings of 4 to 6 letters; a feature's value is
the number of distinct words that have it. The severity grades are 0 (labelled clean), and 1 or 2 for a labelled toxic document
with up to, or more than, the median number of telling words. One weight vector serves all thresholds:
P(grade > k) = sigmoid(w.x - theta_k) with theta_0 < theta_1, and the expected severity is the sum of these probabilities.

The fit uses a bounded sample: of each label up to PER_LABEL documents, one of each hash class. Features are chosen by their
counts over the sample (at most FEATURES); all others weigh nothing, so a long clean text doesn't add up to a toxic one.
Scoring covers all documents and whole texts.

Defined results: null or empty text, and every text where nothing can be learned, has severity 0 and isn't toxic; labels with a null
doc_id or toxic are left out, of several labels of a document the worst counts; repeated rows are scored alike, null
doc_ids like others; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds: documents per label in the sample, features, words in a worker's memo.
PER_LABEL, FEATURES, MEMO = {0: 6000, 1: 3000}, 1024, 400_000
#: A chosen feature is in this many sampled documents at least, and its log odds ratio is so many standard errors from 0.
LEAST, ERRORS = 4, 3.5
BEGINNINGS = (4, 5, 6)
#: A document is flagged from this probability of any grade above 0 on: toxic texts are few, and missing one costs more than a second look.
FLAG = 0.1
words = regex.compile(r"\p{L}+").findall


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings with a mark."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    thresholds: np.ndarray


class Scores(dict):
    """The weight that a word adds, as a memo."""

    def __init__(self, model: Model):
        self.of = dict(zip(model.names, model.weights.tolist(), strict=True))

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[word] = made = sum(self.of.get(f, 0.0) for f in features(word))
        return made


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text of the training sample. One aggregation leaves a row for each label and hash class."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    classes = F.when(F.col("toxic") > 0, PER_LABEL[1]).otherwise(PER_LABEL[0])
    key = F.struct(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").alias("doc_id"))
    labels = labels.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(1)), classes).alias("class"))
    picked = labels.agg(F.min(key).alias("key")).select("toxic", F.col("key.doc_id").alias("doc_id"))
    # Bound: the sum of PER_LABEL ids.
    picked = cut(picked.limit(sum(PER_LABEL.values())))
    return docs.where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"])


def chosen(rows: DataFrame) -> list[str]:
    """The features whose counts over the sample tell toxic from clean."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return []

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = Counter()
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                count.update((f, toxic) for f in {f for w in set(words(text.lower())) for f in features(w)})
            yield pd.DataFrame([(f, n if t else 0, 0 if t else n) for (f, t), n in count.items()], columns=["f", "t", "c"])

    counts = rows.select("toxic", "text").mapInPandas(counted, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    u, d = totals[1] - F.col("t") + 0.5, totals[0] - F.col("c") + 0.5
    z = F.log(t * d / (c * u)) / F.sqrt(1 / t + 1 / c + 1 / u + 1 / d)
    # Only what speaks for toxicity: what speaks against it would excuse insults in an otherwise friendly text.
    best = counts.where(F.col("t") + F.col("c") >= LEAST).withColumn("z", z).where(F.col("z") >= ERRORS)
    return [r["f"] for r in best.orderBy(F.desc("z"), "f").limit(FEATURES).collect()]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative logit model of grades 0, 1, ..., by Adam on the penalised likelihood of weighted rows."""
    top = int(y.max())
    weight = weight / weight.sum()
    x = x.astype(np.float32)
    p = np.concatenate([np.zeros(x.shape[1]), [0.5], np.zeros(top - 1)])  # weights, first threshold, logs of the steps to the next ones
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        w, gaps = p[: x.shape[1]], np.exp(p[x.shape[1] + 1 :])
        theta = p[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])
        over = np.concatenate([np.ones((len(y), 1)), sigmoid((x @ w.astype(np.float32)).astype(float)[:, None] - theta), np.zeros((len(y), 1))], 1)  # P(grade >= k)
        lo, hi = over[np.arange(len(y)), y], over[np.arange(len(y)), y + 1]
        p_y = np.maximum(lo - hi, 1e-9)
        dlo, dhi = lo * (1 - lo) / p_y, hi * (1 - hi) / p_y
        g = np.zeros_like(p)
        g[: x.shape[1]] = (weight * (dlo - dhi)).astype(np.float32) @ x - ridge * w
        by = np.zeros(top)
        for k in range(top):  # threshold k bounds grade k above and grade k + 1 below
            by[k] = (weight * dhi)[y == k].sum() - (weight * dlo)[y == k + 1].sum()
        g[x.shape[1]] = by.sum()
        for k in range(1, top):
            g[x.shape[1] + k] = by[k:].sum() * gaps[k - 1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    gaps = np.exp(p[x.shape[1] + 1 :])
    return p[: x.shape[1]], p[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = cut(sample(docs, labels))
    names = chosen(rows)
    if not names:
        return None
    place = {f: i for i, f in enumerate(names)}

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[place[f] for w in sorted(set(words(x.lower()))) for f in features(w) if f in place] for x in batch])

    worst = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    all_labels = {r["toxic"]: r["count"] for r in worst.groupBy("toxic").count().collect()}
    # Bound: the sample, in chosen features only.
    got = sorted(rows.select("doc_id", "toxic", found("text").alias("at")).collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(got), len(names)), np.float32)
    for row, r in zip(x, got, strict=True):
        np.add.at(row, np.asarray(r["at"], int), 1)
    toxic = np.array([r["toxic"] for r in got])
    telling = x[:, [i for i, f in enumerate(names) if not f.endswith("-")]].sum(1)
    severe = telling > np.median(telling[toxic == 1])
    y = np.where(toxic == 1, 1 + severe, 0).astype(int)
    # Rows weigh as much as the labelled documents that they stand for.
    weight = np.array([all_labels[0] / (toxic == 0).sum(), all_labels[1] / (toxic == 1).sum()])[toxic]
    return Model(names, *fit(x, y, weight))


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A struct (severity, grade, toxic) for a text column. The model is broadcast: FEATURES weights at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, toxic boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        add = Scores(model) if model else None
        for batch in batches:
            if model is None:
                yield pd.DataFrame({"severity": np.zeros(len(batch)), "grade": np.zeros(len(batch), np.int32), "toxic": np.zeros(len(batch), bool)})
                continue
            # A sorted sum, so that reruns agree to the last bit.
            eta = np.array([sum(sorted(filter(None, map(add.__getitem__, set(words(x.lower())))))) if x else -np.inf for x in batch], float)
            over = 1 / (1 + np.exp(-np.clip(eta[:, None] - model.thresholds, -30, 30)))
            over[np.isneginf(eta)] = 0
            parts = -np.diff(np.concatenate([np.ones((len(eta), 1)), over, np.zeros((len(eta), 1))], 1), axis=1)
            yield pd.DataFrame({"severity": over.sum(1), "grade": parts.argmax(1).astype(np.int32), "toxic": over[:, 0] >= FLAG})

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, toxic of each row of docs (doc_id, text), learned from labels (doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    made = docs.select("doc_id", scored(docs, fitted(docs, labels.select("doc_id", "toxic"))).alias("made"))
    return made.select("doc_id", "made.*")
