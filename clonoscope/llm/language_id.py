"""Language ID by string kernels: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams (n = 1 to 3, of the lower-cased text) that both hold, over the root of
the product of their own numbers: the cosine of their presence vectors. Landmarks are a few training texts per language; a
text's kernel values against them, whitened by the landmarks' own kernel matrix, are its Nyström features, and one ridge
regression per language is fitted on them. As all of this is linear in the presence vector, scoring a batch of texts is one
product of its presence matrix with a (n-grams x languages) matrix, divided by the texts' norms.

Training takes at most PER_LANGUAGE documents of each language, fewer where that made more than SAMPLE: of each of that many hash
classes the document with the smallest hash. Everything else is fitted and scored on whole texts.

Defined results: null text, and text without a letter, is `und` with score 0; with nothing to learn from, every text is; repeated
rows are scored alike; documents with a null lang aren't learned from; a null doc_id counts as the empty string in the split;
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the training sample, per language and in all (4 of each language at least), and so of the landmarks; the n-gram space; the ridge.
PER_LANGUAGE, SAMPLE, LANDMARKS, ALL_LANDMARKS, SPACE, RIDGE = 400, 40_000, 48, 4096, 1 << 17, 1e-2
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def present(text: str, flags: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a text, as ascending places in the space; flags: a clear boolean array of SPACE, left clear."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    flags[b] = True
    if len(b) > 1:
        two = b[:-1] << 8 | b[1:]
        flags[(two * np.uint32(2654435761)) >> np.uint32(15)] = True
        if len(b) > 2:
            flags[((two[:-1] << 8 | b[2:]) * np.uint32(2246822519)) >> np.uint32(15)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame) -> DataFrame:
    """lang, text of the sample: one scan that aggregates to a row per language and hash class, then the texts of those."""
    key = F.struct(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").alias("doc_id"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    languages = rows.select("lang").distinct().count()
    most = max(4, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    picked = rows.groupBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(most)).alias("class")).agg(F.min(key).alias("key"))
    picked = picked.select("lang", F.col("key.doc_id").alias("doc_id"))
    if languages * most <= SAMPLE:  # so many ids at most
        picked = F.broadcast(picked)
    return rows.select("doc_id", "lang", "text").join(picked, ["lang", "doc_id"]).dropDuplicates(["lang", "doc_id"])


def fitted(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The learned languages, and the (SPACE, languages) matrix that scores presence vectors."""

    @F.pandas_udf("array<int>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = np.zeros(SPACE, bool)
        for batch in batches:
            yield pd.Series([present(x, flags).astype(np.int32) for x in batch])

    rows = training_rows(docs).select("lang", "doc_id", grams("text").alias("grams")).where(F.size("grams") > 0)
    names, grams_of = [], []
    for r in cut(rows).orderBy("lang", F.col("doc_id").cast("string")).toLocalIterator():  # SAMPLE rows, or 4 a language
        names.append(r["lang"])
        grams_of.append(np.asarray(r["grams"], np.int32))
    return fit(names, grams_of)


def fit(names: list[str], grams_of: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The languages, and the (SPACE, languages) matrix that scores presence vectors, of labelled presence vectors. What it holds: the
    vectors as places, the kernel values (rows x landmarks), the matrix."""
    langs = sorted(set(names))
    if not langs:
        return [], np.zeros((SPACE, 0), np.float32)
    place = {x: k for k, x in enumerate(langs)}
    y = np.array([place[x] for x in names])
    # Landmarks evenly over each language's sample.
    most = max(2, min(LANDMARKS, ALL_LANDMARKS // len(langs)))
    marks = np.concatenate([(own := np.flatnonzero(y == k))[np.linspace(0, len(own) - 1, min(most, len(own))).astype(int)] for k in range(len(langs))])
    norm = np.sqrt([len(g) for g in grams_of])
    kernel = np.empty((len(grams_of), len(marks)), np.float32)
    flags = np.zeros(SPACE, bool)
    every, ends = np.concatenate(grams_of), np.cumsum([len(g) for g in grams_of])
    starts = np.concatenate([[0], ends[:-1]])
    for j, i in enumerate(marks):
        flags[grams_of[i]] = True
        kernel[:, j] = np.add.reduceat(flags[every].astype(np.int32), starts) / (norm * norm[i])
        flags[grams_of[i]] = False
    values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ whiten
    share = len(y) / (len(langs) * np.bincount(y))  # every language counts alike
    one = np.zeros((len(y), len(langs)))
    one[np.arange(len(y)), y] = share[y]
    beta = np.linalg.solve(z.T @ (z * share[y][:, None]) + RIDGE * len(y) * np.eye(z.shape[1]) / z.shape[1], z.T @ one)
    by_mark = (whiten @ beta).astype(np.float32)
    matrix = np.zeros((SPACE, len(langs)), np.float32)
    for i, row in zip(marks, by_mark, strict=True):
        matrix[grams_of[i]] += row / norm[i]
    return langs, matrix


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> Column:
    """A struct (lang_pred, score) for a text column. The model is broadcast: SPACE x languages floats, half a MB for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, matrix = shared.value
        flags = np.zeros(SPACE, bool)
        for batch in batches:
            n = len(batch)
            names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
            rows = [i for i, x in enumerate(batch) if x and langs and LETTER.search(x)]
            for lo in range(0, len(rows), 64):
                part = rows[lo : lo + 64]
                grams = [present(batch.iloc[i], flags) for i in part]
                sizes = np.array([len(g) for g in grams])
                # The presence matrix of the block, row by row as sorted places, times the matrix.
                product = np.add.reduceat(matrix[np.concatenate(grams)], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
                product = product / np.sqrt(sizes)[:, None]
                best = product.argmax(1)
                names[part] = [langs[k] for k in best]
                scores[part] = np.clip(product[np.arange(len(part)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(F.col(text))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang)."""
    docs = docs.select("doc_id", "text", "lang")
    model = fitted(docs)
    made = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(docs, model).alias("made"))
    return made.select("doc_id", "held_out", "made.*")
