"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, tokens.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.

Defined results of every stage: an empty table gives no rows; columns of docs other than doc_id, text, lang and source travel unread as
part of one value, so that none of their names clashes with what a stage makes; rows with a null doc_id, and rows of one
doc_id with several texts, are decided on one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup
from clonoscope.llm.common import cut, squeezed, table

#: A document goes if its language is unknown, or scores less than this.
LEAST_SCORE = 0.05

#: The kernel regression, the verified similarities and the tokens can't be put in SQL.
ORACLE_SQL = None


def whole(docs: DataFrame) -> Column:
    """A row of docs as one value."""
    return F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from these documents, can tell. None goes for being in another one than it says.
    Null and empty texts, and texts without a letter, go; with no labelled text to learn from, all go; repeated rows go or stay together."""
    model = language_id.fitted(docs.select("doc_id", "text", "lang"))
    out = docs.select(whole(docs), language_id.predicted(docs, model).alias("made"))
    return out.where((F.col("made.lang_pred") != language_id.UNKNOWN) & (F.col("made.score") >= LEAST_SCORE)).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but the rows that are copies: rows of one doc_id, or of none, are told apart by their text without blanks. Null, empty and
    blank texts are copies of each other; the row that stays has the longest text, then the smallest doc_id; rows that repeat the doc_id and
    text of it stay, too."""
    decided = exact_dedup.exact_dedup(docs.select("doc_id", "text"))
    gone = cut(decided.where("NOT kept").select(F.col("doc_id").alias("gone"), F.col("text_sha256").alias("same")).distinct())
    rows = docs.select(whole(docs), F.sha2(squeezed(F.col("text")), 256).alias("hash"))
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone")) & (F.col("hash") == F.col("same")), "left_anti").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but the rows that are near copies. Where a doc_id has several texts, all but one of them get a key of their own for it, so
    that each is decided on alone; the keys come after all doc_ids below 2^62. Texts without words and rows with a null doc_id stay;
    of a component the row with the smallest key stays; repeated rows go or stay together."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    several = cut(texts.where("lo < hi").select("doc", "lo"))
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1 << 62))
    rows = docs.select(whole(docs), text.alias("hash"))
    keyed = rows.join(several, F.col("row.doc_id") == F.col("doc"), "left")
    keyed = keyed.select("row", F.when(F.col("lo") < F.col("hash"), own).otherwise(F.col("row.doc_id").cast("long")).alias("key"))
    decided = near_dedup.near_dedup(keyed.select(F.col("key").alias("doc_id"), "row.text"))
    gone = cut(decided.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct())
    return keyed.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: null and empty texts, whose size is 0, by their source's rate like others; a null source
    is a source; repeated rows are taken each for itself; a source without words takes nothing."""
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 of what the ids decode to. Null text has no
    tokens, like the empty one; repeated rows give repeated rows."""
    shared = byte_bpe.shared_ranks(docs)

    @F.pandas_udf("n_tokens long, ids binary, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = byte_bpe.codec(*shared.value)
        for batch in batches:
            rows = [own.packed(x) if x else b"" for x in batch]
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in rows], "ids": rows, "decoded_sha256": [hashlib.sha256(own.unpacked(x)).hexdigest() for x in rows]}).astype({"n_tokens": "int64"})
        byte_bpe.forget()

    return docs.select("doc_id", "source", both(F.coalesce("text", F.lit(""))).alias("made")).select("doc_id", "source", "made.*")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mix),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
