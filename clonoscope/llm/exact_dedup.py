"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Each text without blanks is cut where its content says so. Chunks are deduplicated to verified identifiers: the hash of a
chunk is its identifier once all chunks with that hash are known to be one string; where they aren't, each string gets a
number of its own beside the hash. A document's ordered list of identifiers (its recipe) then stands for its text, so only
chunks, and each distinct one once per map task, are ever moved; long documents are not.

Defined results: null text counts as empty, and all empty texts are one group; a repeated row counts as a row of its own
(all rows with the doc_id that stays are kept); a null doc_id sorts after all others; an empty table gives no rows; columns
other than doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, squeezed

#: A chunk is 512 to 4096 code points and ends after the first of these pairs: ASCII pairs that texts hold often enough,
#: or two code points beyond ASCII.
CHUNK = r"(?s).{510,4094}?(?:[a-f][m-p]|[^\x00-\x7f][^\x00-\x7f]|\z)|.{1,4096}"


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def collided(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame | None:
    """(h, chunk, r) for each distinct chunk whose hash another distinct chunk has; r numbers them from 1. None if there is none."""
    chunks = docs.select(F.explode(chunked(squeezed(F.col("text")))).alias("chunk"))
    chunks = chunks.select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    twice = cut(chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if twice.isEmpty():
        return None
    return chunks.join(twice, "h").withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("chunk")))


def recipes(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_cp, text_sha256, recipe); equal recipes are equal texts without blanks."""
    docs = docs.select("doc_id", "text")
    plain = docs.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).alias("n_cp"),
        squeezed(F.col("text")).alias("norm"),
    ).select("doc_id", "n_cp", F.sha2("norm", 256).alias("text_sha256"), chunked(F.col("norm")).alias("chunks"))
    own = plain.withColumn("recipe", F.transform("chunks", lambda c: F.struct(hashed(c).alias("h"), F.lit(0).alias("r"))))
    bad = collided(docs, hashed)
    if bad is None:
        return own.drop("chunks")
    # Only where a hash stands for two strings: the identifiers of those chunks are looked up by the string itself.
    own = own.withColumn("row", F.struct(F.monotonically_increasing_id().alias("id"), "doc_id", "n_cp", "text_sha256"))
    parts = own.select("row", F.posexplode_outer("chunks").alias("pos", "chunk")).withColumn("h", hashed(F.col("chunk")))
    parts = parts.join(bad, ["h", "chunk"], "left").groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "h", F.coalesce("r", F.lit(0)).alias("r"))))).alias("parts")
    )
    return parts.select("row.doc_id", "row.n_cp", "row.text_sha256", F.transform("parts", lambda p: F.struct(p["h"].alias("h"), p["r"].alias("r"))).alias("recipe"))


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    made = cut(recipes(docs, hashed))
    order = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"))
    # Partial aggregation leaves one row per recipe and task, so a group of any size meets as a few rows.
    groups = made.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    # As a table of its own it is joined straight from a shuffle, whose hot partitions adaptive execution can split.
    groups = cut(groups.select("recipe", F.col("best.doc_id").alias("keep"), "n"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return made.join(groups, "recipe", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
