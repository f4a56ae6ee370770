"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is its share by weight of all words, at most `most` times its own words; what is cut off goes to the others by
weight until none is above. Every document of a source then expects target / source_size copies. Within its source, in a
fixed order by size class and hash, the expected copies are summed up, one random offset is added, and a document is
emitted once for each integer that its stretch of the sum crosses. Order by size makes the words taken come near the target.

The running sum needs no task to hold a source: documents are counted by (source, size class, slice of the hash), slices hold
about `SLICE` rows, and only the counts are summed up in order.

Defined results: null text has size 0; a null source is a source of its own, after all others; the empty string is one, too;
repeated rows are sampled as rows of their own; a source without words has target 0 and takes nothing; an empty table
gives no rows. Columns of the input travel as one value apart from those made here, so no name clashes and none is changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, md5_u32

#: Rows that one slice of a size class holds, about.
SLICE = 256
MADE = ["size", "source_size", "target", "copies", "taken"]


def targets(sizes: DataFrame, most: int = 3, seed: int = 0) -> DataFrame:
    """sizes (skey, source_size) as (skey, source_size, target, offset). One row per source; sources are few beside documents."""
    everything = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy("skey")))
    ranked = ranked.withColumns({"w": (F.col("rank") - 1) % 3 + 1, "cap": F.col("source_size") * most})
    # Filling up in the order of cap per weight: the first source that its share doesn't exceed sets the level for all later ones.
    rising = W.orderBy(F.col("cap").cast("double") / F.col("w"), "rank")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    level = ranked.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "place": F.row_number().over(rising),
    })
    share = F.col("left").cast("double") * F.col("w") / F.col("weights")
    level = level.withColumn("first", F.min_by(F.struct("place", "left", "weights"), F.when(share <= F.col("cap"), F.col("place"))).over(everything))
    return level.select(
        "skey",
        "source_size",
        F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double"))
        .otherwise(F.col("first.left").cast("double") * F.col("w") / F.col("first.weights"))
        .alias("target"),
        (md5_u32(F.concat(F.lit(f"mix:{seed}:"), F.col("rank").cast("string"))) / F.lit(4294967296.0)).alias("offset"),
    )


def mixed(docs: DataFrame, most: int = 3, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """For docs (doc_id, text, source, ...) the columns row (a struct of their columns, or of those in keep), doc_id, size, source_size,
    target, copies and taken."""
    row = F.struct(*(F.col(f"`{x}`") for x in keep or docs.columns)).alias("row")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    docs = docs.select(row, "doc_id", size.alias("size"), skey.alias("__skey"))
    digits = F.col("size").cast("string")
    # The class is the size's first two digits.
    docs = docs.withColumns({
        "__class": F.rpad(F.substring(digits, 1, 2), F.length(digits), F.lit("0")).cast("long"),
        "__h": md5_u32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
    })
    docs = cut(docs)  # words are counted once
    classes = docs.groupBy("__skey", "__class").agg(F.count("*").alias("__n"), F.sum("size").alias("__words"))
    sources = targets(classes.groupBy("__skey").agg(F.sum("__words").alias("source_size")).withColumnRenamed("__skey", "skey"), most, seed)
    classes = classes.withColumns({
        "__slices": F.ceil(F.col("__n") / SLICE),
        "__before": F.coalesce(F.sum("__n").over(W.partitionBy("__skey").orderBy("__class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    # Tables of their own, so that the joins read plain shuffles, whose hot partitions adaptive execution can split.
    classes = cut(classes.select("__skey", "__class", "__slices", "__before"))
    docs = docs.join(classes.select("__skey", "__class", "__slices"), ["__skey", "__class"])
    docs = docs.withColumn("__slice", F.shiftright(F.col("__h") * F.col("__slices"), 32)).drop("__slices")
    within = W.partitionBy("__skey", "__class").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = docs.groupBy("__skey", "__class", "__slice").agg(F.count("*").alias("__n"))
    slices = slices.withColumn("__ahead", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(classes, ["__skey", "__class"])
    slices = slices.join(sources.withColumnRenamed("skey", "__skey"), "__skey").select(
        "__skey", "__class", "__slice", (F.col("__ahead") + F.col("__before")).alias("__ahead"), "source_size", "target", "offset"
    ).withColumnRenamed("offset", "__offset")
    slices = cut(slices)
    docs = docs.join(slices, ["__skey", "__class", "__slice"])
    place = F.row_number().over(W.partitionBy("__skey", "__class", "__slice").orderBy("__h", "doc_id")) + F.col("__ahead")
    docs = docs.withColumns({"__place": place, "__each": F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))})
    crossed = F.floor(F.col("__each") * F.col("__place") + F.col("__offset")) - F.floor(F.col("__each") * (F.col("__place") - 1) + F.col("__offset"))
    docs = docs.withColumn("copies", F.least(crossed, F.lit(most)).cast("int"))
    return docs.withColumn("taken", F.col("copies") * F.col("size")).select("row", "doc_id", *MADE)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source)."""
    return mixed(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def sampled(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, in the columns of docs."""
    return mixed(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, rank) AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weights FROM w
), f AS (
  SELECT place AS first_place, rest AS first_rest, weights AS first_weights FROM l WHERE rest::DOUBLE * w / weights <= cap ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN place < first_place THEN cap::DOUBLE ELSE first_rest::DOUBLE * w / first_weights END AS target,
         ('0x' || substr(md5('mix:0:' || rank), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l, f
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source
      ORDER BY rpad(substr(size::VARCHAR, 1, 2), length(size::VARCHAR)::INT, '0')::BIGINT, h, doc_id) AS i FROM d
), c AS (
  SELECT doc_id, size, source_size, target, i, u, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS each
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, least(floor(each * i + u) - floor(each * (i - 1) + u), 3)::BIGINT * size AS taken FROM c
"""
