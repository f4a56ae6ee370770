"""Splits and samples. Random ones order by the MD5 of the key and a seed: exact in size, and the same again for the same seed, in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shuffled(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """df with `place` (from 0) in the order, which begins with a hash; within each value of the columns by. Rows are dealt out by
    65,536 ranges of the hash, counted, and numbered within their range, so that no task sees all of a value."""
    by = by or []
    keys = ["__b", *(f"__k{i}" for i in range(len(by)))]
    dealt = df.withColumns({"__b": F.conv(F.substring(order[0], 1, 4), 16, 10).cast("int")} | {k: F.to_json(F.struct(c)) for k, c in zip(keys[1:], by, strict=True)})
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys[1:]).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return dealt.join(ahead, keys).withColumn("place", within - 1 + F.col("__ahead")).drop(*keys, "__ahead")


def random_split(examples: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """examples with `part`: train for exactly int(n * share) of them, test for the others. A share above 1 is in per cent."""
    share = share / 100 if share > 1 else share
    n = int(examples.count() * share)
    return ranked(examples, shuffled(key, seed)).withColumn("part", F.when(F.col("place") < n, "train").otherwise("test")).drop("place")


def k_fold(examples: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """examples with `fold` (0 to k - 1), folds differing by one row at most."""
    return ranked(examples, shuffled(key, seed)).withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def stratified_k_fold(examples: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """As k_fold, within each value of a label."""
    return ranked(examples, shuffled(key, seed), [label]).withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def leave_one_out(examples: DataFrame, key: str) -> DataFrame:
    """examples with `fold`: a number of its own for each."""
    return ranked(examples, shuffled(key, 0)).withColumnRenamed("place", "fold")


def leave_group_out(examples: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(fold, group value, test): for each value of a column with at least `least` rows a fold, whose test rows have the value."""
    counts = examples.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    folds = counts.select(F.col(group).alias("held_out"), (F.row_number().over(W.orderBy(group)) - 1).alias("fold"))
    return examples.crossJoin(folds).withColumn("part", F.when(F.col(group).eqNullSafe(F.col("held_out")), "test").otherwise("train"))


def manual_split(examples: DataFrame, key: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """examples with `part` by two lists of ids; others are left out."""
    lists = train.select(key).distinct().withColumn("part", F.lit("train")).union(test.select(key).distinct().withColumn("part", F.lit("test")))
    return examples.join(lists, key)


def sample(examples: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Exactly round(n * share) rows, without replacement."""
    n = round(examples.count() * share)
    return examples.orderBy(*shuffled(key, seed)).limit(n)


def subsample(sequences: DataFrame, n: int, key: str = "repertoire_id", row: str = "sequence_id", seed: int = 0) -> DataFrame:
    """At most n sequences of each repertoire."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*shuffled(row, seed)))
    return sequences.withColumn("__p", place).where(F.col("__p") <= n).drop("__p")
