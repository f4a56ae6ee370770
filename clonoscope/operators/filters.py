"""Filters and collapses of sequence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def criterion(spec: dict) -> Column:
    """A row-wise condition: {"type": IN | NOT_IN | NOT_NA | GREATER_THAN | LESS_THAN, "column", "values" or "threshold"}, or
    {"type": AND | OR, "operands": [...]}. A NULL is not in any list, and neither above nor below a threshold."""
    kind = spec["type"].upper()
    if kind in ("AND", "OR"):
        return reduce((lambda a, b: a & b) if kind == "AND" else (lambda a, b: a | b), map(criterion, spec["operands"]))
    c = F.col(spec["column"])
    if kind == "IN":
        return F.coalesce(c.isin(list(spec["values"])), F.lit(False))
    if kind == "NOT_IN":
        return F.coalesce(~c.isin(list(spec["values"])), F.lit(True))
    if kind == "NOT_NA":
        return c.isNotNull() & ~F.coalesce(c.cast("string") == "NaN", F.lit(False))
    if kind == "GREATER_THAN":
        return F.coalesce(c > spec["threshold"], F.lit(False))
    if kind == "LESS_THAN":
        return F.coalesce(c < spec["threshold"], F.lit(False))
    raise ValueError(f"{kind} needs the whole table; see top_n and random_n")


def top_n(df: DataFrame, column: str, n: int, key: str) -> DataFrame:
    """The n rows with the largest values, ties by key."""
    return df.orderBy(F.col(column).desc_nulls_last(), key).limit(n)


def random_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by hash of their key: the same for the same seed."""
    from .splits import shuffled

    return df.orderBy(*shuffled(key, seed)).limit(n)


def metadata_filter(sequences: DataFrame, metadata: DataFrame, spec: dict, key: str = "repertoire_id") -> tuple[DataFrame, DataFrame]:
    kept = metadata.where(criterion(spec))
    return sequences.join(kept.select(key), key, "left_semi"), kept


def by_length(df: DataFrame, column: str, least: int = -1, most: int = -1) -> DataFrame:
    """Sequences of least to most letters; -1 is no bound."""
    n = F.length(column)
    if least >= 0:
        df = df.where(n >= least)
    return df.where(n <= most) if most >= 0 else df


def pairs_by_length(df: DataFrame, column: str, least: int = -1, most: int = -1, cell: str = "cell_id") -> DataFrame:
    """Receptors of which both chains have such a length."""
    both = F.count("*").over(W.partitionBy(cell))
    return by_length(df, column, least, most).withColumn("__n", both).where("__n = 2").drop("__n")


def by_count(df: DataFrame, least: int, drop_missing: bool = True, count: str = "duplicate_count") -> DataFrame:
    """Sequences counted at least so often; those without a count go or stay."""
    return df.where(F.coalesce(F.col(count) >= least, F.lit(not drop_missing)))


def repertoires_by_size(df: DataFrame, least: int = -1, most: int = -1, key: str = "repertoire_id") -> DataFrame:
    """Rows of repertoires with least to most sequences."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    if least >= 0:
        sizes = sizes.where(F.col("n") >= least)
    if most >= 0:
        sizes = sizes.where(F.col("n") <= most)
    return df.join(sizes.select(key), key, "left_semi")


def chains_only(df: DataFrame, loci: list[str], key: str = "repertoire_id", rows_only: bool = False) -> DataFrame:
    """Repertoires of which every sequence is of these loci; with rows_only, the sequences that are."""
    legal = F.coalesce(F.col("locus").isin(loci), F.lit(False))
    if rows_only:
        return df.where(legal)
    return df.join(df.where(~legal).select(key).distinct(), key, "left_anti")


AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}


def collapsed(df: DataFrame, keys: list[str], first: list[str], order: str, count: str = "duplicate_count", how: str = "sum") -> DataFrame:
    """One row per distinct keys (rows with a NULL key are left out): the first value of other columns by order, and the counts
    aggregated. NULL counts don't take part."""
    value = {"first": F.min_by(count, F.when(F.col(count).isNotNull(), F.col(order))), "last": F.max_by(count, F.when(F.col(count).isNotNull(), F.col(order)))}.get(how)
    value = AGGREGATES[how](count) if value is None else value
    rows = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return rows.groupBy(*keys).agg(*firsts, value.alias(count))


def by_subject(sequences: DataFrame, metadata: DataFrame, order: str = "repertoire_id") -> tuple[DataFrame, DataFrame]:
    """Repertoires of a subject as one; of metadata that differ the last repertoire's count."""
    others = [c for c in metadata.columns if c not in ("repertoire_id", "subject_id")]
    merged = metadata.groupBy("subject_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])
    moved = sequences.join(metadata.select("repertoire_id", "subject_id"), "repertoire_id").drop("repertoire_id").withColumnRenamed("subject_id", "repertoire_id")
    return moved, merged.withColumnRenamed("subject_id", "repertoire_id")


def not_empty(df: DataFrame, what: str = "the result") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def receptors(df: DataFrame, pair: tuple[str, str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Cells with two chains, one row each: of several rows of a cell and locus the best by umi, consensus and duplicate counts."""
    if pair:
        df = df.where(F.col("locus").isin(list(pair)))
    counts = [c for c in ("umi_count", "consensus_count", "duplicate_count") if c in df.columns]
    order = order or [*(F.col(c).desc_nulls_last() for c in counts), F.col("sequence_id")]
    best = df.withColumn("__r", F.row_number().over(W.partitionBy("cell_id", "locus").orderBy(*order))).where("__r = 1").drop("__r")
    return best.withColumn("__n", F.count("*").over(W.partitionBy("cell_id"))).where("__n = 2").drop("__n")


def in_order(df: DataFrame, order: str, cell: str = "cell_id") -> DataFrame:
    """Rows sorted by the place (a column) at which their cell is first, then by locus: the chains of a receptor side by side."""
    first = df.groupBy(cell).agg(F.min(order).alias("__first"))
    return df.join(first, cell).orderBy("__first", cell, "locus", order).drop("__first")


def paired(df: DataFrame, columns: list[str], cell: str = "cell_id") -> DataFrame:
    """One row per cell of two chains: columns as c_1 and c_2, by locus."""
    number = F.row_number().over(W.partitionBy(cell).orderBy("locus", *columns))
    df = df.withColumn("__i", number).withColumn("__n", F.count("*").over(W.partitionBy(cell))).where("__n = 2")
    named = [F.max(F.when(F.col("__i") == i, F.col(c))).alias(f"{c}_{i}") for c in ["locus", *columns] for i in (1, 2)]
    return df.groupBy(cell).agg(*named)
