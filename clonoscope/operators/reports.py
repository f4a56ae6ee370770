"""Result tables of reports, built from the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from . import joins as J
from . import stats as A


def match_summary(df: DataFrame, matched: DataFrame, row: str = "sequence_id", key: str = "repertoire_id") -> DataFrame:
    """(key, matches, share, clonal_share): of an example's sequences those that are in matched (row), as a number, a percentage of its
    rows, and of its counts."""
    marked = df.join(matched.select(row).distinct().withColumn("__m", F.lit(1)), row, "left")
    m = F.col("__m").isNotNull()
    return marked.groupBy(key).agg(
        F.count_if(m).alias("matches"),
        (100.0 * F.count_if(m) / F.count("*")).alias("share"),
        (100.0 * F.coalesce(F.sum(F.when(m, F.col("duplicate_count"))), F.lit(0)) / F.sum("duplicate_count")).alias("clonal_share"),
    )


def distance_histogram(df: DataFrame, group: str, seq: str = "seq", row: str = "sequence_id") -> DataFrame:
    """(group, distance, share): Hamming distances of all pairs of a group's sequences of one length. Equal sequences are counted
    first, so that pairs are of distinct ones."""
    kinds = df.groupBy(group, seq).agg(F.count("*").alias("c")).withColumn("l", F.length(seq))
    a, b = kinds.alias("a"), kinds.alias("b")
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.l") == F.col("b.l")) & (F.col(f"a.{seq}") < F.col(f"b.{seq}"))
    different = a.join(b, on).select(F.col(f"a.{group}").alias(group), X.hamming(F.col(f"a.{seq}"), F.col(f"b.{seq}")).alias("distance"), (F.col("a.c") * F.col("b.c")).alias("n"))
    same = kinds.where("c > 1").select(group, F.lit(0).alias("distance"), F.expr("c * (c - 1) div 2").alias("n"))
    out = different.union(same).groupBy(group, "distance").agg(F.sum("n").alias("n"))
    return out.select(group, "distance", (F.col("n") / F.sum("n").over(W.partitionBy(group))).alias("share"))


def significant_features(presence: dict[int, DataFrame], labels: DataFrame, thresholds: list[float], key: str = "repertoire_id") -> DataFrame:
    """(k, p, positive, relevant): for each feature size and threshold the relevant features of each example's class, on average.
    The tests of a size run once for all thresholds."""
    parts = []
    for k, present in presence.items():
        tested = A.with_fisher(A.contingency(present, labels, ["item"], key)).select("item", "p_value")
        joined = present.join(tested, "item").join(labels, key)
        for p in thresholds:
            own = joined.groupBy(key, "positive").agg(F.count_if(F.col("p_value") < p).alias("n"))
            parts.append(own.groupBy("positive").agg(F.avg("n").alias("relevant")).select(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), "positive", "relevant"))
    return reduce(DataFrame.unionByName, parts)


def recovered(found: DataFrame, truth: DataFrame, columns: list[str]) -> DataFrame:
    """(only_found, both, only_truth): distinct rows."""
    side = lambda df, name: df.select(*columns).distinct().withColumn(name, F.lit(True))
    both = side(found, "f").join(side(truth, "t"), columns, "full")
    return both.agg(F.count_if(F.col("t").isNull()).alias("only_found"), F.count_if(F.col("f") & F.col("t")).alias("both"), F.count_if(F.col("f").isNull()).alias("only_truth"))


def relevant_presence(present: DataFrame, items: DataFrame, key: str = "repertoire_id") -> DataFrame:
    """(item..., examples): how many examples have each relevant item."""
    return present.join(items, items.columns, "left_semi").groupBy(*items.columns).agg(F.countDistinct(key).alias("examples"))


def setting_performance(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of scores per group; NULL where a score is missing."""
    whole = F.count("*") == F.count("score")
    return scores.groupBy(*by).agg(F.when(whole, F.avg("score")).alias("mean"), F.when(whole, F.stddev_samp("score")).alias("sd"))


def optimal_setting(winners: DataFrame, setting: str = "setting") -> DataFrame:
    """The setting that won most splits, the first by name at a tie."""
    return winners.groupBy(setting).agg(F.count("*").alias("n")).orderBy(F.desc("n"), setting).limit(1)


def errors_by(df: DataFrame, level: str, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(level, fp, fn): wrong guesses by the value of another column."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    return df.groupBy(level).agg(F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))


def origin_shares(df: DataFrame, origin: str, signals: list[str]) -> DataFrame:
    """(origin, signal, share): of each origin's sequences those with a signal."""
    flags = F.explode(F.map_from_arrays(F.array(*map(F.lit, signals)), F.array(*signals))).alias("signal", "has")
    return df.select(origin, flags).groupBy(origin, "signal").agg((F.count_if("has") / F.count("*")).alias("share"))


def conditional(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, joint, given): P(a and b) and P(a | b) of boolean columns."""
    pairs = [(a, b) for a in names for b in names]
    aggs = [F.count_if(F.col(a) & F.col(b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"n{pairs.index((b, b))}").alias("m")) for i, (a, b) in enumerate(pairs)])
    rows = df.agg(F.count("*").alias("t"), *aggs).select("t", F.explode(table).alias("x"))
    return rows.select("x.a", "x.b", (F.col("x.n") / F.col("t")).alias("joint"), F.try_divide("x.n", "x.m").alias("given"))


def degree_summary(degrees: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of the number of sequences per degree over repertoires (by..., degree, sequences)."""
    return degrees.groupBy(*by, "degree").agg(F.avg("sequences").alias("mean"), F.stddev_samp("sequences").alias("sd"))


def motif_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """Motifs' confusion counts in training and test data side by side."""
    side = lambda df, name: df.select("motif", *[F.col(c).alias(f"{name}_{c}") for c in ("tp", "fp", "fn", "tn")])
    return side(train, "train").join(side(test, "test"), "motif")


def receptor_matches(matches: DataFrame, receptors: DataFrame) -> DataFrame:
    """Matches of receptors with the columns of both chains, side by side."""
    return matches.join(receptors, "cell_id")


def near_items(a: DataFrame, b: DataFrame, most: int = 1) -> DataFrame:
    """Sequences (id, seq, v_call, j_call) of a that have one of b within the distance."""
    return a.join(J.hamming_pairs(a, b, most).select(F.col("id_1").alias("id")).distinct(), "id", "left_semi")


def top_coefficients(df: DataFrame, n: int, value: str = "value") -> DataFrame:
    """The n rows (feature, value) that are farthest from 0, ties by feature."""
    return df.orderBy(F.abs(value).desc(), "feature").limit(n)


def exploded_label(df: DataFrame, label: str, separator: str = ",") -> DataFrame:
    """A row for each element of a label that is a list, or a text of elements."""
    column = F.col(label) if df.schema[label].dataType.typeName() == "array" else F.transform(F.split(label, separator), lambda x: F.trim(x))
    return df.withColumn(label, F.explode(column))


def index_by_label(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by..., mean, sd, scores): a validity index over the runs of each label, the values in ascending order."""
    return scores.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.sort_array(F.collect_list(score)).alias("scores"))


def with_feature_totals(examples: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, feature, value, total): an example's values, 0 for the features that it lacks, with each feature's sum over all examples."""
    totals = values.groupBy("feature").agg(F.sum("value").alias("total"))
    grid = examples.select(key).distinct().join(J.bounded(totals))
    return grid.join(values.select(key, "feature", "value"), [key, "feature"], "left").na.fill(0.0, ["value"]).select(key, "feature", "value", "total")


def matches_table(examples: DataFrame, labels: list[str], counts: DataFrame, key: str = "repertoire_id", value: str = "matches") -> DataFrame:
    """(key, labels..., feature, matches): examples with their labels and non-zero match counts; examples without any have NULLs."""
    return examples.select(key, *labels).join(counts.select(key, "feature", value), key, "left")


def relevant_table(items: DataFrame, names: dict[str, str]) -> DataFrame:
    """Relevant sequences for export, their columns renamed; columns that aren't named are left out."""
    return items.select(*[F.col(a).alias(b) for a, b in names.items()]).distinct()
