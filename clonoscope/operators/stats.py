"""Counts, diversity, association tests, distances and metrics."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What an item gets that one repertoire has at most.
UNTESTED = 2.0


def histogram(df: DataFrame, columns: list[str], share_by: list[str] | None = None) -> DataFrame:
    """Row counts per value of columns; share_by: with the share among rows of the same values there."""
    out = df.groupBy(*columns).agg(F.count("*").alias("n"))
    if share_by is not None:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*share_by)))
    return out


def letters_by_position(df: DataFrame, seq: str = "seq", by: list[str] | None = None, imgt: bool = False) -> DataFrame:
    """(by, position, letter, n, share): letters at each position (from 1, or by IMGT name) and their share there."""
    from ..functions.text import imgt_positions, kmers

    by = by or []
    parts = df.select(*by, F.posexplode(kmers(seq, 1)).alias("i", "letter"), F.length(seq).alias("l"))
    place = F.get(imgt_positions(F.col("l")), F.col("i")) if imgt else (F.col("i") + 1).cast("string")
    parts = parts.select(*by, place.alias("position"), "letter").where("position IS NOT NULL")
    out = parts.groupBy(*by, "position", "letter").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by, "position")))


def frequency_change(df: DataFrame, label: str, a: str, b: str, seq: str = "seq") -> DataFrame:
    """(position, letter, change): the share in class a less that in class b, for all that either has."""
    got = letters_by_position(df, seq, [label])
    side = lambda v, name: got.where(F.col(label) == v).select("position", "letter", F.col("share").alias(name))
    both = side(a, "x").join(side(b, "y"), ["position", "letter"], "full")
    return both.select("position", "letter", (F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("change"))


def clonotypes(df: DataFrame, key: str = "repertoire_id", columns: tuple[str, ...] = ("seq", "v_call", "j_call"), approximate: bool = False) -> DataFrame:
    """(key, clonotypes): distinct combinations of columns."""
    kinds = F.struct(*columns)
    return df.groupBy(key).agg((F.approx_count_distinct(kinds) if approximate else F.countDistinct(kinds)).alias("clonotypes"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) for all combinations of values, zeros included."""
    grid = df.select(row).distinct().crossJoin(df.select(column).distinct())
    return grid.join(df.groupBy(row, column).agg(F.count("*").alias("n")), [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shares(df: DataFrame, key: str = "repertoire_id", count: str = "duplicate_count") -> DataFrame:
    """Each row's share of its example's counts; rows without a positive count are left out."""
    df = df.where(F.col(count) > 0)
    return df.withColumn("p", F.col(count) / F.sum(count).over(W.partitionBy(key)))


def shannon(df: DataFrame, key: str = "repertoire_id", count: str = "duplicate_count") -> DataFrame:
    """(key, shannon) from two sums in one pass: H = ln(N) - sum(c ln c) / N."""
    c = F.col(count).cast("double")
    total = F.sum(c)
    return df.where(F.col(count) > 0).groupBy(key).agg((F.ln(total) - F.sum(c * F.ln(c)) / total).alias("shannon"))


def renyi(df: DataFrame, alphas: list[float], key: str = "repertoire_id", count: str = "duplicate_count") -> DataFrame:
    """(key, alpha, entropy, n): one pass with an aggregate per alpha. 1 is Shannon's, infinity the min-entropy."""
    c = F.col(count).cast("double")
    sums = [F.sum(F.pow(c, F.lit(float(a)))).alias(f"s{i}") for i, a in enumerate(alphas)]
    rows = df.where(F.col(count) > 0).groupBy(key).agg(F.sum(c).alias("t"), F.sum(c * F.ln(c)).alias("e"), F.max(c).alias("m"), F.count("*").alias("n"), *sums)

    def one(i: int, a: float) -> Column:
        if abs(a - 1) < 1e-10:
            return F.ln("t") - F.col("e") / F.col("t")
        if a == float("inf"):
            return -F.ln(F.col("m") / F.col("t"))
        return (F.ln(f"s{i}") - a * F.ln("t")) / (1 - a)

    table = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), one(i, a).alias("entropy")) for i, a in enumerate(alphas)])
    return rows.select(key, "n", F.explode(table).alias("x")).select(key, "x.alpha", "x.entropy", "n")


def evenness(df: DataFrame, alphas: list[float], key: str = "repertoire_id", count: str = "duplicate_count") -> DataFrame:
    """(key, alpha, evenness): exp(entropy) per clone."""
    return renyi(df, alphas, key, count).select(key, "alpha", (F.exp("entropy") / F.col("n")).alias("evenness"))


def contingency(present: DataFrame, labels: DataFrame, item: list[str], key: str = "repertoire_id") -> DataFrame:
    """present (key, item...), labels (key, positive): for each item the examples positive_present, negative_present,
    positive_absent and negative_absent."""
    totals = labels.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    one = present.join(labels, key).groupBy(*item).agg(F.count_if("positive").alias("positive_present"), F.count_if(~F.col("positive")).alias("negative_present"))
    return one.crossJoin(F.broadcast(totals)).select(*item, "positive_present", "negative_present", (F.col("p") - F.col("positive_present")).alias("positive_absent"), (F.col("q") - F.col("negative_present")).alias("negative_absent"))


def fisher_right(a: int, b: int, c: int, d: int) -> float:
    """P of a or more in the first cell of a 2 x 2 table with these margins."""
    n, row, col = a + b + c + d, a + b, a + c
    const = lgamma(row + 1) + lgamma(n - row + 1) + lgamma(col + 1) + lgamma(n - col + 1) - lgamma(n + 1)
    from math import exp

    return min(1.0, sum(exp(const - lgamma(k + 1) - lgamma(row - k + 1) - lgamma(col - k + 1) - lgamma(n - row - col + k + 1)) for k in range(a, min(row, col) + 1)))


def with_fisher(tables: DataFrame) -> DataFrame:
    """tables with p_value: right-tailed, UNTESTED for items of one example at most. The test runs once for each distinct table."""
    cells = ["positive_present", "negative_present", "positive_absent", "negative_absent"]

    @F.pandas_udf("double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_right(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)

    kinds = tables.where(F.col(cells[0]) + F.col(cells[1]) > 1).select(*cells).distinct().withColumn("p_value", test(*cells))
    return tables.join(kinds, cells, "left").withColumn("p_value", F.coalesce("p_value", F.lit(UNTESTED)))


def relevant(present: DataFrame, labels: DataFrame, item: list[str], threshold: float, key: str = "repertoire_id") -> DataFrame:
    """The items with a p-value below the threshold."""
    return with_fisher(contingency(present, labels, item, key)).where(F.col("p_value") < threshold).select(*item)


def abundance(present: DataFrame, items: DataFrame, key: str = "repertoire_id") -> DataFrame:
    """(key, relevant, total): how many of an example's items are relevant, and how many there are."""
    names = [c for c in items.columns]
    marked = present.join(items.withColumn("__r", F.lit(1)), names, "left")
    return marked.groupBy(key).agg(F.count("__r").alias("relevant"), F.count("*").alias("total"))


def shared_items(present: DataFrame, item: list[str], key: str = "repertoire_id") -> DataFrame:
    """(r1, r2, shared, n1, n2) of all pairs r1 <= r2 of examples, those that share nothing included."""
    from .products import shared

    return shared(present, item, key)


def jaccard(pairs: DataFrame) -> DataFrame:
    i = F.col("shared")
    return pairs.select("r1", "r2", (1 - i / (F.col("n1") + F.col("n2") - i)).alias("distance"))


def morisita_horn_binary(pairs: DataFrame) -> DataFrame:
    """Of presence: sums and sums of squares are the sizes."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    return pairs.select("r1", "r2", (1 - 2 * F.col("shared") / ((1 / n1 + 1 / n2) * n1 * n2)).alias("distance"))


def morisita_horn(overlap: DataFrame, totals: DataFrame) -> DataFrame:
    """overlap (r1, r2, overlap) of all pairs with the diagonal, totals (r, total): negative distances are 0."""
    self_overlap = overlap.where("r1 = r2").select(F.col("r1").alias("r"), F.col("overlap").alias("own"))
    size = totals.join(self_overlap, "r", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    a = size.select(F.col("r").alias("r1"), F.col("total").alias("t1"), F.col("own").alias("o1"))
    b = size.select(F.col("r").alias("r2"), F.col("total").alias("t2"), F.col("own").alias("o2"))
    grid = a.join(b, F.col("r1") <= F.col("r2")).join(overlap, ["r1", "r2"], "left")
    return morisita_horn_sums(grid)


def morisita_horn_sums(pairs: DataFrame) -> DataFrame:
    """pairs (r1, r2, overlap, t1, t2, o1, o2): with each one's total and overlap with itself."""
    x = 2 * F.coalesce("overlap", F.lit(0.0)) / ((F.col("o1") / (F.col("t1") * F.col("t1")) + F.col("o2") / (F.col("t2") * F.col("t2"))) * F.col("t1") * F.col("t2"))
    return pairs.select("r1", "r2", F.greatest(1 - x, F.lit(0.0)).alias("distance"))


def overlap_percent(pairs: DataFrame) -> DataFrame:
    return pairs.select("r1", "r2", F.round(100.0 * F.col("shared") / F.least("n1", "n2"), 2).alias("percent"))


# metrics


def confusion(df: DataFrame, truth: str = "truth", guess: str = "guess", by: list[str] | None = None) -> DataFrame:
    """(by, truth, guess, n)."""
    return df.groupBy(*(by or []), truth, guess).agg(F.count("*").alias("n"))


def binary_metrics(df: DataFrame, truth: str = "truth", guess: str = "guess", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and from them accuracy, balanced accuracy, precision, recall, specificity, f1, mcc; 0 where undefined."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    cells = df.groupBy(*(by or [])).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, specificity, precision = part(c["tp"], c["tp"] + c["fn"]), part(c["tn"], c["tn"] + c["fp"]), part(c["tp"], c["tp"] + c["fp"])
    root = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    return cells.withColumns({
        "accuracy": part(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "f1": part(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
        "mcc": part(c["tp"] * c["tn"] - c["fp"] * c["fn"], root),
    })


def macro_metrics(df: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Precision, recall and F1 per class of truth and guess: averaged (macro), weighted by support, and over all (micro)."""
    n = confusion(df, truth, guess)
    tp = n.where(F.col(truth) == F.col(guess)).select(F.col(truth).alias("c"), F.col("n").alias("tp"))
    support = n.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("support"))
    guessed = n.groupBy(F.col(guess).alias("c")).agg(F.sum("n").alias("guessed"))
    rows = support.join(guessed, "c", "full").join(tp, "c", "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    rows = rows.withColumns({"p": p, "r": r, "f": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))})
    total = F.sum("support")
    return rows.agg(*[F.avg(x).alias(f"{name}_macro") for x, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))], *[(F.sum(F.col(x) * F.col("support")) / total).alias(f"{name}_weighted") for x, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))], (F.sum("tp") / total).alias("f1_micro"))


def auc(df: DataFrame, truth: str = "truth", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from counts per distinct score: ties count half. Only distinct scores are put in order."""
    by = by or []
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).cast("double").alias("p"), F.count_if(F.col(truth) != 1).cast("double").alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = counts.withColumn("w", F.col("p") * (below + F.col("q") / 2))
    return rows.groupBy(*by).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("auc"))


def roc_points(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr): of guessing positive from a score on."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("q"))
    down = W.orderBy(F.desc("threshold"))
    all_rows = W.partitionBy()
    return counts.select("threshold", (F.sum("q").over(down) / F.sum("q").over(all_rows)).alias("fpr"), (F.sum("p").over(down) / F.sum("p").over(all_rows)).alias("tpr"))


def log_loss(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg((-F.avg(F.when(F.col(truth) == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"))


def clustering_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """From the contingency table of two labelings: rand, adjusted_rand, mutual_information, nmi (arithmetic), homogeneity,
    completeness, v_measure, fowlkes_mallows and purity."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("x"), F.max("n").alias("best"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("y"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    t = cells.agg(F.sum("n").alias("t"), F.sum(two("n")).alias("cc"), F.sum(F.col("n") * F.ln("n")).alias("cl"))
    r = rows.agg(F.sum(two("x")).alias("rc"), F.sum(F.col("x") * F.ln("x")).alias("rl"), F.sum("best").alias("best"))
    c = cols.agg(F.sum(two("y")).alias("kc"), F.sum(F.col("y") * F.ln("y")).alias("kl"))
    m = t.crossJoin(r).crossJoin(c)
    n = F.col("t")
    pairs = n * (n - 1) / 2
    expected = F.col("rc") * F.col("kc") / pairs
    ha, hb = F.ln(n) - F.col("rl") / n, F.ln(n) - F.col("kl") / n
    mi = F.ln(n) + (F.col("cl") - F.col("rl") - F.col("kl")) / n
    part = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(1.0))
    return m.select(
        ((pairs + 2 * F.col("cc") - F.col("rc") - F.col("kc")) / pairs).alias("rand"),
        part(F.col("cc") - expected, (F.col("rc") + F.col("kc")) / 2 - expected).alias("adjusted_rand"),
        mi.alias("mutual_information"),
        part(2 * mi, ha + hb).alias("nmi"),
        part(mi, ha).alias("homogeneity"),
        part(mi, hb).alias("completeness"),
        part(2 * mi, ha + hb).alias("v_measure"),
        F.coalesce(F.try_divide(F.col("cc"), F.sqrt(F.col("rc") * F.col("kc"))), F.lit(0.0)).alias("fowlkes_mallows"),
        (F.col("best") / n).alias("purity"),
    )


def mean_and_error(df: DataFrame, by: list[str], value: str = "value", error: str = "std") -> DataFrame:
    """Mean and population deviation (std) or its standard error (sem) per group."""
    e = F.stddev_pop(value)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (e if error == "std" else e / F.sqrt(F.count(value))).alias("error"))


def feature_comparison(df: DataFrame, label: str, x: str, y: str, keep: float = 1.0) -> DataFrame:
    """(feature, x, y): mean values in two classes, of the share `keep` of features that differ most."""
    means = df.groupBy("feature", label).agg(F.avg("value").alias("v"))
    side = lambda v, name: means.where(F.col(label) == v).select("feature", F.col("v").alias(name))
    both = side(x, "x").join(side(y, "y"), "feature")
    if keep < 1:
        order = W.orderBy(F.abs(F.col("x") - F.col("y")).desc(), "feature")
        both = both.withColumn("r", F.percent_rank().over(order)).where(F.col("r") <= keep).drop("r")
    return both


def brier(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """(brier): the mean squared difference of score and truth (1 or not)."""
    return df.agg(F.avg(F.pow(F.col(score) - (F.col(truth) == 1).cast("int"), F.lit(2.0))).alias("brier"))


def average_precision(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """(average_precision): the mean over positives of the precision at their score. Rows are counted per score first, and ahead of it
    by ranges of the score, so that no task sees all scores."""
    t = F.col(truth) == 1
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(t).alias("p"), F.count("*").alias("n"))
    counts = counts.withColumn("b", F.floor(F.col("s") * 4096))
    ahead = counts.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    ahead = ahead.select("b", *[F.coalesce(F.sum(f"b{c}").over(above), F.lit(0)).alias(f"a{c}") for c in "pn"])
    within = W.partitionBy("b").orderBy(F.desc("s"))
    rows = counts.join(ahead, "b").select("p", *[(F.sum(c).over(within) + F.col(f"a{c}")).alias(f"c{c}") for c in "pn"])
    return rows.agg((F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.sum("p")).alias("average_precision"))


def multiclass_auc(df: DataFrame, pairwise: bool = False, truth: str = "truth", name: str = "class", score: str = "score") -> DataFrame:
    """(auc): the mean area under the ROC curve over classes, from rows (truth, class, score) of each example and class: each class against
    all others, or pairwise against one other in turn. Rows are counted per distinct score first; a class without rows of both sides has no area."""
    counts = df.groupBy(F.col(name).alias("c"), F.col(score).alias("s"), F.col(truth).alias("t")).agg(F.count("*").cast("double").alias("n"))
    own, other = counts.where("t = c"), counts.where("t <> c")
    if pairwise:
        other = other.select("c", "s", F.col("t").alias("o"), F.lit(0.0).alias("p"), F.col("n").alias("q"))
        against = other.select("c", "o").distinct()
        sides = own.select("c", "s", F.col("n").alias("p")).join(against, "c").select("c", "s", "o", "p", F.lit(0.0).alias("q")).union(other)
    else:
        sides = counts.select("c", "s", F.lit("").alias("o"), F.when(F.col("t") == F.col("c"), F.col("n")).otherwise(0.0).alias("p"), F.when(F.col("t") != F.col("c"), F.col("n")).otherwise(0.0).alias("q"))
    points = sides.groupBy("c", "o", "s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy("c", "o").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    areas = points.withColumn("w", F.col("p") * (below + F.col("q") / 2)).groupBy("c", "o")
    return areas.agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("a")).agg(F.avg("a").alias("auc"))


def internal_indices(df: DataFrame, size: int, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """(calinski_harabasz, davies_bouldin) of clusters of rows with feature arrays of a size: the scatter between clusters over that within,
    each by its degrees of freedom (1 if there is none within), and the mean over clusters of the worst ratio of spreads to distance."""
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    mean = F.array(*[F.avg(F.get(features, i)) for i in range(size)])
    middle = df.groupBy(F.col(cluster).alias("c")).agg(mean.alias("m"), F.count("*").alias("n"))
    d2 = far(F.col(features), F.col("m"))
    spread = df.join(middle, F.col(cluster) == F.col("c")).groupBy("c").agg(F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("s"))
    spread = spread.join(middle, "c").join(df.agg(mean.alias("g")), F.lit(True))
    total = F.sum("n")
    within, between = F.sum("w") / (total - F.count("*")), F.sum(F.col("n") * far(F.col("m"), F.col("g"))) / (F.count("*") - 1)
    first = spread.agg(F.when(F.sum("w") == 0, 1.0).otherwise(between / within).alias("calinski_harabasz"))
    side = spread.select(F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    pairs = spread.select("c", "m", "s").join(side, F.col("c") != F.col("c2"))
    worst = pairs.groupBy("c").agg(F.max(F.coalesce(F.try_divide(F.col("s") + F.col("s2"), F.sqrt(far(F.col("m"), F.col("m2")))), F.lit(0.0))).alias("r"))
    return first.join(worst.agg(F.avg("r").alias("davies_bouldin")), F.lit(True))


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(expected, adjusted): mutual information that labelings of these cluster sizes have by chance, and what is left of theirs beyond it, as a
    share of the mean entropy's. The expectation is taken once for each two distinct sizes, of which there are few."""
    from .joins import bounded

    sizes = lambda c, name: df.groupBy(c).agg(F.count("*").alias(name)).groupBy(name).agg(F.count("*").alias(f"{name}_times"))
    n = df.agg(F.count("*").alias("t"))
    grid = sizes(a, "x").join(bounded(sizes(b, "y")), F.lit(True)).join(F.broadcast(n), F.lit(True))

    @F.pandas_udf("double")
    def chance(x: pd.Series, y: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([expected_information(int(i), int(j), int(k)) for i, j, k in zip(x, y, t, strict=True)], dtype="float64")

    made = grid.agg(F.sum(chance("x", "y", "t") * F.col("x_times") * F.col("y_times")).alias("expected"))
    entropy = lambda c, name: df.groupBy(c).agg(F.count("*").alias("x")).join(F.broadcast(n), F.lit(True)).agg((-F.sum(F.col("x") / F.col("t") * F.ln(F.col("x") / F.col("t")))).alias(name))
    mi = clustering_agreement(df, a, b).select("mutual_information")
    row = made.join(mi, F.lit(True)).join(entropy(a, "ha"), F.lit(True)).join(entropy(b, "hb"), F.lit(True))
    mean = (F.col("ha") + F.col("hb")) / 2
    return row.select("expected", F.coalesce(F.try_divide(F.col("mutual_information") - F.col("expected"), mean - F.col("expected")), F.lit(1.0)).alias("adjusted"))


def expected_information(x: int, y: int, t: int) -> float:
    """The expected share of two clusters of sizes x and y of t rows in the mutual information: over the sizes n that their intersection can have,
    by the hypergeometric distribution, whose probabilities follow from each other."""
    lo, hi = max(1, x + y - t), min(x, y)
    n = np.arange(lo, hi + 1, dtype=np.float64)
    steps = np.log(x - n[:-1]) + np.log(y - n[:-1]) - np.log(n[1:]) - np.log(t - x - y + n[1:])
    start = lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(lo + 1) - lgamma(x - lo + 1) - lgamma(y - lo + 1) - lgamma(t - x - y + lo + 1)
    logs = start + np.concatenate([[0.0], np.cumsum(steps)])
    return float((n / t * np.log(t * n / (x * y)) * np.exp(logs)).sum())
