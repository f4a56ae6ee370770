"""Learning: classifiers, clustering, components, the beta-binomial classifier, rules, nested cross-validation, generative models."""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut
from .joins import bounded


def vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """df with an array column as a vector."""
    kind = df.schema[features].dataType.typeName()
    return df.withColumn(features, array_to_vector(F.col(features).cast("array<double>"))) if kind == "array" else df


def classifier(kind: str, label: str = "label", features: str = "features", **params):
    """LogisticRegression, LinearSVC, RandomForestClassifier or GBTClassifier."""
    from pyspark.ml import classification

    return getattr(classification, kind)(labelCol=label, featuresCol=features, **params)


def knn(train: DataFrame, test: DataFrame, k: int, key: str = "id", label: str = "label") -> DataFrame:
    """(key, label): the most frequent label among the k training rows (id, label, features) nearest to each test row. The training side
    is broadcast if small; each test row keeps k candidates per training partition before it meets them."""
    t = bounded(train.select(F.col(key).alias("t_id"), F.col(label).alias("t_label"), F.col("features").alias("t_x")))
    d = F.aggregate(F.zip_with("features", "t_x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = test.select(key, "features").join(t, F.lit(True)).select(key, "t_id", "t_label", d.alias("d"))
    near = near.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("d", "t_id"))).where(F.col("r") <= k)
    votes = near.groupBy(key, "t_label").agg(F.count("*").alias("n"), F.min("r").alias("first"))
    return votes.groupBy(key).agg(F.max_by("t_label", F.struct("n", -F.col("first"))).alias(label))


def cross_validated(df: DataFrame, settings: dict[str, object], fold: str = "fold", label: str = "label", metric: str = "balanced_accuracy") -> DataFrame:
    """(setting, fold, score): every estimator fitted on all folds but one and scored on that one."""
    from .stats import binary_metrics

    spark = df.sparkSession
    df = vectors(df).cache()
    rows = []
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):
        for name, estimator in settings.items():
            model = estimator.fit(df.where(F.col(fold) != f))
            out = model.transform(df.where(F.col(fold) == f)).select(F.col(label).alias("truth"), F.col("prediction").alias("guess"))
            rows.append((name, int(f), float(binary_metrics(out).first()[metric])))
    df.unpersist()
    return spark.createDataFrame(rows, "setting string, fold int, score double")


def best_setting(scores: DataFrame, largest: bool = True) -> str:
    """The setting with the best mean score over folds, the first by name at a tie."""
    means = scores.groupBy("setting").agg(F.avg("score").alias("s"))
    return means.orderBy(F.desc("s") if largest else F.asc("s"), "setting").first()["setting"]


def nested(df: DataFrame, settings: dict[str, object], outer: str, inner: str, label: str = "label", metric: str = "balanced_accuracy") -> DataFrame:
    """(fold, setting, score): for each outer fold the setting that is best over the inner folds of its training rows, and its score."""
    from .stats import binary_metrics

    df = vectors(df)
    rows = []
    for f in sorted(r[0] for r in df.select(outer).distinct().collect()):
        train, test = df.where(F.col(outer) != f), df.where(F.col(outer) == f)
        name = best_setting(cross_validated(train, settings, inner, label, metric))
        out = settings[name].fit(train).transform(test).select(F.col(label).alias("truth"), F.col("prediction").alias("guess"))
        rows.append((int(f), name, float(binary_metrics(out).first()[metric])))
    return df.sparkSession.createDataFrame(rows, "fold int, setting string, score double")


def pca(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    """df with `components`: centred features on the first k principal components."""
    from pyspark.ml.feature import PCA, StandardScaler

    df = vectors(df, features)
    centred = StandardScaler(inputCol=features, outputCol="__c", withMean=True, withStd=False).fit(df).transform(df)
    out = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    return out.withColumn("components", vector_to_array("__p")).drop("__c", "__p")


def kmeans(df: DataFrame, k: int, seed: int = 0, features: str = "features", bisecting: bool = False) -> DataFrame:
    """df with `cluster`."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans

    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol=features, predictionCol="cluster")
    df = vectors(df, features)
    return model.fit(df).transform(df)


def silhouette(df: DataFrame, features: str = "features") -> float:
    """Mean silhouette by squared Euclidean distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(df)


def linked_clusters(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cluster): single linkage, i.e. connected components over pairs (id_1, id_2); the cluster is its smallest id. Large and small stars
    in turn: larger, then smaller neighbours are linked to the smallest one, until nothing changes, which takes a number
    of rounds in the logarithm of the vertices; each round's lineage is cut."""
    links = cut(pairs.select(F.greatest("id_1", "id_2").alias("u"), F.least("id_1", "id_2").alias("v")).where("u <> v").distinct())
    state = None
    while (now := links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()) != state and now[0]:
        state = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(large.join(least, "u").where("v > m").select("v", "m").union(least).toDF("u", "v").distinct())
    return ids.select("id").join(links.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("cluster"))


def density_clusters(pairs: DataFrame, ids: DataFrame, least: int = 5) -> DataFrame:
    """(id, cluster): DBSCAN over pairs (id_1, id_2) of ids within the distance. Ids with at least `least` neighbours, themselves counted, are
    cores; linked cores are a cluster, named by its smallest core; other ids join the smallest cluster of a core next to
    them, or none (NULL)."""
    both = pairs.select("id_1", "id_2").union(pairs.select("id_2", "id_1")).where("id_1 <> id_2").distinct()
    cores = cut(both.groupBy(F.col("id_1").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select("id"))
    if least <= 1:
        cores = ids.select("id")
    side = lambda n: cores.select(F.col("id").alias(f"id_{n}"))
    inner = cut(linked_clusters(both.join(side(1), "id_1").join(side(2), "id_2"), cores))
    border = both.join(inner.select(F.col("id").alias("id_2"), "cluster"), "id_2").groupBy(F.col("id_1").alias("id")).agg(F.min("cluster").alias("near"))
    return ids.select("id").join(inner, "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "near").alias("cluster"))


def knn_precomputed(distances: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(id, label): the most frequent label (the nearest one's at a tie) of the k ids nearest to each id; distances (id, other, distance) of
    ids to those with a label (id, label)."""
    own = labels.select(F.col("id").alias("other"), "label")
    place = F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))
    near = distances.join(own, "other").withColumn("r", place).where(F.col("r") <= k)
    votes = near.groupBy("id", "label").agg(F.count("*").alias("n"), F.min("r").alias("first"))
    return votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))


def nearest_centroid(centroids: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """(key, cluster): clusters (cluster, features) carried over to other rows."""
    d = F.aggregate(F.zip_with("features", "c_x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = df.select(key, "features").join(bounded(centroids.select("cluster", F.col("features").alias("c_x"))), F.lit(True))
    return near.groupBy(key).agg(F.min_by("cluster", F.struct(d.alias("d"), "cluster")).alias("cluster"))


def centroids(df: DataFrame, size: int, cluster: str = "cluster") -> DataFrame:
    """(cluster, features): mean feature arrays."""
    return df.groupBy(cluster).agg(F.array(*[F.avg(F.get("features", i)) for i in range(size)]).alias("features"))


#: Rows at most that kernel components are fitted on.
LANDMARKS = 1000


def kernel_values(x: np.ndarray, y: np.ndarray, kind: str, gamma: float, degree: int, add: float) -> np.ndarray:
    dot = x @ y.T
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * dot, 0))
    return dot if kind == "linear" else (gamma * dot + add) ** degree


def kernel_pca(df: DataFrame, k: int, kind: str = "rbf", gamma: float | None = None, degree: int = 3, add: float = 1.0, key: str = "id", most: int = LANDMARKS, seed: int = 0) -> DataFrame:
    """df (key, features: arrays) with `components`: by a linear, rbf or poly kernel, centred. Fitted on all rows, or on the `most` that come first by
    the MD5 of the key, a sample that bounds what the driver holds; every row is projected, by one matrix product per batch. A component's
    largest coefficient is positive. gamma is 1 / features by default; components without variance are 0."""
    from .splits import shuffled

    df = df.withColumn("features", F.col("features").cast("array<double>"))
    marks = np.array([r[0] for r in df.where("features IS NOT NULL").orderBy(*shuffled(key, seed)).limit(most).select("features").collect()], dtype=np.float64)
    if not len(marks):
        return df.withColumn("components", F.lit(None).cast("array<double>"))
    scale = gamma if gamma is not None else 1 / marks.shape[1]
    own = kernel_values(marks, marks, kind, scale, degree, add)
    means, mean = own.mean(0), own.mean()
    values, axes = np.linalg.eigh(own - means[None, :] - means[:, None] + mean)
    order = np.argsort(-values)[:k]
    values, axes = values[order], axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(order))])
    axes = np.where(values > 1e-12 * max(values[0], 1e-300), axes / np.sqrt(np.maximum(values, 1e-300)), 0)
    shared = df.sparkSession.sparkContext.broadcast((marks, means, mean, axes))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        marks, means, mean, axes = shared.value
        out = pd.Series([None] * len(x), dtype=object)
        there = np.flatnonzero(x.notna())
        if len(there):
            v = kernel_values(np.stack(x.iloc[there].to_list()).astype(np.float64), marks, kind, scale, degree, add)
            v = (v - v.mean(1)[:, None] - means[None, :] + mean) @ axes
            out.iloc[there] = list(v)
        return out

    return df.withColumn("components", project("features"))


def stability(df: DataFrame, settings: dict[str, int], size: int, runs: int = 5, key: str = "id", seed: int = 0) -> DataFrame:
    """(setting, run, adjusted_rand): how far clusterings hold on other rows. In each run the rows (key, features) are halved at random; both halves are
    clustered, with settings (name: number of clusters), and the clusters that the first half gives the second by its
    nearest centroids are compared with the second's own."""
    from .splits import random_split
    from .stats import clustering_agreement

    rows = []
    for run in range(runs):
        halves = cut(random_split(df.select(key, "features"), key, 0.5, seed + run))
        first, second = (halves.where(F.col("part") == part).drop("part") for part in ("train", "test"))
        for name, k in settings.items():
            found = kmeans(first, k, seed + run).select("cluster", vector_to_array("features").alias("features"))
            given = nearest_centroid(centroids(found, size), second, key).withColumnRenamed("cluster", "given")
            both = kmeans(second, k, seed + run).select(key, "cluster").join(given, key)
            rows.append((name, run, float(clustering_agreement(both, "cluster", "given").first()["adjusted_rand"])))
    return df.sparkSession.createDataFrame(rows, "setting string, run int, adjusted_rand double")


class BetaBinomial:
    """Two beta-binomial models of (relevant, total) counts, for positive and negative examples; predicts by posterior odds.

    Fitted on the driver from one row per example by Newton-free coordinate search on the log-likelihood."""

    @staticmethod
    def _terms(a: float, b: float, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The log-likelihood of each pair of counts."""
        beta = lambda x, y: np.array([lgamma(p) + lgamma(q) - lgamma(p + q) for p, q in zip(x, y, strict=True)])
        return beta(k + a, n - k + b) - beta([a], [b])

    def fit(self, rows: DataFrame, label: str = "positive") -> BetaBinomial:
        """From the distinct pairs of counts and how often they are."""
        data = rows.groupBy(label, "relevant", "total").agg(F.count("*").alias("w")).collect()
        self.params, self.prior = {}, {}
        total = sum(r["w"] for r in data)
        for value in (True, False):
            own = [r for r in data if bool(r[label]) == value]
            k, n, w = (np.array([r[x] for r in own], float) for x in ("relevant", "total", "w"))
            self.prior[value] = w.sum() / total
            value_of = lambda p: float((w * self._terms(*np.exp(p), k, n)).sum())  # noqa: B023, E731
            best, step = np.array([0.0, 3.0]), 1.0
            score = value_of(best)
            while step > 1e-4:
                moves = [np.clip(best + step * np.array(m), -12, 12) for m in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1))]
                top = max((value_of(m), tuple(m)) for m in moves)
                if top[0] > score + 1e-9:
                    score, best = top[0], np.array(top[1])
                else:
                    step /= 2
            self.params[value] = tuple(np.exp(best))
        return self

    def log_odds(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        one = lambda v: log(self.prior[v]) + self._terms(*self.params[v], np.asarray(k, float), np.asarray(n, float))
        return one(True) - one(False)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with log_odds and guess; each distinct pair of counts is scored once, in batches."""
        model = self

        @F.pandas_udf("double")
        def score(k: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series(model.log_odds(k.to_numpy(), n.to_numpy()))

        kinds = rows.select("relevant", "total").distinct().withColumn("log_odds", score("relevant", "total"))
        return rows.join(kinds, ["relevant", "total"]).withColumn("guess", (F.col("log_odds") > 0).cast("int"))


def greedy_rules(df: DataFrame, truth: str, features: list[str], most: int = 5, metric: str = "f1", gain: float = 0.0) -> list[str]:
    """Binary feature columns whose OR predicts truth, added one by one while the metric gains; each step is one aggregation over all
    candidates."""
    t = F.col(truth) == 1
    chosen: list[str] = []
    best = -1.0
    while len(chosen) < most:
        rest = [f for f in features if f not in chosen]
        if not rest:
            break
        base = F.lit(False)
        for f in chosen:
            base = base | (F.col(f) == 1)
        aggs = []
        for i, f in enumerate(rest):
            g = base | (F.col(f) == 1)
            aggs += [F.count_if(t & g).alias(f"tp{i}"), F.count_if(~t & g).alias(f"fp{i}"), F.count_if(t & ~g).alias(f"fn{i}"), F.count_if(~t & ~g).alias(f"tn{i}")]
        row = df.agg(*aggs).first()

        def score(i: int, row=row) -> float:
            tp, fp, fn, tn = (row[f"{x}{i}"] for x in ("tp", "fp", "fn", "tn"))
            if metric == "f1":
                return 2 * tp / max(1, 2 * tp + fp + fn)
            return (tp / max(1, tp + fn) + tn / max(1, tn + fp)) / 2

        i = max(range(len(rest)), key=lambda i: (score(i), -i))
        if score(i) <= best + gain:
            break
        best = score(i)
        chosen.append(rest[i])
    return chosen


# generative models


def pwm_fit(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(length, position, letter, p): letter probabilities per position, for each length."""
    from ..functions.text import kmers

    parts = df.select(F.length(seq).alias("length"), F.posexplode(kmers(seq, 1)).alias("position", "letter"))
    out = parts.groupBy("length", "position", "letter").agg(F.count("*").alias("n"))
    return out.select("length", "position", "letter", (F.col("n") / F.sum("n").over(W.partitionBy("length", "position"))).alias("p"))


def pwm_sample(pwm: DataFrame, lengths: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(id, seq): n sequences; lengths (length, p). Draws are hashes of id, place and seed against cumulative probabilities."""
    spark = pwm.sparkSession
    u = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    cumulative = lambda df, by, x: df.withColumn("hi", F.sum("p").over(W.partitionBy(*by).orderBy(x)))
    steps = cumulative(lengths, [], "length").agg(F.sort_array(F.collect_list(F.struct("hi", "length"))).alias("steps"))
    ids = spark.range(n).crossJoin(F.broadcast(steps))
    pick = lambda steps, v, name: F.coalesce(F.get(F.filter(steps, lambda s: s["hi"] > v), 0)[name], F.element_at(steps, -1)[name])
    ids = ids.select("id", pick(F.col("steps"), u("id"), "length").alias("length"))
    letters = cumulative(pwm, ["length", "position"], "letter").groupBy("length", "position").agg(F.sort_array(F.collect_list(F.struct("hi", "letter"))).alias("steps"))
    matrix = letters.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("position", "steps"))).alias("rows"))
    drawn = ids.join(bounded(matrix), "length")
    seq = F.array_join(F.transform("rows", lambda r: pick(r["steps"], u("id", r["position"]), "letter")), "")
    return drawn.select("id", seq.alias("seq"))


def save_pwm(pwm: DataFrame, lengths: DataFrame, path: str) -> None:
    """A fitted model as two tables."""
    pwm.write.mode("overwrite").parquet(f"{path}/pwm")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def apply_pwm(spark: SparkSession, path: str, n: int, seed: int = 0) -> DataFrame:
    """(id, seq): n sequences of a stored model."""
    return pwm_sample(spark.read.parquet(f"{path}/pwm"), spark.read.parquet(f"{path}/lengths"), n, seed)


def with_origin(original: DataFrame, generated: DataFrame, column: str = "generated") -> DataFrame:
    """Both tables as one, with where each row is from."""
    return original.withColumn(column, F.lit(False)).unionByName(generated.withColumn(column, F.lit(True)), allowMissingColumns=True)


def kmer_model(df: DataFrame, k: int, seq: str = "seq", pseudo: float = 1.0) -> DataFrame:
    """(kmer, log_p): smoothed log-probabilities of k-mers over the seen ones."""
    from ..functions.text import kmers

    counts = df.select(F.explode(kmers(seq, k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("v"))
    return counts.crossJoin(F.broadcast(total)).select("kmer", F.ln((F.col("n") + pseudo) / (F.col("t") + pseudo * F.col("v"))).alias("log_p"))


def kmer_divergence(df: DataFrame, p: DataFrame, q: DataFrame, k: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, divergence): the mean difference of the k-mers' log-probabilities under two models; unseen k-mers get the model's least one."""
    from ..functions.text import kmers

    parts = df.select(key, F.explode(kmers(seq, k)).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))
    side = lambda m, name: (m.withColumnRenamed("log_p", name), m.agg(F.min("log_p").alias(f"{name}0")))
    for m, name in ((p, "lp"), (q, "lq")):
        table, floor = side(m, name)
        parts = parts.join(table, "kmer", "left").crossJoin(F.broadcast(floor)).withColumn(name, F.coalesce(name, f"{name}0")).drop(f"{name}0")
    return parts.groupBy(key).agg((F.sum(F.col("n") * (F.col("lp") - F.col("lq"))) / F.sum("n")).alias("divergence"))


def worst(df: DataFrame, n: int, by: str = "divergence", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)


def hashed_uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash: the same for the same row."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
