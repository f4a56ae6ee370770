"""Feature tables in long form: (example, feature, value). Zeros have no row; N examples are passed where they count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .joins import bounded


def counted(df: DataFrame, words: Column, key: str, reads: str = "unique") -> DataFrame:
    """(key, feature, value): how often each word occurs in an example's rows; with reads="all" weighted by duplicate_count."""
    one = F.lit(1) if reads == "unique" else F.col("duplicate_count")
    return df.select(key, one.alias("n"), F.explode(words).alias("feature")).groupBy(key, "feature").agg(F.sum("n").cast("double").alias("value"))


STRATEGIES = {
    "CONTINUOUS_KMER": lambda seq, p: X.kmers(seq, p["k"]),
    "GAPPED_KMER": lambda seq, p: X.gapped_kmers(seq, p["k_left"], p["k_right"], p["min_gap"], p["max_gap"]),
    "IMGT_CONTINUOUS_KMER": lambda seq, p: X.imgt_kmers(seq, p["k"], p.get("junction", False)),
    "IMGT_GAPPED_KMER": lambda seq, p: X.imgt_gapped_kmers(seq, p["k_left"], p["k_right"], p["min_gap"], p["max_gap"], p.get("junction", False)),
    "V_GENE_CONT_KMER": lambda seq, p: X.with_gene(X.kmers(seq, p["k"]), "v_call"),
    "V_GENE_IMGT_KMER": lambda seq, p: X.with_gene(X.imgt_kmers(seq, p["k"], p.get("junction", False)), "v_call"),
}


def kmer_frequencies(df: DataFrame, key: str = "repertoire_id", seq: str = "seq", strategy: str = "CONTINUOUS_KMER", reads: str = "unique", normalisation: str = "RELATIVE_FREQUENCY", by_locus: bool | None = None, **params) -> DataFrame:
    """K-mer frequencies of examples. by_locus puts the locus before each k-mer; by default it does if there are several
    (receptors, keyed by cell, sum up over both chains and always have it)."""
    words = STRATEGIES[strategy](seq, params)
    if by_locus is None:
        by_locus = "locus" in df.columns and (key == "cell_id" or df.select("locus").distinct().limit(2).count() > 1)
    if by_locus:
        words = X.with_locus(words, "locus")
    return normalised(counted(df, words, key, reads), key, normalisation)


def normalised(df: DataFrame, key: str, how: str) -> DataFrame:
    """RELATIVE_FREQUENCY (L1), L2, MAX, BINARY or NONE over each example's features; all-zero examples stay zero."""
    v, over = F.col("value"), W.partitionBy(key)
    if how in ("RELATIVE_FREQUENCY", "L1"):
        return df.withColumn("value", v / F.nullif(F.sum(F.abs(v)).over(over), F.lit(0.0)))
    if how == "L2":
        return df.withColumn("value", v / F.nullif(F.sqrt(F.sum(v * v).over(over)), F.lit(0.0)))
    if how == "MAX":
        return df.withColumn("value", v / F.nullif(F.max(F.abs(v)).over(over), F.lit(0.0)))
    if how == "BINARY":
        return df.withColumn("value", (v > 0).cast("double"))
    return df


def scale_fit(df: DataFrame, n: int) -> DataFrame:
    """(feature, mean, sd): over n examples, those without a row being zero; the population deviation."""
    mean = F.sum("value") / n
    square = F.sum(F.col("value") * F.col("value")) / n
    return df.groupBy("feature").agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd"))


def scaled(df: DataFrame, fit: DataFrame, examples: DataFrame, key: str, centre: bool = True) -> DataFrame:
    """Values over the deviation, after taking off the mean if centre (then zeros get rows, too); a constant feature is divided by 1.
    Features that the fit doesn't know are dropped."""
    rows = df.join(fit, "feature")
    if centre:
        rows = examples.select(key).distinct().crossJoin(fit).join(df, [key, "feature"], "left")
    sd = F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(F.lit(1.0))
    value = F.coalesce("value", F.lit(0.0)) - (F.col("mean") if centre else F.lit(0.0))
    return rows.select(key, "feature", (value / sd).alias("value"))


def with_vocabulary(df: DataFrame, vocabulary: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """Dense over examples and a fitted vocabulary (feature): unknown features dropped, missing ones zero."""
    grid = examples.select(key).distinct().crossJoin(vocabulary.select("feature").distinct())
    return grid.join(df, [key, "feature"], "left").select(key, "feature", F.coalesce("value", F.lit(0.0)).alias("value"))


def wide(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """One column per feature."""
    return df.groupBy(key).pivot("feature", features).agg(F.first("value")).na.fill(0.0)


def gene_frequencies(df: DataFrame, genes: list[str], key: str = "repertoire_id", normalisation: str = "RELATIVE_FREQUENCY") -> DataFrame:
    """V or J genes of an example's rows; each kind is normalised by itself."""
    return reduce(DataFrame.unionByName, [normalised(counted(df, F.array(X.gene(g)), key), key, normalisation) for g in genes])


def gene_presence(df: DataFrame, genes: list[str], key: str = "sequence_id") -> DataFrame:
    """One-hot genes of sequences; for receptors (key cell_id) those of either chain."""
    return reduce(DataFrame.unionByName, [df.select(key, X.gene(g).alias("feature")).distinct().withColumn("value", F.lit(1.0)) for g in genes])


def multi_hot(metadata: DataFrame, fields: list[str], key: str = "repertoire_id") -> DataFrame:
    """field_class = 1 for each class in a field's comma-separated list."""
    one = lambda f: metadata.select(key, F.explode(F.split(F.col(f).cast("string"), ",")).alias("c")).select(key, F.concat(F.lit(f"{f}_"), F.trim("c")).alias("feature")).distinct()
    return reduce(DataFrame.unionByName, map(one, fields)).withColumn("value", F.lit(1.0))


def lengths(df: DataFrame, key: str, seq: str = "seq", by_locus: bool = False) -> DataFrame:
    """The length of sequences; of receptors one feature per locus."""
    name = F.concat("locus", F.lit("_length")) if by_locus else F.lit("length")
    return df.select(key, name.alias("feature"), F.length(seq).cast("double").alias("value"))


def property_means(df: DataFrame, table: DataFrame, key: str, row: str = "sequence_id", seq: str = "seq") -> DataFrame:
    """table (letter, feature, factor): the mean factors of each sequence over its known letters, then the mean over an example's sequences."""
    letters = df.select(key, row, F.explode(X.kmers(seq, 1)).alias("letter"))
    # The factors of a letter as one map: a row per letter, not per letter and factor.
    factors = table.groupBy("letter").agg(F.map_from_entries(F.collect_list(F.struct("feature", "factor"))).alias("factors"))
    known = letters.join(bounded(factors), "letter").select(key, row, F.explode("factors").alias("feature", "factor"))
    return known.groupBy(key, row, "feature").agg(F.avg("factor").alias("v")).groupBy(key, "feature").agg(F.avg("v").alias("value"))


def one_hot(seq: Column | str, size: int, alphabet: str, flatten: bool = False) -> Column:
    """size rows of zeros and ones over the alphabet, places after the sequence's end being all zero."""
    letters = X.kmers(seq, 1)
    table = F.transform(F.slice(letters, 1, size), lambda c: F.array(*[(c == a).cast("int") for a in alphabet]))
    blank = F.array(*[F.lit(0)] * len(alphabet))
    table = F.concat(table, F.array_repeat(blank, F.greatest(F.lit(size) - F.size(letters), F.lit(0))))
    return F.flatten(table) if flatten else table


def position_info(seq: Column | str, size: int, middle: int) -> Column:
    """For each place weights (start, middle, end): start and end fall off from 1 at their own end in steps of 1 / middle, down to 0; the
    middle is full where both ends are at least `middle` away, and falls off to the nearer one in the same steps. In short sequences start
    and end overlap. Places after the sequence's end have no weight."""
    n = F.length(X.col(seq))

    def weights(i: Column) -> Column:
        left, right = i.cast("double") / middle, (n - 1 - i).cast("double") / middle
        parts = (F.greatest(1 - left, F.lit(0.0)), F.least(left, right, F.lit(1.0)), F.greatest(1 - right, F.lit(0.0)))
        return F.array(*[F.when(i < n, x).otherwise(0.0) for x in parts])

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), weights)


def composite(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Encodings of the same examples side by side; each feature with its encoding's name."""
    return reduce(DataFrame.unionByName, [df.select(key, F.concat(F.lit(f"{name}:"), "feature").alias("feature"), "value") for name, df in parts.items()])


def word2vec(df: DataFrame, key: str, seq: str = "seq", k: int = 3, size: int = 16, window: int = 5, seed: int = 0) -> DataFrame:
    """(key, vector): the sum of the vectors of an example's k-mers; the model's corpus is the sequences' k-mers."""
    from pyspark.ml.feature import Word2Vec

    words = df.select(key, X.kmers(seq, k).alias("words")).where(F.size("words") > 0)
    model = Word2Vec(vectorSize=size, minCount=1, windowSize=window, seed=seed, inputCol="words", outputCol="v").fit(words)
    from pyspark.ml.functions import vector_to_array

    vectors = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
    parts = words.select(key, F.explode("words").alias("word")).groupBy(key, "word").agg(F.count("*").alias("n")).join(vectors, "word")
    return parts.groupBy(key).agg(*[F.sum(F.col("n") * F.get("vector", i)).alias(f"v{i}") for i in range(size)])


def example_weights(examples: DataFrame, weights: DataFrame, key: str, default: float | None = None) -> DataFrame:
    """examples with `weight` from a table (key, weight); without a default, examples that the table lacks are an error."""
    out = examples.join(weights.select(key, F.col("weight").cast("double").alias("weight")), key, "left")
    if default is not None:
        return out.na.fill(default, ["weight"])
    if out.where("weight IS NULL").limit(1).count():
        raise ValueError("examples without a weight")
    return out


def precomputed(df: DataFrame, embeddings: DataFrame, key: str, row: str = "sequence_id") -> DataFrame:
    """Mean-pooled embeddings from a table (row id, embedding) that a language model has filled: (key, feature, value)."""
    joined = df.select(key, row).join(embeddings, row).select(key, F.posexplode("embedding").alias("feature", "v"))
    return joined.groupBy(key, F.col("feature").cast("string").alias("feature")).agg(F.avg("v").alias("value"))
