"""Random repertoires and signals: generate, annotate, implant, fill quotas."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import rolling_match
from ..lineage import cut
from ..schema import AMINO_ACIDS
from .models import hashed_uniform


def drawn(weights: dict, u: Column) -> Column:
    """A value by its weight."""
    total, at, out = sum(weights.values()), 0.0, None
    for value, w in weights.items():
        at += w / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return out.otherwise(F.lit(value))


def random_sequence(length: Column, alphabet: str, *key: Column | str, seed: int = 0) -> Column:
    letters = F.array(*map(F.lit, alphabet))
    one = lambda i: F.get(letters, F.floor(hashed_uniform(*key, i, seed=seed) * len(alphabet)).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), length), one), "")


def random_sequences(spark: SparkSession, n: int, lengths: dict[int, float], labels: dict[str, dict] | None = None, alphabet: str = AMINO_ACIDS, seed: int = 0) -> DataFrame:
    """sequence_id, sequence_aa and labels of n independent sequences."""
    df = spark.range(n).withColumn("l", drawn(lengths, hashed_uniform("id", seed=seed)))
    df = df.select("id", random_sequence(F.col("l"), alphabet, "id", seed=seed + 1).alias("sequence_aa"))
    for i, (name, weights) in enumerate((labels or {}).items()):
        df = df.withColumn(name, drawn(weights, hashed_uniform("id", seed=seed + 2 + i)))
    return df.withColumn("sequence_id", F.col("id").cast("string")).drop("id")


def random_repertoires(spark: SparkSession, n: int, sizes: dict[int, float], lengths: dict[int, float], labels: dict[str, dict], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sequences, metadata) of n repertoires."""
    meta = spark.range(n).withColumn("size", drawn(sizes, hashed_uniform("id", seed=seed)))
    for i, (name, weights) in enumerate(labels.items()):
        meta = meta.withColumn(name, drawn(weights, hashed_uniform("id", seed=seed + 2 + i)))
    rows = meta.select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(1), "size")).alias("i"))
    rows = rows.withColumn("l", drawn(lengths, hashed_uniform("r", "i", seed=seed + 1)))
    seqs = rows.select(F.col("r").cast("string").alias("repertoire_id"), F.concat_ws("_", "r", "i").alias("sequence_id"), random_sequence(F.col("l"), AMINO_ACIDS, "r", "i", seed=seed + 9).alias("sequence_aa"), F.lit(1).cast("long").alias("duplicate_count"))
    return seqs, meta.select(F.col("id").cast("string").alias("repertoire_id"), *labels)


def random_receptors(spark: SparkSession, n: int, lengths: dict[str, dict[int, float]], labels: dict[str, dict] | None = None, seed: int = 0) -> DataFrame:
    """Two rows (cell_id, locus, sequence_aa) per receptor; lengths: per locus."""
    parts = []
    for k, (locus, own) in enumerate(sorted(lengths.items())):
        df = random_sequences(spark, n, own, labels if k == 0 else None, seed=seed + 100 * k)
        parts.append(df.withColumnRenamed("sequence_id", "cell_id").withColumn("locus", F.lit(locus)))
    first, second = parts
    names = list(labels or {})
    second = second.join(first.select("cell_id", *names), "cell_id") if names else second
    return first.unionByName(second)


@dataclass(frozen=True)
class Seed:
    """A motif: letters with / where a gap may be; up to `substitutions` letters may be others of the alphabet."""

    letters: str
    least_gap: int = 0
    most_gap: int = 0
    substitutions: int = 0
    alphabet: str = AMINO_ACIDS

    def patterns(self) -> list[tuple[str, int]]:
        """Regular expressions of all instances, with their widths."""
        gaps = range(self.least_gap, self.most_gap + 1) if "/" in self.letters else [0]
        plain = self.letters.replace("/", "")
        out = []
        for g in gaps:
            for n in range(self.substitutions + 1):
                for places in combinations(range(len(plain)), n):
                    body = [f"[{self.alphabet}]" if i in places else c for i, c in enumerate(plain)]
                    if "/" in self.letters:
                        body.insert(self.letters.index("/"), "." * g)
                    out.append(("".join(body), len(plain) + g))
        return out

    def instances(self) -> list[tuple[str, str, int]]:
        """What is before and after the gap, and its width, of each width."""
        left, _, right = self.letters.partition("/")
        return [(left, right, g) for g in (range(self.least_gap, self.most_gap + 1) if "/" in self.letters else [0])]


@dataclass(frozen=True)
class Signal:
    """Motifs, and genes that a sequence must have (a part of the call)."""

    name: str
    motifs: tuple[Seed, ...]
    v_call: str | None = None
    j_call: str | None = None
    pairs: tuple = field(default=())

    def present(self, seq: str = "sequence_aa") -> Column:
        found = F.lit(False)
        for motif in self.motifs:
            for pattern, width in motif.patterns():
                found = found | (F.size(rolling_match(seq, pattern, width)) > 0)
        for call, want in (("v_call", self.v_call), ("j_call", self.j_call)):
            if want:
                found = found & F.col(call).contains(want)
        return found


def annotate(df: DataFrame, signals: list[Signal], seq: str = "sequence_aa", custom: dict[str, Column] | None = None) -> DataFrame:
    """df with a boolean column per signal; custom: conditions given as columns (also of pandas UDFs)."""
    made = {s.name: s.present(seq) for s in signals} | (custom or {})
    return df.withColumns(made)


def implanted(df: DataFrame, signal: Signal, key: str = "sequence_id", seq: str = "sequence_aa", seed: int = 0) -> DataFrame:
    """Sequences with an instance of the signal laid over a place that a hash picks; shorter ones are left as they are. Hashes also pick the
    motif and the width of its gap, in which the sequence keeps its letters, how many letters are substituted (0 to the motif's most,
    alike), which, and by which others of the alphabet."""
    names = ("left", "right", "gap", "most", "alphabet")
    options = [F.struct(*[F.lit(v).alias(k) for k, v in zip(names, (*x, m.substitutions, m.alphabet), strict=True)]) for m in signal.motifs for x in m.instances()]
    drawn = lambda n, *by: hashed_uniform(key, *by, seed=seed + n)
    m = F.col("__m")
    letters = F.split(F.concat(m["left"], m["right"]), "")
    count = F.floor(drawn(2) * (m["most"] + 1))
    places = F.sequence(F.lit(0), F.size(letters) - 1)

    def letter(x: Column, i: Column) -> Column:
        place = F.size(F.filter(places, lambda j: drawn(3, j) < drawn(3, i)))
        size = F.length(m["alphabet"])
        other = F.pmod(F.position(x, m["alphabet"]) + F.floor(drawn(4, i) * (size - 1)).cast("int"), size) + 1
        return F.when(place < count, F.substring(m["alphabet"], other, F.lit(1))).otherwise(x)

    out = df.withColumn("__m", F.get(F.array(*options), F.floor(drawn(0) * len(options)).cast("int")))
    out = out.withColumn("__x", F.array_join(F.transform(letters, letter), ""))
    n = F.length(m["left"])
    room = F.length(seq) - F.length("__x") - m["gap"] + 1
    at = F.floor(drawn(1) * room).cast("int") + 1
    laid = F.overlay(F.col(seq), F.substring(F.col("__x"), F.lit(1), n), at)
    laid = F.overlay(laid, F.substring(F.col("__x"), n + 1, F.length("__x")), at + n + m["gap"])
    return out.withColumn(seq, F.when(room > 0, laid).otherwise(F.col(seq))).drop("__m", "__x")


def quota(df: DataFrame, signal: str, n: int, skip: int = 0, key: str = "sequence_id") -> DataFrame:
    """n sequences that have a signal, after the first `skip`, in key order."""
    first = df.where(F.col(signal)).orderBy(key).limit(skip + n)  # skip + n rows at most go on
    return first.withColumn("__p", F.row_number().over(W.orderBy(key))).where(F.col("__p") > skip).drop("__p")


def until_quota(make, signal: str, n: int, batch: int = 10_000, most: int = 100, key: str = "sequence_id", keep=None) -> DataFrame:
    """n sequences that have a signal, from as many batches as it takes, `most` at the utmost: make(i, batch) gives the annotated
    sequences of batch i; keep, if given, is a condition (of a generation probability, say) that they must meet, too."""
    got = None
    for i in range(most):
        rows = make(i, batch).where(F.col(signal))
        rows = cut(rows.where(keep) if keep is not None else rows)
        got = rows if got is None else got.unionByName(rows)
        if got.count() >= n:
            return got.orderBy(key).limit(n)
    raise ValueError(f"{most} batches of {batch} have fewer than {n} sequences with {signal}")


def zipf_counts(key: str, most: int = 1000, exponent: float = 2.0, seed: int = 0) -> Column:
    """Clone sizes with P(n) about n ** -exponent."""
    u = hashed_uniform(key, seed=seed)
    return F.least(F.floor(F.pow(1 - u, -1.0 / (exponent - 1))), F.lit(most)).cast("long")


def signal_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n): sequences with both signals; with a = b, with the one."""
    present = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    both = df.select(present.alias("s")).select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a <= b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def cardinalities(df: DataFrame, names: list[str]) -> DataFrame:
    """(signals, n): how many sequences have so many signals."""
    total = sum((F.col(n).cast("int") for n in names), F.lit(0))
    return df.groupBy(total.alias("signals")).agg(F.count("*").alias("n"))


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): log10 of a positive value in bins of equal width; 0 and bins + 1 are beyond."""
    return df.where(F.col(value) > 0).groupBy(F.width_bucket(F.log10(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
