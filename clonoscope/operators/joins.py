"""Joins of sequences: exact presence, edit distance, Hamming and one-indel overlap, patterns, motifs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import deletions, genes_match, hamming, masked
from ..functions.text import genes as some
from .products import block_count, item_id, numbered, overlaps

#: Rows up to which a reference list is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has few rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def presence(df: DataFrame, items: list[str], key: str = "repertoire_id") -> DataFrame:
    """The distinct items of each repertoire, but those without any value."""
    some = F.greatest(*[F.coalesce(F.col(c).cast("string") != "", F.lit(False)).cast("int") for c in [items[0], *items]])
    return df.where(some == 1).select(key, *items).distinct()


def reference_matches(df: DataFrame, reference: DataFrame, most: int = 0, genes: bool = True, seq: str = "sequence_aa") -> DataFrame:
    """Rows of df with the columns reference_id and of the reference with the prefix ref_, for sequences within `most` edits, of the same
    locus and, if asked, with a common V and J gene. Distance 0 is a hash join on the sequence; else the locus is the
    hash key, lengths filter before the distance is computed, and the distance is cut off at `most`."""
    ref = reference.select("reference_id", *[F.col(c).alias(f"ref_{c}") for c in reference.columns if c != "reference_id"])
    on = F.col("locus") == F.col("ref_locus")
    if most == 0:
        on = on & (F.col(seq) == F.col(f"ref_{seq}"))
    else:
        on = on & (F.abs(F.length(seq) - F.length(f"ref_{seq}")) <= most) & (F.levenshtein(F.col(seq), F.col(f"ref_{seq}"), most) >= 0)
    if genes:
        on = on & genes_match("v_call", "ref_v_call") & genes_match("j_call", "ref_j_call")
    return df.join(bounded(ref), on)


def match_counts(df: DataFrame, reference: DataFrame, most: int = 0, reads: str = "unique", genes: bool = True, normalised: bool = False, seq: str = "sequence_aa", key: str = "repertoire_id") -> DataFrame:
    """(key, reference_id, matches): matching sequences, or their summed counts; relative to the repertoire's total if asked."""
    one = F.lit(1) if reads == "unique" else F.col("duplicate_count")
    found = reference_matches(df, reference, most, genes, seq).groupBy(key, "reference_id").agg(F.sum(one).alias("matches"))
    if not normalised:
        return found
    total = df.groupBy(key).agg(F.sum(one).alias("__total"))
    return found.join(total, key).withColumn("matches", F.col("matches") / F.col("__total")).drop("__total")


def receptor_match_counts(df: DataFrame, receptors: DataFrame, most: dict[str, int], reads: str = "unique", genes: bool = True, summed: bool = False, normalised: bool = False, seq: str = "sequence_aa", key: str = "repertoire_id") -> DataFrame:
    """(key, feature, matches): matches of the chains of reference receptors (cell_id, locus, sequence, v_call, j_call), each locus within
    its own number of edits. The feature is the cell and the locus, or the locus if summed; normalised, an example's matches
    are relative to all matches of it."""
    name = F.col("locus") if summed else F.concat_ws(".", "cell_id", "locus")
    parts = [match_counts(df, receptors.where(F.col("locus") == locus).withColumn("reference_id", name).drop("cell_id"), n, reads, genes, seq=seq, key=key) for locus, n in most.items()]
    found = reduce(DataFrame.unionByName, parts).withColumnRenamed("reference_id", "feature").groupBy(key, "feature").agg(F.sum("matches").alias("matches"))
    if not normalised:
        return found
    return found.join(found.groupBy(key).agg(F.sum("matches").alias("all_matches")), key).select(key, "feature", (F.col("matches") / F.col("all_matches")).alias("matches"))


def with_zeros(found: DataFrame, examples: DataFrame, features: DataFrame, key: str, value: str) -> DataFrame:
    """found (key, feature, value) with a row of 0 for each example and feature that it lacks; the list of features is broadcast if small."""
    grid = examples.select(key).distinct().join(bounded(features.select("feature").distinct()))
    return grid.join(found, [key, "feature"], "left").na.fill(0, [value])


def fuzzy_presence(df: DataFrame, most: int = 1, genes: bool = True, indels: bool = False, key: str = "repertoire_id") -> DataFrame:
    """(seq, v_call, j_call, key): in which repertoires each distinct sequence of df (key, seq, v_call, j_call) is, or one within the distance."""
    own = df.select(key, "seq", "v_call", "j_call").distinct().withColumn("id", kind_id(genes))
    kinds = own.dropDuplicates(["id"]).select("id", "seq", *(["v_call", "j_call"] if genes else [F.lit(None).cast("string").alias("v_call"), F.lit(None).cast("string").alias("j_call")]))
    near = hamming_pairs(kinds, kinds, most, genes, indels).join(own.select(F.col("id").alias("id_2"), key).distinct(), "id_2")
    near = near.select(F.col("id_1").alias("id"), key).distinct()
    return near.join(kinds, "id").select("seq", "v_call", "j_call", key)


def kind_id(genes: bool = True) -> Column:
    """One value for a sequence, with its genes if asked."""
    return F.sha2(F.to_json(F.struct("seq", "v_call", "j_call") if genes else F.struct("seq")), 256)


def fuzzy_jaccard(df: DataFrame, most: int = 1, genes: bool = True, key: str = "repertoire_id") -> DataFrame:
    """(r1, r2, distance): 1 - i / (n1 + n2 - i), at least 0, i being the pairs of like distinct sequences, for pairs that have some."""
    found = pair_sums(df, most, genes, counts=False, key=key, by=genes)
    return found.where("r1 IS NOT NULL AND r2 IS NOT NULL").select("r1", "r2", F.greatest(1 - F.try_divide("overlap", F.col("t1") + F.col("t2") - F.col("overlap")), F.lit(0.0)).alias("distance"))


def annotated(df: DataFrame, reference: DataFrame, most: int, column: str, genes: bool = False, seq: str = "sequence_aa", row: str = "sequence_id") -> DataFrame:
    """df with the number of reference sequences of equal length within `most` substitutions."""
    pairs = hamming_pairs(df.select(F.col(row).alias("id"), F.col(seq).alias("seq"), "v_call", "j_call"), reference.select(F.col("reference_id").alias("id"), F.col(seq).alias("seq"), "v_call", "j_call"), most, genes)
    counts = pairs.groupBy(F.col("id_1").alias(row)).agg(F.count("*").alias(column))
    return df.join(counts, row, "left").withColumn(column, F.coalesce(column, F.lit(0)))


def pattern_matches(df: DataFrame, patterns: DataFrame, v_genes: bool = False, seq: str = "sequence_aa") -> DataFrame:
    """Rows of df with pattern_id, for patterns (pattern_id, locus, regex, v_call) that the sequence of their locus contains."""
    p = patterns.select("pattern_id", F.col("locus").alias("p_locus"), "regex", F.col("v_call").alias("p_v"))
    on = (F.col("locus") == F.col("p_locus")) & F.regexp_like(F.col(seq), F.col("regex"))
    if v_genes:
        on = on & (F.col("p_v").isNull() | (F.col("v_call") == F.col("p_v")))
    return df.join(bounded(p), on).drop("p_locus", "regex", "p_v")


def hamming_pairs(a: DataFrame, b: DataFrame, most: int = 1, genes: bool = True, indels: bool = False) -> DataFrame:
    """(id_1, id_2) of sequences (id, seq, v_call, j_call) within `most` substitutions (or one indel), with equal genes if asked.

    All distances are equi-joins: 0 on the sequence; 1 on the sequence with one letter masked (an indel: with one letter left out of the
    longer one); larger ones on the length, the place and the letters of one of most + 1 pieces, of which at least one is equal."""
    def side(df: DataFrame, n: int, keys: Column) -> DataFrame:
        return df.select(F.col("id").alias(f"id_{n}"), F.col("seq").alias(f"seq_{n}"), F.col("v_call").alias(f"v_{n}"), F.col("j_call").alias(f"j_{n}"), F.explode(keys).alias(f"key_{n}"))

    def met(x: Column, y: Column) -> DataFrame:
        on = F.col("key_1") == F.col("key_2")
        if genes:
            on = on & F.col("v_1").eqNullSafe(F.col("v_2")) & F.col("j_1").eqNullSafe(F.col("j_2"))
        return side(a, 1, x).join(side(b, 2, y), on)

    same = F.array("seq")
    if most == 0:
        return met(same, same).select("id_1", "id_2")
    if most == 1:
        # A mask per place; equal strings share all of them.
        out = met(masked("seq"), masked("seq")).select("id_1", "id_2")
        if indels:
            out = out.union(met(deletions("seq"), same).select("id_1", "id_2")).union(met(same, deletions("seq")).select("id_1", "id_2"))
        return out.distinct()
    n, parts = F.length("seq"), most + 1
    start = lambda i: F.floor(n * F.lit(i) / parts).cast("int")
    pieces = F.array(*[F.concat_ws(":", n.cast("string"), F.lit(str(i)), F.substring(F.col("seq"), start(i) + 1, start(i + 1) - start(i))) for i in range(parts)])
    return met(pieces, pieces).where(hamming("seq_1", "seq_2") <= most).select("id_1", "id_2").distinct()


def overlap(df: DataFrame, most: int = 1, genes: bool = True, counts: bool = True, indels: bool = False, key: str = "repertoire_id") -> DataFrame:
    """(r1, r2, overlap): over pairs of like sequences of two repertoires, the sum of the products of their counts (of ones, if
    not counts). df: key, seq, v_call, j_call, duplicate_count. Equal sequences of a repertoire are summed up first, the pairs of
    distinct sequences are found once, and the sums are products of blocks of repertoires (`products.overlaps`)."""
    return pair_sums(df, most, genes, counts, indels, key).select("r1", "r2", "overlap")


def pair_sums(df: DataFrame, most: int = 1, genes: bool = True, counts: bool = True, indels: bool = False, key: str = "repertoire_id", by: bool = True, every: bool = False) -> DataFrame:
    """(r1, r2, overlap, t1, t2) of `overlap`, with each repertoire's summed counts (or number of distinct sequences; with their genes, if by);
    every: of all pairs r1 <= r2, with o1, o2 (see `products.overlaps`)."""
    from ..lineage import cut

    columns = ["seq", "v_call", "j_call"] if genes else ["seq"]
    kinds = df.select("seq", *(["v_call", "j_call"] if genes else [F.lit(None).cast("string").alias(c) for c in ("v_call", "j_call")])).distinct().withColumn("id", item_id(*columns))
    kinds = cut(kinds)
    pairs = cut(hamming_pairs(kinds, kinds, most, genes, indels))
    numbers = numbered(kinds)
    rows = df.select(key, item_id(*columns).alias("kind"), F.col("duplicate_count").alias("n")) if counts else df.select(key, item_id(*columns).alias("kind"), item_id("seq", "v_call", "j_call" if by else "seq").alias("id"))
    blocks = block_count(rows, key, "kind")
    if counts:
        rows = rows.groupBy(key, "kind").agg(F.sum("n").alias("n")).repartition(key)
    else:
        rows = rows.repartition(key).distinct().groupBy(key, "kind").agg(F.count("*").alias("n"))
    if numbers is not None:  # small numbers make small arrays
        no = lambda c: numbers.select(F.col("id").alias(c), F.col("no").alias(f"__{c}"))
        rows = rows.join(no("kind"), "kind", "left").select(key, F.col("__kind").alias("kind"), "n")
        pairs = pairs.join(no("id_1"), "id_1").join(no("id_2"), "id_2").select(F.col("__id_1").alias("id_1"), F.col("__id_2").alias("id_2"))
    return overlaps(rows, pairs, key, blocks, every)


def edit_matches(df: DataFrame, reference: DataFrame, most: int, genes: bool = True) -> DataFrame:
    """Distinct rows of df (seq, v_call, j_call, locus) with a sequence of the reference within `most` edits, of the same locus and, if asked,
    with a common V and J gene. An equi-join: of most + 1 pieces of a reference sequence one is unchanged, and moved by `most` places at most;
    a locus, a V and J gene in common and that piece are the key. The distance is computed only for what meets there."""
    def side(rows: DataFrame, n: int, keys: list[Column]) -> DataFrame:
        named = lambda c: F.when(F.size(some(c)) > 0, some(c)).otherwise(F.array(F.lit("")))
        rows = rows.where("seq IS NOT NULL AND locus IS NOT NULL").withColumn("piece", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))
        for c in ("v_call", "j_call"):
            rows = rows.withColumn(f"one_{c}", F.explode(named(c)) if genes else F.lit(""))
        key = F.struct("locus", F.col("one_v_call").alias("v"), F.col("one_j_call").alias("j"), "piece")
        return rows.select(*[F.col(c).alias(f"{c}_{n}") for c in ("seq", "v_call", "j_call", "locus")], key.alias(f"key_{n}"))

    size, parts = F.length("seq"), most + 1
    at = lambda length, i: F.floor(length * F.lit(i) / parts).cast("int")

    def piece(length: Column, i: int, moved: int) -> Column:
        start, end = at(length, i) + moved, at(length, i + 1) + moved
        return F.when((length >= 0) & (start >= 0) & (end <= size), F.struct(length.alias("length"), F.lit(i).alias("no"), F.substring("seq", start + 1, end - start).alias("letters")))

    every = [piece(size + more, i, moved) for more in range(-most, most + 1) for i in range(parts) for moved in range(-most, most + 1)]
    met = side(df, 1, every).join(side(reference, 2, [piece(size, i, 0) for i in range(parts)]), F.col("key_1") == F.col("key_2"))
    near = met.where(F.levenshtein(F.col("seq_1"), F.col("seq_2"), most) >= 0)
    return near.select(*[F.col(f"{c}_1").alias(c) for c in ("seq", "v_call", "j_call", "locus")]).distinct()


def similar_to_positive(df: DataFrame, positives: DataFrame, most: int = 1, metric: str = "hamming", genes: bool = True) -> DataFrame:
    """df (id, seq, v_call, j_call, locus) with `similar`: whether a positive sequence is within the distance."""
    if metric == "hamming":
        near = hamming_pairs(df, positives, most, genes).select(F.col("id_1").alias("id")).distinct()
    else:
        names = ["seq", "v_call", "j_call", "locus"]
        near = edit_matches(df.select(*names).distinct(), positives.select(*names).distinct(), most, genes).select(*[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("similar"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
        return df.join(near, same, "left").select(*[F.col(c) for c in df.columns], F.coalesce("similar", F.lit(False)).alias("similar"))
    return df.join(near.withColumn("similar", F.lit(True)), "id", "left").withColumn("similar", F.coalesce("similar", F.lit(False)))


def node_degrees(df: DataFrame, most: int = 1, genes: bool = True) -> DataFrame:
    """(degree, sequences): how many distinct sequences have so many others within the distance."""
    kinds = df.select("seq", "v_call", "j_call").distinct().withColumn("id", F.sha2(F.to_json(F.struct("seq", "v_call", "j_call")), 256))
    near = hamming_pairs(kinds, kinds, most, genes).where("id_1 <> id_2").groupBy(F.col("id_1").alias("id")).agg(F.count("*").alias("degree"))
    return kinds.join(near, "id", "left").groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count("*").alias("sequences"))


def containing(df: DataFrame, words: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Rows of df that contain one of words (kmer), by an equi-join on their k-mers, with the positions (from 0)."""
    from ..functions.text import kmers

    parts = df.select("*", F.posexplode(kmers(seq, k)).alias("position", "kmer"))
    return parts.join(words.select("kmer").distinct(), "kmer")
