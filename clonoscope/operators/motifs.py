"""Positional motifs: growth by support, filters by confusion counts, generalisation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kmers


def items(df: DataFrame, seq: str = "seq", key: str = "sequence_id") -> DataFrame:
    """(key, position, letter) of sequences of one length."""
    return df.select(key, F.posexplode(kmers(seq, 1)).alias("position", "letter"))


def grown(df: DataFrame, size: int, support: int, no_gaps: bool = False, seq: str = "seq", key: str = "sequence_id") -> DataFrame:
    """(motif, positions, letters, support): motifs of up to `size` positions that at least `support` sequences have, level by level:
    a motif is only extended, to the right, by a letter at a position that is frequent itself, and only while it is frequent."""
    # Equal sequences are one row; those of one key go together. Estimates of sizes don't know how many rows an explode makes, so joins whose
    # sides may be large are told not to broadcast.
    letters = df.groupBy(seq).agg(F.count("*").alias("n")).select("n", F.posexplode(kmers(seq, 1)).alias("position", "letter"))
    frequent = letters.groupBy("position", "letter").agg(F.sum("n").alias("support")).where(F.col("support") >= support)
    out = frequent.select(F.array("position").alias("positions"), F.array("letter").alias("letters"), "support")
    kinds = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(seq)).alias("seqs")).groupBy("seqs").agg(F.count("*").alias("n"))
    each = kinds.select("seqs", "n", F.explode("seqs").alias("one")).select("seqs", "n", F.posexplode(kmers("one", 1)).alias("position", "letter"))
    own = each.join(F.broadcast(frequent.drop("support")), ["position", "letter"]).groupBy("seqs", "n").agg(F.sort_array(F.collect_list(F.struct("position", "letter"))).alias("own"))
    level = own.select("own", "n", F.explode("own").alias("x")).select("own", "n", F.array("x.position").alias("positions"), F.array("x.letter").alias("letters"))
    for i in range(size - 1):
        last = F.element_at("positions", -1)
        after = F.filter("own", lambda x: (x["position"] == last + 1) if no_gaps else (x["position"] > last))
        level = level.withColumn("x", F.explode(after)).select("own", "n", F.array_append("positions", F.col("x.position")).alias("positions"), F.array_append("letters", F.col("x.letter")).alias("letters"))
        counts = level.groupBy("positions", "letters").agg(F.sum("n").alias("support")).where(F.col("support") >= support)
        if i < size - 2:
            level = level.join(counts.drop("support").hint("merge"), ["positions", "letters"])
        out = out.unionByName(counts)
    return out.select(name().alias("motif"), "positions", "letters", "support")


def name(positions: str = "positions", letters: str = "letters") -> Column:
    return F.concat(F.array_join(positions, "&"), F.lit("-"), F.array_join(letters, "&"))


def occurrences(df: DataFrame, motifs: DataFrame, seq: str = "seq", key: str = "sequence_id") -> DataFrame:
    """(key, motif): which sequences have which of motifs (motif, positions, letters). A letter group is tested as a set, a lower-case letter as
    any other. Motifs meet the sequences by their first position and letter, then the other ones are tested; only motifs that
    begin with a lower-case letter are tested on all sequences. The motifs are a broadcast list if they are few."""
    return _occurrences(df, motifs, seq, [key])


def _occurrences(df: DataFrame, motifs: DataFrame, seq: str, keep: list[str]) -> DataFrame:
    from .joins import bounded

    def ok(at: Column, letter: Column) -> Column:
        here = F.substring(F.col(seq), at + 1, F.lit(1))
        one = F.transform(F.split(letter, ""), lambda a: F.when(a == F.upper(a), here == a).otherwise(here != F.upper(a)))
        return F.exists(one, lambda x: x)

    test = F.forall(F.zip_with("positions", "letters", ok), lambda x: x)
    listed = motifs.select("motif", "positions", "letters")
    first = F.element_at("letters", 1)
    plain = listed.where(first == F.upper(first)).select("*", F.element_at("positions", 1).alias("position"), F.explode(F.split(first, "")).alias("letter"))
    rows = df.select(*keep, seq, F.posexplode(kmers(seq, 1)).alias("position", "letter"))
    found = rows.join(bounded(plain), ["position", "letter"]).where(test).select(*keep, "motif")
    other = listed.where(first != F.upper(first))
    return found if other.isEmpty() else found.union(df.select(*keep, seq).join(bounded(other), test).select(*keep, "motif"))


def confusion(df: DataFrame, motifs: DataFrame, label: str = "positive", seq: str = "seq", key: str = "sequence_id") -> DataFrame:
    """(motif, tp, fp, fn, tn) over sequences with a boolean label; equal ones are tested once, those without a key only count in fn and tn."""
    from ..lineage import cut

    motifs = cut(motifs.select("motif", "positions", "letters"))
    totals = df.agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("q"))
    kinds = df.where(F.col(key).isNotNull()).groupBy(F.col(seq).alias("seq"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    times = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = _occurrences(kinds, motifs, "seq", ["label", "n"]).groupBy("motif").agg(times(F.col("label")).alias("tp"), times(~F.col("label")).alias("fp"))
    rows = motifs.select("motif").distinct().join(found.hint("merge"), "motif", "left").na.fill(0, ["tp", "fp"]).crossJoin(F.broadcast(totals))
    return rows.select("motif", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn"))


def selected(counts: DataFrame, precision: float, recall: float, positives: int) -> DataFrame:
    """Motifs with so many true positives, such a precision and recall."""
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.where((F.col("tp") >= positives) & (p >= precision) & (r >= recall))


def generalised(motifs: DataFrame) -> DataFrame:
    """(motif, positions, letters): motifs that differ in the letter at one position only, merged: one for each subset of two or more of
    those letters. Subsets are over an alphabet, so their number is bounded."""
    rows = motifs.select("positions", "letters", F.posexplode("letters").alias("flexible", "letter"))
    rest = F.transform("letters", lambda x, i: F.when(i == F.col("flexible"), F.lit("*")).otherwise(x))
    groups = rows.select("positions", rest.alias("rest"), "flexible", "letter").groupBy("positions", "rest", "flexible").agg(F.sort_array(F.collect_set("letter")).alias("some")).where(F.size("some") > 1)

    grow = lambda sets, x: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(x))))
    subsets = F.aggregate("some", F.array(F.array().cast("array<string>")), grow)
    out = groups.withColumn("letter", F.explode(F.transform(F.filter(subsets, lambda s: F.size(s) > 1), lambda s: F.array_join(s, ""))))
    letters = F.transform("rest", lambda x, i: F.when(i == F.col("flexible"), F.col("letter")).otherwise(x))
    return out.select("positions", letters.alias("letters")).select(name().alias("motif"), "positions", "letters").distinct()


def max_overlap(learned: DataFrame, truth: DataFrame) -> DataFrame:
    """(motif, truth, overlap): the most positions at which a learned motif and a true pattern agree, over all shifts that put
    some of them together; above 0 only. truth: (truth, positions, letters)."""
    a = learned.select("motif", F.posexplode(F.arrays_zip("positions", "letters")).alias("i", "x")).select("motif", F.col("x.positions").alias("p"), F.col("x.letters").alias("letter"))
    b = truth.select("truth", F.posexplode(F.arrays_zip("positions", "letters")).alias("i", "x")).select("truth", F.col("x.positions").alias("q"), F.col("x.letters").alias("letter"))
    shifts = a.join(b, "letter").groupBy("motif", "truth", (F.col("p") - F.col("q")).alias("shift")).agg(F.count("*").alias("n"))
    return shifts.groupBy("motif", "truth").agg(F.max("n").alias("overlap"))


def gap_shares(motifs: DataFrame) -> DataFrame:
    """(size, gap, share): of the gaps between neighbouring positions of motifs of a size."""
    from pyspark.sql import Window as W

    gaps = F.transform(F.sequence(F.lit(1), F.size("positions") - 1), lambda i: F.get("positions", i) - F.get("positions", i - 1) - 1)
    rows = motifs.where(F.size("positions") > 1).select(F.size("positions").alias("size"), F.explode(gaps).alias("gap"))
    out = rows.groupBy("size", "gap").agg(F.count("*").alias("n"))
    return out.select("size", "gap", (F.col("n") / F.sum("n").over(W.partitionBy("size"))).alias("share"))


def precision_by_support(train: DataFrame, test: DataFrame, least: int = 50, spread: float = 5.0, base: float = 10.0) -> DataFrame:
    """(training_tp, precision, smoothed): of motifs' confusion counts, the combined test precision per training TP, and its mean over all of them
    with log-normal weights (shape 0.1, mode side at the own TP) whose scale is spread * r + base; r is the least whole distance in TP
    within which `least` motifs are, or all. The array that each row sees has an element per distinct TP, not per motif."""
    joined = train.select("motif", F.col("tp").alias("training_tp")).join(test.select("motif", "tp", "fp"), "motif")
    rows = joined.groupBy("training_tp").agg(F.sum("tp").cast("double").alias("t"), F.sum("fp").cast("double").alias("f"), F.count("*").alias("motifs"))
    rows = rows.withColumn("precision", F.coalesce(F.try_divide("t", F.col("t") + F.col("f")), F.lit(0.0)))
    every = rows.agg(F.sort_array(F.collect_list(F.struct("training_tp", "precision", "motifs"))).alias("every"), F.least(F.sum("motifs"), F.lit(least)).alias("need"))
    rows = rows.crossJoin(F.broadcast(every))  # one row
    within = lambda r: F.aggregate("every", F.lit(0).cast("long"), lambda n, x: n + F.when(F.abs(x["training_tp"] - F.col("training_tp")) <= r, x["motifs"]).otherwise(0))
    far = F.array_sort(F.transform("every", lambda x: F.abs(x["training_tp"] - F.col("training_tp"))))
    rows = rows.withColumn("r", F.get(F.filter(far, lambda r: within(r) >= F.col("need")), 0))
    rows = rows.withColumn("scale", F.col("r") * spread + base)

    def weight(x: Column) -> Column:
        z = (x["training_tp"] - F.col("training_tp")) / F.col("scale") + 1
        return F.when(z > 0, F.exp(-F.pow(F.ln(F.when(z > 0, z)), 2) / 0.02) / F.when(z > 0, z)).otherwise(0.0)

    total = lambda f: F.aggregate(F.transform("every", f), F.lit(0.0), lambda s, x: s + x)
    return rows.select("training_tp", "precision", (total(lambda x: weight(x) * x["precision"]) / total(weight)).alias("smoothed"))
