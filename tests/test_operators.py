"""Operators against literal expected values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscope.dataset import Dataset, union
from clonoscope.functions import text as X
from clonoscope.operators import encoders as E
from clonoscope.operators import filters as P
from clonoscope.operators import joins as J
from clonoscope.operators import models as L
from clonoscope.operators import motifs as M
from clonoscope.operators import reports as T
from clonoscope.operators import simulation as G
from clonoscope.operators import splits as U
from clonoscope.operators import stats as A


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column.alias("x")).first()["x"]


def test_kmers(spark):
    assert one(spark, "ABCDEFG", X.kmers("s", 3)) == ["ABC", "BCD", "CDE", "DEF", "EFG"]
    assert one(spark, "AB", X.kmers("s", 3)) == []
    assert one(spark, "ABCDEFG", X.kmers("s", 3, overlapping=False)) == ["ABC", "DEF"]
    assert len(X.all_kmers(2, "ABCD")) == 16
    assert one(spark, "CASSRYUF", X.imgt_kmers("s", 3)) == ["CAS_105", "ASS_106", "SSR_107", "SRY_108", "RYU_114", "YUF_115"]
    assert one(spark, "CASSRYUF", X.gapped_kmers("s", 2, 1, 1, 1)) == ["CA.S", "AS.R", "SS.Y", "SR.U", "RY.F"]
    assert one(spark, "CASSRYUF", X.imgt_gapped_kmers("s", 1, 1, 1, 1))[0] == "C.S_105"
    assert sorted(one(spark, "AC", X.neighbours("s", "AC"))) == ["AA", "AC", "CC"]


@pytest.mark.parametrize("n", range(3, 95))
def test_imgt_positions(spark, n):
    if n % 9 and n not in (5, 13, 14, 15, 91, 92):
        return
    names = one(spark, n, X.imgt_positions(F.col("s")), "int")
    assert len(names) == (n if 5 <= n <= 91 else 0) and len(set(names)) == len(names)
    if n == 15:
        assert names == [str(i) for i in range(105, 112)] + ["111.1", "112.1"] + [str(i) for i in range(112, 118)]
    if n == 14:
        assert "112.1" in names and "111.1" not in names
    if names:
        assert one(spark, n + 2, X.imgt_positions(F.col("s"), junction=True), "int") == ["104", *names, "118"]


def test_strings(spark):
    assert one(spark, "ATGTGGTAAC", X.translated("s")) == "MW*"
    assert one(spark, "ATGNNN", X.translated("s")) == "M_"
    assert one(spark, "TRBV1*01, TRBV2*02", X.genes("s")) == ["TRBV1", "TRBV2"]
    assert one(spark, "CASSF", X.inner("s", 1)) == "ASS" and one(spark, "AB", X.inner("s", 1)) == ""
    assert one(spark, "ABCD", X.padded("s", 6)) == "AB__CD"
    assert one(spark, "AAAA", X.hamming("s", F.lit("ABAB"))) == 2 and one(spark, "AAA", X.hamming("s", F.lit("A"))) is None
    assert one(spark, "ACD", X.has_motif("s", [0, 2], ["A", "d"])) is False and one(spark, "ACE", X.has_motif("s", [0, 2], ["A", "d"])) is True
    assert X.motif_of(X.motif_name([0, 2], ["A", "C"])) == ([0, 2], ["A", "C"])
    assert one(spark, "AAAC", X.rolling_match("s", "AA", 2)) == [0, 1]
    assert one(spark, "AAAC", X.pwm_match("s", [{"A": 1.0}, {"C": 1.0}], 2.0)) == [2]
    assert sum(X.position_weights(3, {"105": 0.5}, ["105", "106", "107"]).values()) == pytest.approx(1)
    a, b = F.lit("TRBV1*01,TRBV2"), F.lit("TRBV2*03")
    assert one(spark, "x", X.genes_match(a, b)) and one(spark, "x", X.genes_match(F.lit(""), F.lit(None).cast("string"))) and not one(spark, "x", X.genes_match(a, F.lit("")))


@pytest.fixture(scope="module")
def duplicates(spark):
    aa, nt = ["AAA", "AAA", "CCC", "AAA", "CCC", "CCC", "CCC"], ["AAAAA", "CCAAA", "AACCC", "AAAAA", "AACCC", "AACCC", "AATTT"]
    rows = [(i + 1, a, n, "v1", "j1", "TRB" if i == 6 else "TRA", c) for i, (a, n, c) in enumerate(zip(aa, nt, [10, 20, 30, 5, 20, None, 40]))]
    return spark.createDataFrame(rows, "sequence_id int, aa string, nt string, v_call string, j_call string, locus string, duplicate_count long")


def test_collapse(duplicates):
    keys = ["aa", "v_call", "j_call", "locus"]
    got = sorted(tuple(r) for r in P.collapsed(duplicates, keys, ["sequence_id", "nt"], "sequence_id").select("aa", "nt", "duplicate_count", "sequence_id", "locus").collect())
    assert got == [("AAA", "AAAAA", 35, 1, "TRA"), ("CCC", "AACCC", 50, 3, "TRA"), ("CCC", "AATTT", 40, 7, "TRB")]
    by_nt = P.collapsed(duplicates, ["nt", *keys[1:]], ["sequence_id"], "sequence_id", how="min").orderBy("sequence_id").collect()
    assert [(r["sequence_id"], r["duplicate_count"]) for r in by_nt] == [(1, 5), (2, 20), (3, 20), (7, 40)]


def test_filters(spark):
    counts = spark.createDataFrame([(r, c) for r, cs in enumerate([[1, 2, 3], [4, 1], [5, 6, None, 1]]) for c in cs], "repertoire_id int, duplicate_count long")
    kept = lambda least, drop=True: {r["repertoire_id"]: r["count"] for r in P.by_count(counts, least, drop).groupBy("repertoire_id").count().collect()}
    assert kept(2)[0] == 2 and kept(5).get(0) is None and kept(0)[2] == 3 and kept(0, False)[2] == 4 and set(kept(4)) == {1, 2}
    assert P.repertoires_by_size(counts, 3).select("repertoire_id").distinct().count() == 2
    with pytest.raises(ValueError):
        P.not_empty(P.repertoires_by_size(counts, 10))
    cells = spark.createDataFrame([(1, "AAAAA"), (1, "CC"), (2, "AAAAA"), (2, "CCCCC")], "cell_id int, seq string")
    assert [r["cell_id"] for r in P.pairs_by_length(cells, "seq", 4).collect()] == [2, 2]
    chains = spark.createDataFrame([(1, "TRA"), (2, "TRB"), (2, "TRA")], "repertoire_id int, locus string")
    assert [r[0] for r in P.chains_only(chains, ["TRA"]).select("repertoire_id").collect()] == [1]
    assert P.chains_only(chains, ["TRA"], rows_only=True).count() == 2


def test_criteria(spark):
    rows = list(zip(["flu", "ebv", "GAD", "PPI", "GAD", "PPI", "ebv"], [0.01, 1e-5, 1e-6, 0.01, 0.01, 1e-7, 0.1], [0.51, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0], ["yes", "no", None, None, None, None, None], range(7)))
    df = spark.createDataFrame(rows, "m string, p double, odds double, a string, i int")
    spec = {"type": "OR", "operands": [{"type": "AND", "operands": [{"type": "IN", "column": "m", "values": ["GAD", "PPI"]}, {"type": "LESS_THAN", "column": "p", "threshold": 0.001}]}, {"type": "AND", "operands": [{"type": "IN", "column": "a", "values": ["yes"]}, {"type": "GREATER_THAN", "column": "odds", "threshold": 0.5}]}]}
    assert [r["i"] for r in df.where(P.criterion(spec)).orderBy("i").collect()] == [0, 2, 5]
    assert df.where(P.criterion({"type": "NOT_IN", "column": "a", "values": ["yes"]})).count() == 6
    assert df.where(P.criterion({"type": "NOT_NA", "column": "a"})).count() == 2


def test_kmer_frequencies(spark):
    df = spark.createDataFrame([(1, "AAA"), (1, "ATA"), (1, "ATA"), (2, "ATA"), (2, "TAA"), (2, "AAC")], "repertoire_id int, seq string")
    got = {(r[0], r[1]): round(r[2], 2) for r in E.kmer_frequencies(df, k=3).collect()}
    assert got == {(1, "AAA"): 0.33, (1, "ATA"): 0.67, (2, "ATA"): 0.33, (2, "TAA"): 0.33, (2, "AAC"): 0.33}
    dense = E.with_vocabulary(E.kmer_frequencies(df, k=3), spark.createDataFrame([("AAA",), ("TAA",)], "feature string"), df, "repertoire_id")
    assert dense.count() == 4 and dense.where("value = 0").count() == 2


def test_diversity(spark):
    df = spark.createDataFrame([("a", 100), ("a", 50), ("a", 1), ("a", 0)], "repertoire_id string, duplicate_count long")
    got = {r["alpha"]: r["entropy"] for r in A.renyi(df, [1, 0, 10, math.inf]).collect()}
    assert got[1] == pytest.approx(0.6721264005883254) and got[0] == pytest.approx(1.0986122886681098) and got[10] == pytest.approx(0.4577911580328081)
    assert got[math.inf] == pytest.approx(-math.log(100 / 151))
    df = spark.createDataFrame([("a", 10), ("a", 100), ("a", 1), ("b", 10), ("b", 10), ("b", 10)], "repertoire_id string, duplicate_count long")
    assert {r[0]: round(r[1], 3) for r in A.shannon(df).collect()} == {"a": 0.353, "b": 1.099}
    rows = [("x", c) for c in [10] * 1000 + [100] * 1000 + [1] * 1000] + [("y", 10)] * 1000
    df = spark.createDataFrame(rows, "repertoire_id string, duplicate_count long")
    got = {(r[0], round(r[1], 1)): round(r[2], 6) for r in A.evenness(df, [0.0, 0.2]).collect()}
    assert got == {("x", 0.0): 1, ("x", 0.2): 0.786444, ("y", 0.0): 1, ("y", 0.2): 1}


def test_jaccard(spark):
    sets = ["AT", "D", "EF", "TC", "AD"]
    present = spark.createDataFrame([(i, c) for i, s in enumerate(sets) for c in s], "repertoire_id int, item string")
    got = {(r["r1"], r["r2"]): round(r["distance"], 4) for r in A.jaccard(A.shared_items(present, ["item"])).collect()}
    assert got[0, 3] == got[0, 4] == 0.6667 and got[1, 4] == 0.5 and got[0, 1] == 1 and got[2, 2] == 0 and len(got) == 15


def test_fisher_and_abundance(spark):
    rows = ["1000", "1011", "1111", "0001", "0010"]
    present = spark.createDataFrame([(j, i) for i, r in enumerate(rows) for j, x in enumerate(r) if x == "1"], "repertoire_id int, item int")
    labels = spark.createDataFrame([(0, True), (1, False), (2, False), (3, True)], "repertoire_id int, positive boolean")
    got = {r["item"]: round(r["p_value"], 6) for r in A.with_fisher(A.contingency(present, labels, ["item"])).collect()}
    assert got == {0: 2, 1: 0.5, 2: 1.0, 3: 2, 4: 2}
    sets = ["GGG III LLL MMM", "DDD EEE FFF III LLL MMM", "CCC FFF MMM", "AAA CCC EEE FFF LLL MMM"]
    present = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s.split()], "repertoire_id int, item string")
    labels = spark.createDataFrame([(i, i < 2) for i in range(4)], "repertoire_id int, positive boolean")
    for p, want in ((0.4, [(1, 4), (1, 6), (0, 3), (0, 6)]), (0.05, [(0, 4), (0, 6), (0, 3), (0, 6)])):
        out = A.abundance(present, A.relevant(present, labels, ["item"], p)).orderBy("repertoire_id").collect()
        assert [(r["relevant"], r["total"]) for r in out] == want


def test_matches(spark):
    rows = [(0, "AAAA", 10), (1, "SSSS", 10), (2, "SSSS", 5), (2, "CCCC", 5)]
    df = spark.createDataFrame([(r, s, c, "TRBV1*01", "TRBJ1", "TRB") for r, s, c in rows], "repertoire_id int, sequence_aa string, duplicate_count long, v_call string, j_call string, locus string")
    ref = spark.createDataFrame([("a", "AAAA", "TRBV1", "TRBJ1", "TRB"), ("s", "SSSS", "TRBV1", "TRBJ1", "TRB")], "reference_id string, sequence_aa string, v_call string, j_call string, locus string")
    got = lambda **k: {(r[0], r[1]): r[2] for r in J.match_counts(df, ref, **k).collect()}
    assert got() == {(0, "a"): 1, (1, "s"): 1, (2, "s"): 1}
    assert got(normalised=True)[2, "s"] == 0.5 and got(reads="all") == {(0, "a"): 10, (1, "s"): 10, (2, "s"): 5}
    assert got(most=1) == got()


def test_hamming_pairs_agree_with_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(0)
    seqs = ["".join(rnd.choice("AC") for _ in range(rnd.randint(3, 6))) for _ in range(40)]
    df = spark.createDataFrame([(i, s, None, None) for i, s in enumerate(seqs)], "id int, seq string, v_call string, j_call string")
    near = lambda a, b, d: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= d
    cut = lambda a: {a[:i] + a[i + 1 :] for i in range(len(a))}
    for d in (0, 1, 2):
        want = {(i, j) for i, j in itertools.product(range(40), repeat=2) if near(seqs[i], seqs[j], d)}
        assert {tuple(r) for r in J.hamming_pairs(df, df, d).collect()} == want
    want = {(i, j) for i, j in itertools.product(range(40), repeat=2) if near(seqs[i], seqs[j], 1) or seqs[i] in cut(seqs[j]) or seqs[j] in cut(seqs[i])}
    assert {tuple(r) for r in J.hamming_pairs(df, df, 1, indels=True).collect()} == want


def test_patterns(spark):
    df = spark.createDataFrame([(1, "CASSF", "V1", "TRB", 4), (1, "CARF", "V2", "TRB", 2), (2, "CASSF", "V2", "TRA", 1)], "repertoire_id int, sequence_aa string, v_call string, locus string, duplicate_count long")
    p = spark.createDataFrame([("1", "TRB", "CAS", "V1"), ("2", "TRB", "R.$", None), ("3", "TRA", "S{2}", "V9")], "pattern_id string, locus string, regex string, v_call string")
    assert {(r["repertoire_id"], r["pattern_id"]) for r in J.pattern_matches(df, p, v_genes=True).collect()} == {(1, "1"), (1, "2")}
    assert J.pattern_matches(df, p).count() == 3


def test_motifs(spark):
    df = spark.createDataFrame([(0, "AAC", True), (1, "AAC", True), (2, "ACC", False), (3, "CCC", False)], "sequence_id int, seq string, positive boolean")
    grown = {r["motif"]: r["support"] for r in M.grown(df, 2, 2).collect()}
    assert grown["0&2-A&C"] == 3 and grown["0&1-A&A"] == 2 and "0-C" not in grown
    counts = {r["motif"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in M.confusion(df, M.grown(df, 2, 2)).collect()}
    assert counts["0&2-A&C"] == (2, 1, 0, 1) and counts["0&1-A&A"] == (2, 0, 0, 2)
    assert {r["motif"] for r in M.selected(M.confusion(df, M.grown(df, 2, 2)), 1.0, 1.0, 2).collect()} >= {"0&1-A&A"}
    merged = M.generalised(spark.createDataFrame([([0, 1], ["A", "C"]), ([0, 1], ["A", "D"]), ([0, 1], ["A", "E"])], "positions array<int>, letters array<string>"))
    assert {r["motif"] for r in merged.collect()} == {"0&1-A&CD", "0&1-A&CE", "0&1-A&DE", "0&1-A&CDE"}
    a = spark.createDataFrame([("m", [1, 3], ["A", "C"])], "motif string, positions array<int>, letters array<string>")
    b = spark.createDataFrame([("t", [0, 2, 3], ["A", "C", "D"])], "truth string, positions array<int>, letters array<string>")
    assert tuple(M.max_overlap(a, b).first()) == ("m", "t", 2)


def test_splits(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    assert U.random_split(df, "i", 70).where("part = 'train'").count() == 70
    assert sorted(r[1] for r in U.k_fold(df, "i", 7).groupBy("fold").count().collect()) == [14] * 5 + [15] * 2
    folds = U.stratified_k_fold(df.withColumn("y", F.col("i") % 2), "i", "y", 5).groupBy("y", "fold").count().collect()
    assert all(r["count"] == 10 for r in folds)
    assert U.sample(df, "i", 0.25).count() == 25 and U.k_fold(df, "i", 7).collect() == U.k_fold(df, "i", 7).collect()
    assert sorted(r["place"] for r in U.ranked(df, U.shuffled("i", 1)).collect()) == list(range(100))


def test_scaling(spark):
    df = spark.createDataFrame([(1, "f", 2.0), (2, "f", 4.0), (1, "g", 3.0)], "e int, feature string, value double")
    ex = spark.createDataFrame([(1,), (2,), (3,)], "e int")
    fit = {r["feature"]: (r["mean"], r["sd"]) for r in E.scale_fit(df, 3).collect()}
    assert fit["f"] == (2, pytest.approx(math.sqrt(8 / 3))) and fit["g"] == (1, pytest.approx(math.sqrt(2)))
    out = {(r[0], r[1]): r[2] for r in E.scaled(df, E.scale_fit(df, 3), ex, "e").collect()}
    assert len(out) == 6 and out[3, "f"] == pytest.approx(-2 / math.sqrt(8 / 3))


def test_one_hot_and_positions(spark):
    assert one(spark, "AC", E.one_hot("s", 3, "AC")) == [[1, 0], [0, 1], [0, 0]]
    weights = one(spark, "AAAAA", E.position_info("s", 6, 2))
    assert weights[0] == [1, 0, 0] and weights[2] == [0, 1, 0] and weights[4] == [0, 0, 1] and weights[5] == [0, 0, 0]


def test_models(spark):
    rows = [(i, float(i % 2), [float(i % 2) + 0.01 * i, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, label double, features array<double>")
    out = {r["id"]: r["label"] for r in L.knn(df.where("id < 20"), df.where("id >= 20"), 3).collect()}
    assert all(v == k % 2 for k, v in out.items())
    assert L.best_setting(spark.createDataFrame([("a", 0, 0.5), ("b", 0, 0.9), ("a", 1, 0.9), ("b", 1, 0.7)], "setting string, fold int, score double")) == "b"
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "id_1 long, id_2 long")
    got = {r["id"]: r["cluster"] for r in L.linked_clusters(edges, spark.range(1, 7)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    counts = spark.createDataFrame([(True, k, 10) for k in (6, 7, 8, 5)] + [(False, k, 10) for k in (0, 1, 2, 1)], "positive boolean, relevant int, total int")
    assert all((r["guess"] == 1) == r["positive"] for r in L.BetaBinomial().fit(counts).transform(counts).collect())
    flags = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (0, 0, 0), (0, 0, 0)], "truth int, a int, b int")
    assert sorted(L.greedy_rules(flags, "truth", ["a", "b"])) == ["a", "b"]
    pwm = L.pwm_fit(spark.createDataFrame([("AC",), ("AC",), ("AD",)], "seq string"))
    made = L.pwm_sample(pwm, spark.createDataFrame([(2, 1.0)], "length int, p double"), 300).groupBy("seq").count().collect()
    assert {r["seq"] for r in made} == {"AC", "AD"} and 150 < max(r["count"] for r in made) < 250


def test_simulation(spark):
    seqs, meta = G.random_repertoires(spark, 5, {3: 1.0}, {6: 1.0}, {"d": {"x": 1.0}})
    assert seqs.count() == 15 and meta.count() == 5 and {len(r["sequence_aa"]) for r in seqs.collect()} == {6}
    signal = G.Signal("sig", (G.Seed("A/C", 0, 1),))
    assert sorted(p for p, _ in signal.motifs[0].patterns()) == ["A.C", "AC"]
    out = G.annotate(G.implanted(seqs, signal), [signal])
    assert out.where("sig").count() == 15 and G.quota(out, "sig", 4, 2).count() == 4
    pairs = G.random_receptors(spark, 4, {"TRA": {5: 1.0}, "TRB": {6: 1.0}}, {"y": {True: 1.0}})
    assert pairs.count() == 8 and pairs.groupBy("cell_id").count().where("count <> 2").count() == 0


def test_dataset(spark):
    seqs = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "repertoire_id string, x int")
    meta = spark.createDataFrame([("a", "yes"), ("b", "no")], "repertoire_id string, y string")
    data = Dataset(seqs, meta, "repertoire", ["y"])
    assert data.count() == 2 and data.between(1, 1).sequences.count() == 2
    assert data.label_values().first()["values"] == ["no", "yes"]
    assert data.with_metadata("y").count() == 3
    with pytest.raises(ValueError):
        union(seqs, meta)
    assert union(seqs, meta, fill=True).count() == 5


def test_position_weights_of_short_sequences(spark):
    assert one(spark, "AAA", E.position_info("s", 4, 2)) == [[1, 0, 0], [0.5, 0.5, 0.5], [0, 0, 1], [0, 0, 0]]
    assert one(spark, "AA", E.position_info("s", 2, 3)) == [[1, 0, pytest.approx(2 / 3)], [pytest.approx(2 / 3), 0, 1]]


def test_precision_by_support_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    train = [(f"m{i}", rnd.randint(1, 30)) for i in range(60)]
    test = [(m, rnd.randint(0, 9), rnd.randint(0, 9)) for m, _ in train[:50]]
    got = {r["training_tp"]: (r["precision"], r["smoothed"]) for r in M.precision_by_support(spark.createDataFrame(train, "motif string, tp long"), spark.createDataFrame(test, "motif string, tp long, fp long"), 10, 5.0, 10.0).collect()}
    of = dict(train)
    x = sorted({of[m] for m, *_ in test})
    sums = {v: [sum(r[k] for r in test if of[r[0]] == v) for k in (1, 2)] for v in x}
    y = {v: t / (t + f) if t + f else 0 for v, (t, f) in sums.items()}
    number = {v: sum(of[m] == v for m, *_ in test) for v in x}
    assert set(got) == set(x)
    for v in x:
        r = 0
        while sum(n for w, n in number.items() if abs(w - v) <= r) < 10:
            r += 1
        scale = 5.0 * r + 10.0
        pdf = lambda w: 0 if w - v + scale <= 0 else math.exp(-(math.log((w - v + scale) / scale) ** 2) / 0.02) / (w - v + scale)  # noqa: B023, E731
        assert got[v] == (pytest.approx(y[v]), pytest.approx(sum(pdf(w) * y[w] for w in x) / sum(map(pdf, x))))


def test_receptor_matches(spark):
    cell = lambda i, a, b, c: [(i, a, "TRA", "TRAV1", "TRAJ1", c), (i, b, "TRB", "TRBV1", "TRBJ1", c)]
    rows = [*cell(1, "AAAA", "AAAA", 10), *cell(2, "SSSS", "SSSS", 10), *cell(3, "AAAA", "AAAA", 5), *cell(3, "CCCC", "AAAA", 5)]
    df = spark.createDataFrame(rows, "repertoire_id int, sequence_aa string, locus string, v_call string, j_call string, duplicate_count long")
    ref = spark.createDataFrame([("100", "TRA", "AAAA", "TRAV1", "TRAJ1"), ("100", "TRB", "SSSS", "TRBV1", "TRBJ1"), ("200", "TRA", "CCCC", "TRAV1", "TRAJ1"), ("200", "TRB", "TTTT", "TRBV1", "TRBJ1")], "cell_id string, locus string, sequence_aa string, v_call string, j_call string")
    got = lambda **k: {tuple(r) for r in J.receptor_match_counts(df, ref, {"TRA": 0, "TRB": 0}, **k).collect()}
    assert got() == {(1, "100.TRA", 1), (2, "100.TRB", 1), (3, "100.TRA", 1), (3, "200.TRA", 1)}
    assert got(reads="all") == {(1, "100.TRA", 10), (2, "100.TRB", 10), (3, "100.TRA", 5), (3, "200.TRA", 5)}
    assert got(normalised=True) == {(1, "100.TRA", 1), (2, "100.TRB", 1), (3, "100.TRA", 0.5), (3, "200.TRA", 0.5)}
    assert got(summed=True) == {(1, "TRA", 1), (2, "TRB", 1), (3, "TRA", 2)}


def test_fuzzy_presence(spark):
    df = spark.createDataFrame([(1, "AAA", "V1", "J1"), (2, "AAC", "V1", "J1"), (2, "CCC", "V1", "J1"), (3, "AAA", "V2", "J1")], "repertoire_id int, seq string, v_call string, j_call string")
    got = {(r["seq"], r["v_call"], r["repertoire_id"]) for r in J.fuzzy_presence(df, 1).collect()}
    assert got == {("AAA", "V1", 1), ("AAA", "V1", 2), ("AAC", "V1", 1), ("AAC", "V1", 2), ("CCC", "V1", 2), ("AAA", "V2", 3)}
    assert {(r["seq"], r["repertoire_id"]) for r in J.fuzzy_presence(df, 1, genes=False).collect()} >= {("AAC", 3), ("AAA", 2), ("AAA", 3)}


def test_density_clusters(spark):
    points = [0.0, 1.0, 2.0, 3.0, 10.0, 11.0, 20.0, 21.5, 3.9]
    pairs = [(i, j) for i in range(9) for j in range(9) if i < j and abs(points[i] - points[j]) <= 1]
    out = {r["id"]: r["cluster"] for r in L.density_clusters(spark.createDataFrame(pairs, "id_1 long, id_2 long"), spark.range(9), 3).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 1, 8: 1, 4: None, 5: None, 6: None, 7: None}


def test_implants_substitute_and_keep_the_gap(spark):
    df = spark.createDataFrame([(str(i), "GGGGGGGGGG") for i in range(200)], "sequence_id string, sequence_aa string")
    seed = G.Seed("AC/D", 1, 2, substitutions=1, alphabet="ACDE")
    out = [r["sequence_aa"] for r in G.implanted(df, G.Signal("x", (seed,))).collect()]
    import re

    bodies = [re.fullmatch("G*([ACDE]{2})(G{1,2})([ACDE])G*", x) for x in out]
    assert all(bodies) and {len(x) for x in out} == {10}
    changed = [sum(a != b for a, b in zip(m[1] + m[3], "ACD")) for m in bodies]
    assert set(changed) == {0, 1} and 60 < sum(changed) < 140 and {len(m[2]) for m in bodies} == {1, 2}


def test_until_quota(spark):
    def make(i, n):
        return spark.range(i * n, i * n + n).select(F.col("id").alias("sequence_id"), (F.col("id") % 5 == 0).alias("sig"), (F.col("id") % 2).alias("p"))

    assert [r[0] for r in G.until_quota(make, "sig", 5, 10, keep="p = 0").orderBy("sequence_id").collect()] == [0, 10, 20, 30, 40]
    with pytest.raises(ValueError):
        G.until_quota(make, "sig", 50, 10, 3)


def test_small_tables(spark, tmp_path):
    ex = spark.createDataFrame([(1,), (2,)], "repertoire_id int")
    w = spark.createDataFrame([(1, 2.0)], "repertoire_id int, weight double")
    assert {tuple(r) for r in E.example_weights(ex, w, "repertoire_id", 1.0).collect()} == {(1, 2.0), (2, 1.0)}
    with pytest.raises(ValueError):
        E.example_weights(ex, w, "repertoire_id")
    cells = spark.createDataFrame([("b", "TRB", 0), ("a", "TRA", 1), ("b", "TRA", 2), ("a", "TRB", 3)], "cell_id string, locus string, i int")
    assert [(r["cell_id"], r["locus"]) for r in P.in_order(cells, "i").collect()] == [("b", "TRA"), ("b", "TRB"), ("a", "TRA"), ("a", "TRB")]
    both = L.with_origin(ex, spark.createDataFrame([(9,)], "repertoire_id int"))
    assert {tuple(r) for r in both.collect()} == {(1, False), (2, False), (9, True)}
    pwm, lengths = L.pwm_fit(spark.createDataFrame([("AC",), ("AD",)], "seq string")), spark.createDataFrame([(2, 1.0)], "length int, p double")
    L.save_pwm(pwm, lengths, f"{tmp_path}/m")
    assert L.apply_pwm(spark, f"{tmp_path}/m", 20, 3).collect() == L.pwm_sample(pwm, lengths, 20, 3).collect()
    items = spark.createDataFrame([("AAA", "V1", 0.1), ("AAA", "V1", 0.1)], "seq string, v_call string, p double")
    assert [tuple(r) for r in T.relevant_table(items, {"seq": "sequence_aa", "v_call": "v_call"}).collect()] == [("AAA", "V1")]
    weights = L.centroids(spark.createDataFrame([(0, [0.0]), (0, [2.0]), (1, [9.0])], "cluster int, features array<double>"), 1)
    near = L.nearest_centroid(weights, spark.createDataFrame([(5, [3.0]), (6, [8.0])], "id int, features array<double>"))
    assert {tuple(r) for r in near.collect()} == {(5, 0), (6, 1)}
    degrees = spark.createDataFrame([("a", 0, 2), ("b", 0, 4), ("a", 1, 1)], "r string, degree int, sequences long")
    assert {r["degree"]: r["mean"] for r in T.degree_summary(degrees.drop("r"), []).collect()} == {0: 3, 1: 1}
    side = spark.createDataFrame([("m", 1, 2, 3, 4)], "motif string, tp int, fp int, fn int, tn int")
    assert T.motif_scores(side, side).first()["test_fp"] == 2
    assert [r["id"] for r in L.worst(spark.createDataFrame([(1, 0.5), (2, 0.9)], "id int, divergence double"), 1).collect()] == [2]
    z = spark.range(2000).select(G.zipf_counts("id").alias("n"))
    assert z.agg(F.min("n")).first()[0] == 1 and z.where("n = 1").count() > 800


def test_rows_by_file(spark):
    from clonoscope.sources import readers as R

    rows = [("x", "T", "TRBV1", None), ("x", "F", "TRBV2", None), ("y", "T", "IGHV1", "TRB"), ("y", None, None, "IGH"), ("y", "F", "IGHV2", "TRA")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file_name string, productive string, v_call string, locus string, i int")
    assert sorted(r["i"] for r in R.with_flag(df, "productive").collect()) == [0, 2, 3, 4]
    assert [r["locus"] for r in R.with_locus(df).orderBy("i").collect()] == ["TRB", "TRB", "TRB", "IGH", "TRA"]
    v = spark.createDataFrame([("0", "TRA", "A"), ("0", "TRA", "B"), ("7", "TRA", "C"), ("7", "TRB", "D"), ("8", "TRB", "F"), ("8", "TRB", "E")], "complex_id string, Gene string, CDR3 string")
    got = {r["CDR3"]: (r["sequence_id"], r["cell_id"]) for r in R.vdjdb_rows(v, R.Options()).collect()}
    assert got == {"A": (None, None), "B": (None, None), "C": ("7_TRA", "7"), "D": ("7_TRB", "7"), "E": ("8_TRB_1", "8"), "F": ("8_TRB_2", "8")}


def test_more_indices(spark):
    from math import comb, log

    import numpy as np

    from clonoscope.operators import stats as A

    rng = np.random.default_rng(5)
    truth, scores = rng.choice(list("abc"), 60), rng.integers(0, 6, (60, 3)) / 5
    df = spark.createDataFrame([(t, c, float(v)) for t, row in zip(truth.tolist(), scores) for c, v in zip("abc", row)], "truth string, class string, score double")

    def area(p, q):
        return np.mean([(x > y) + (x == y) / 2 for x in p for y in q])

    ovr = np.mean([area(scores[truth == c, i], scores[truth != c, i]) for i, c in enumerate("abc")])
    ovo = np.mean([area(scores[truth == c, i], scores[truth == o, i]) for i, c in enumerate("abc") for o in "abc" if o != c])
    assert abs(A.multiclass_auc(df).first()[0] - ovr) < 1e-9 and abs(A.multiclass_auc(df, pairwise=True).first()[0] - ovo) < 1e-9

    t = 9
    for x in range(1, t + 1):
        for y in range(1, t + 1):
            plain = sum(n / t * log(t * n / (x * y)) * comb(x, n) * comb(t - x, y - n) / comb(t, y) for n in range(max(1, x + y - t), min(x, y) + 1))
            assert abs(A.expected_information(x, y, t) - plain) < 1e-12
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert abs(A.adjusted_mutual_information(same, "a", "b").first()["adjusted"] - 1) < 1e-9
    one = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert A.adjusted_mutual_information(one, "a", "b").first()["adjusted"] == 1

    points = spark.createDataFrame([(0, [0.0, 0.0]), (0, [0.0, 2.0]), (1, [6.0, 0.0]), (1, [6.0, 2.0])], "cluster int, features array<double>")
    got = A.internal_indices(points, 2).first()
    assert abs(got["calinski_harabasz"] - 18) < 1e-9 and abs(got["davies_bouldin"] - 1 / 3) < 1e-9


def test_kernel_components_and_stability(spark):
    import numpy as np

    from clonoscope.operators import models as L

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, features array<double>")
    for kind in ("rbf", "linear", "poly"):
        rows = {r["id"]: r["components"] for r in L.kernel_pca(df, 2, kind).collect()}
        assert rows.pop(99) is None
        got = np.array([rows[i] for i in range(40)])
        d2 = ((x[:, None] - x[None]) ** 2).sum(2)
        kernel = {"rbf": np.exp(-d2 / 3), "linear": x @ x.T, "poly": (x @ x.T / 3 + 1) ** 3}[kind]
        centre = np.eye(40) - 1 / 40
        values, axes = np.linalg.eigh(centre @ kernel @ centre)
        for j in range(2):
            want = axes[:, -1 - j] * np.sqrt(values[-1 - j])
            assert min(np.abs(got[:, j] - want).max(), np.abs(got[:, j] + want).max()) < 1e-8
    assert all(len(r["components"]) == 2 for r in L.kernel_pca(df.where("id < 40"), 2, most=10).collect())
    assert L.kernel_pca(df.where("id < 0"), 2).collect() == []
    apart = spark.createDataFrame([(i, [float(i % 2) * 50 + v[0], v[1]]) for i, v in enumerate(x.tolist())], "id int, features array<double>")
    assert [r["adjusted_rand"] for r in L.stability(apart, {"two": 2}, 2, runs=2).collect()] == [1.0, 1.0]


def test_pairs_of_examples_make_no_join_of_all_that_share_an_item(spark):
    rows = [(r, f"S{'AB'[i % 2]}{i % 5}", "V", "J", i % 3 + r) for r in range(40) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, "SA0", "V", "J", 2), (7, None, "V", "J", 5), (8, "X", "V", "J", None)], "repertoire_id long, seq string, v_call string, j_call string, duplicate_count long")
    for most in (0, 1, 2):
        got = J.overlap(df, most, genes=False)
        assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
        sums = {}
        for r, s, _, _, n in df.collect():
            if s is not None:
                sums.setdefault((r, s), []).append(n)
        sums = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in sums.items()}
        want = {}
        for (a, s), m in sums.items():
            for (b, t), n in sums.items():
                if len(s) == len(t) and sum(x != y for x, y in zip(s, t, strict=True)) <= most:
                    want.setdefault((a, b), []).append(None if m is None or n is None else float(m * n))
        want = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in want.items()}
        assert {(r["r1"], r["r2"]): r["overlap"] for r in got.collect()} == want


def test_products_by_blocks_equal_brute_force(spark, monkeypatch):
    from clonoscope.operators import products as V

    rng = np.random.default_rng(3)
    held = {f"r{i}": set(rng.choice(60, size=rng.integers(1, 20), replace=False).tolist()) for i in range(30)}
    present = spark.createDataFrame([(k, x) for k, v in held.items() for x in v], "repertoire_id string, item long")
    for dense in (4e-11, 1.0):  # made one by one, too
        monkeypatch.setattr(V, "WITHIN", dense)
        monkeypatch.setattr(V, "SMALL", 10)
        got = {(r["r1"], r["r2"]): (r["shared"], r["n1"], r["n2"]) for r in V.shared(present, ["item"]).collect()}
        assert got == {(a, b): (len(held[a] & held[b]), len(held[a]), len(held[b])) for a in held for b in held if a <= b}
        among = present.where("repertoire_id <> 'r3'").select("repertoire_id")
        near = {}
        for r in V.nearest(present, ["item"], among, 4).collect():
            near.setdefault(r["id"], []).append((r["distance"], r["other"]))
        for a in held:
            want = sorted((1 - len(held[a] & held[b]) / len(held[a] | held[b]), b) for b in held if b not in (a, "r3"))[:4]
            assert sorted(near[a])[:4] == want


def test_motifs_and_confusion_broadcast_no_sequences(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ACD"), 4)), bool(i % 3)) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, "AAAA", True)], "sequence_id long, seq string, positive boolean")
    level = M.grown(df, 3, 5)
    plan = level._jdf.queryExecution().optimizedPlan().toString() + M.confusion(df, level)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in x and "(sequence_id" in x for x in plan.splitlines())
    got = {r["motif"]: r["support"] for r in level.collect()}
    want, positive = {}, {}
    for key, s, y in [*rows, (None, "AAAA", True)]:
        for size in (1, 2, 3):
            for at in itertools.combinations(range(4), size):
                name = "&".join(map(str, at)) + "-" + "&".join(s[i] for i in at)
                if key is not None or size == 1:
                    want[name] = want.get(name, 0) + 1
                if key is not None:
                    positive.setdefault(name, []).append(y)
    assert got == {k: n for k, n in want.items() if n >= 5}
    for r in M.confusion(df, level).collect():
        assert (r["tp"], r["fp"]) == (sum(positive[r["motif"]]), len(positive[r["motif"]]) - sum(positive[r["motif"]]))


def test_similar_by_edits_meets_by_pieces(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("AC"), rng.integers(0, 9))), ["V1*01", "V1,V2", "", None][i % 4], ["J1", None][i % 2], "L" if i % 9 else None) for i in range(150)]
    df = spark.createDataFrame([*rows, (500, None, "V1", "J1", "L")], "id long, seq string, v_call string, j_call string, locus string")
    positive = df.where("id % 10 = 3 OR id = 500")
    near = J.similar_to_positive(df, positive, 2, "levenshtein")
    assert "levenshtein" in (plan := near._jdf.queryExecution().optimizedPlan().toString())
    assert not any("Join" in x and "levenshtein" in x and "key_1" not in x for x in plan.splitlines())
    names = lambda c: {x.split("*")[0] for x in (c or "").split(",")} - {""}
    like = lambda a, b: bool(names(a) & names(b)) or not names(a) and not names(b)
    held = {r["id"]: r for r in positive.collect()}
    for r in near.collect():
        want = r["seq"] is not None and any(p["seq"] is not None and r["locus"] and r["locus"] == p["locus"] and like(r["v_call"], p["v_call"]) and like(r["j_call"], p["j_call"]) and edits(r["seq"], p["seq"]) <= 2 for p in held.values())
        assert r["similar"] == bool(want), r
