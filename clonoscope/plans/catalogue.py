"""Queries that apply the operators to the test tables, with the same in SQL.

The tables stand in for the domain: a lineitem row is a sequence (its part's name, brand and type are its letters, V and J gene, its
supplier the repertoire, its order the cell, its quantity the count, its return flag the locus); suppliers with nation and region
are the metadata, the positive class being region ASIA.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import encoders as E
from ..operators import filters as P
from ..operators import joins as J
from ..operators import models as L
from ..operators import motifs as M
from ..operators import products as V
from ..operators import simulation as G
from ..operators import reports as T
from ..operators import splits as U
from ..operators import stats as A
from ..sources import readers as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{BASE}{sql}"
        return f

    return put


#: The stand-ins in SQL: s is sequences, m metadata, p distinct named parts.
BASE = """WITH RECURSIVE s AS (
  SELECT l_suppkey AS repertoire_id, l_orderkey || '_' || l_linenumber AS sequence_id, l_orderkey AS cell_id, l_linenumber AS n, l_partkey AS item,
         l_quantity::BIGINT AS duplicate_count, l_returnflag AS locus, p_brand AS v_call, p_type AS j_call, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey
), m AS (
  SELECT s_suppkey AS repertoire_id, s_acctbal AS balance, n_name AS nation, r_name AS region, r_name = 'ASIA' AS positive
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), p AS (
  SELECT p_partkey AS id, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS seq, p_brand AS v_call, p_type AS j_call, p_size AS size, 'L' AS locus FROM part
) """


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def letters(c: str) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("v_call"), F.col("p_type").alias("j_call"), letters("p_name").alias("seq"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("repertoire_id"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("sequence_id"), F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("duplicate_count"), F.col("l_returnflag").alias("locus"),
    )
    return rows.join(part, "item")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("s_suppkey").alias("repertoire_id"), F.col("s_acctbal").alias("balance"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), (F.col("r_name") == "ASIA").alias("positive"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), letters("p_name").alias("seq"), F.col("p_brand").alias("v_call"), F.col("p_type").alias("j_call"), F.col("p_size").alias("size"), F.lit("L").alias("locus"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded_six(F.col(c)) for c in columns})


def rounded_six(x: Column) -> Column:
    """round(x, 6), which is slow, only near a tie or for large numbers; else the same by a compiled rounding."""
    y = x * 1e6
    return F.when((F.abs(y) < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 1e-3), F.rint(y) / 1e6 + 0.0).otherwise(F.round(x, 6))


KEY = "repertoire_id"

# k-mers

COUNTS = ", k AS (SELECT repertoire_id, substr(seq, i, 3) AS feature, duplicate_count FROM s, unnest(range(1, length(seq) - 1)) AS t(i)), c AS (SELECT repertoire_id, feature, count(*)::DOUBLE AS v FROM k GROUP BY ALL) "


def _frequencies(norm: str, **params) -> Query:
    return lambda spark, d: rounded(E.kmer_frequencies(sequences(spark, d), KEY, normalisation=norm, by_locus=False, **({"k": 3} | params)), "value")


@query(COUNTS + "SELECT repertoire_id, feature, round(v / sum(v) OVER (PARTITION BY repertoire_id), 6) AS value FROM c")
def kmer_freq_l1(spark, d):
    return _frequencies("RELATIVE_FREQUENCY")(spark, d)


@query(COUNTS + "SELECT repertoire_id, feature, round(v / sqrt(sum(v * v) OVER (PARTITION BY repertoire_id)), 6) AS value FROM c")
def kmer_freq_l2(spark, d):
    return _frequencies("L2")(spark, d)


@query(COUNTS + "SELECT repertoire_id, feature, round(v / max(v) OVER (PARTITION BY repertoire_id), 6) AS value FROM c")
def kmer_freq_max(spark, d):
    return _frequencies("MAX")(spark, d)


@query(COUNTS + "SELECT repertoire_id, feature, 1.0::DOUBLE AS value FROM c")
def kmer_freq_binary(spark, d):
    return _frequencies("BINARY")(spark, d)


@query(COUNTS + "SELECT repertoire_id, feature, sum(duplicate_count)::DOUBLE AS value FROM k GROUP BY ALL")
def kmer_reads_all(spark, d):
    return _frequencies("NONE", reads="all")(spark, d)


@query(", k AS (SELECT repertoire_id, substr(seq, i, 1) || repeat('.', g) || substr(seq, i + 1 + g, 2) AS feature FROM s, unnest(range(0, 3)) AS u(g), unnest(range(1, length(seq) - g - 1)) AS t(i)) SELECT repertoire_id, feature, count(*)::DOUBLE AS value FROM k GROUP BY ALL")
def kmer_gapped(spark, d):
    return E.kmer_frequencies(sequences(spark, d), KEY, strategy="GAPPED_KMER", normalisation="NONE", by_locus=False, k_left=1, k_right=2, min_gap=0, max_gap=2)


@query(", k AS (SELECT repertoire_id, split_part(v_call, '*', 1) || '_' || substr(seq, i, 3) AS feature FROM s, unnest(range(1, length(seq) - 1)) AS t(i)) SELECT repertoire_id, feature, count(*)::DOUBLE AS value FROM k GROUP BY ALL")
def kmer_vgene(spark, d):
    return E.kmer_frequencies(sequences(spark, d), KEY, strategy="V_GENE_CONT_KMER", normalisation="NONE", by_locus=False, k=3)


IMGT = ", z AS (SELECT *, length(seq) AS l, CASE WHEN length(seq) <= 13 THEN 3 + (length(seq) - 5) // 2 END AS le FROM s WHERE length(seq) BETWEEN 5 AND 13), w AS (SELECT *, CASE WHEN i <= le THEN 104 + i ELSE 117 - l + i END AS pos FROM z, unnest(range(1, l + 1)) AS t(i)) "


@query(IMGT + "SELECT repertoire_id, substr(seq, i, 3) || '_' || pos AS feature, count(*)::DOUBLE AS value FROM w WHERE i <= l - 2 GROUP BY ALL")
def kmer_imgt(spark, d):
    return E.kmer_frequencies(sequences(spark, d), KEY, strategy="IMGT_CONTINUOUS_KMER", normalisation="NONE", by_locus=False, k=3)


@query(IMGT + "SELECT repertoire_id, substr(seq, i, 1) || '.' || substr(seq, i + 2, 1) || '_' || pos AS feature, count(*)::DOUBLE AS value FROM w WHERE i <= l - 2 GROUP BY ALL")
def kmer_imgt_gapped(spark, d):
    return E.kmer_frequencies(sequences(spark, d), KEY, strategy="IMGT_GAPPED_KMER", normalisation="NONE", by_locus=False, k_left=1, k_right=1, min_gap=1, max_gap=1)


@query(", k AS (SELECT cell_id, locus || '_' || substr(seq, i, 3) AS feature FROM s, unnest(range(1, length(seq) - 1)) AS t(i)) SELECT cell_id, feature, count(*)::DOUBLE AS value FROM k GROUP BY ALL")
def kmer_receptors(spark, d):
    return E.kmer_frequencies(sequences(spark, d), "cell_id", normalisation="NONE", k=3)


@query(COUNTS + ", f AS (SELECT feature, sum(v) / n AS mu, sqrt(greatest(sum(v * v) / n - (sum(v) / n) ** 2, 0)) AS sd FROM c, (SELECT count(*)::DOUBLE AS n FROM m) GROUP BY feature, n) SELECT m.repertoire_id, f.feature, round((coalesce(c.v, 0) - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS value FROM m CROSS JOIN f LEFT JOIN c ON m.repertoire_id = c.repertoire_id AND f.feature = c.feature")
def kmer_scaled(spark, d):
    counts, examples = _frequencies("NONE")(spark, d), metadata(spark, d).select(KEY)
    return rounded(E.scaled(counts, E.scale_fit(counts, examples.count()), examples, KEY), "value")


# filters


def _collapsed(how: str) -> Query:
    def f(spark, d):
        df = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", F.col("l_quantity").cast("long").alias("duplicate_count"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
        out = P.collapsed(df.withColumn("first_row", F.col("row")), ["l_suppkey", "l_partkey", "l_returnflag"], ["first_row"], "row", how=how)
        return out.withColumn("duplicate_count", F.col("duplicate_count").cast("double")) if how == "mean" else out

    return f


for _how, _sql in {"sum": "sum(q)::BIGINT", "max": "max(q)", "min": "min(q)", "mean": "avg(q)", "first": "arg_min(q, r)", "last": "arg_max(q, r)"}.items():
    QUERIES[f"dup_filter_{_how}"] = _collapsed(_how)
    ORACLES[f"dup_filter_{_how}"] = f"WITH l AS (SELECT l_suppkey, l_partkey, l_returnflag, l_quantity::BIGINT AS q, l_orderkey * 10 + l_linenumber AS r FROM lineitem) SELECT l_suppkey, l_partkey, l_returnflag, min(r) AS first_row, {_sql} AS duplicate_count FROM l GROUP BY ALL"

TREE = {"type": "OR", "operands": [{"type": "AND", "operands": [{"type": "IN", "column": "region", "values": ["ASIA", "EUROPE"]}, {"type": "GREATER_THAN", "column": "balance", "threshold": 0}]}, {"type": "AND", "operands": [{"type": "NOT_IN", "column": "nation", "values": ["FRANCE"]}, {"type": "LESS_THAN", "column": "balance", "threshold": -500}, {"type": "NOT_NA", "column": "region"}]}]}


@query("SELECT repertoire_id, count(*) AS n FROM s WHERE repertoire_id IN (SELECT repertoire_id FROM m WHERE (region IN ('ASIA', 'EUROPE') AND balance > 0) OR (nation NOT IN ('FRANCE') AND balance < -500 AND region IS NOT NULL)) GROUP BY ALL")
def metadata_filter_tree(spark, d):
    return P.metadata_filter(sequences(spark, d), metadata(spark, d), TREE)[0].groupBy(KEY).agg(F.count("*").alias("n"))


@query("SELECT repertoire_id, balance FROM m ORDER BY balance DESC, repertoire_id LIMIT 7")
def criteria_top_n(spark, d):
    return P.top_n(metadata(spark, d), "balance", 7, KEY).select(KEY, "balance")


@query("SELECT * FROM m ORDER BY md5(repertoire_id || ':0'), repertoire_id LIMIT 7")
def criteria_random_n(spark, d):
    return P.random_n(metadata(spark, d), 7, KEY)


@query("SELECT sequence_id, seq FROM s WHERE length(seq) BETWEEN 9 AND 10")
def length_filter(spark, d):
    return P.by_length(sequences(spark, d), "seq", 9, 10).select("sequence_id", "seq")


@query(", f AS (SELECT * FROM s WHERE length(seq) >= 9) SELECT cell_id, n, seq FROM f QUALIFY count(*) OVER (PARTITION BY cell_id) = 2")
def length_filter_pairs(spark, d):
    return P.pairs_by_length(sequences(spark, d), "seq", 9).select("cell_id", "n", "seq")


@query("SELECT sequence_id, duplicate_count FROM s WHERE duplicate_count >= 20")
def count_filter(spark, d):
    return P.by_count(sequences(spark, d), 20).select("sequence_id", "duplicate_count")


@query("SELECT repertoire_id, count(*) AS n FROM s GROUP BY ALL HAVING count(*) BETWEEN 580 AND 620")
def clones_filter(spark, d):
    return P.repertoires_by_size(sequences(spark, d), 580, 620).groupBy(KEY).agg(F.count("*").alias("n"))


@query("SELECT cell_id, count(*) AS n FROM s GROUP BY ALL HAVING bool_and(locus IN ('A', 'N'))")
def chain_filter_all(spark, d):
    return P.chains_only(sequences(spark, d), ["A", "N"], "cell_id").groupBy("cell_id").agg(F.count("*").alias("n"))


@query("SELECT repertoire_id, count(*) AS n FROM s WHERE locus IN ('R') GROUP BY ALL")
def chain_filter_rows(spark, d):
    return P.chains_only(sequences(spark, d), ["R"], rows_only=True).groupBy(KEY).agg(F.count("*").alias("n"))


@query("SELECT nation AS repertoire_id, count(*) AS n, arg_max(balance, m.repertoire_id) AS balance FROM s JOIN m USING (repertoire_id) GROUP BY nation")
def subject_collect(spark, d):
    seqs, meta = P.by_subject(sequences(spark, d), metadata(spark, d).select(KEY, "balance", F.col("nation").alias("subject_id")))
    return seqs.groupBy(KEY).agg(F.count("*").alias("n")).join(meta, KEY)


@query(", b AS (SELECT *, row_number() OVER (PARTITION BY cell_id, locus ORDER BY duplicate_count DESC, sequence_id) AS r FROM s WHERE locus IN ('A', 'N')) SELECT cell_id, locus, sequence_id FROM b WHERE r = 1 QUALIFY count(*) OVER (PARTITION BY cell_id) = 2")
def receptor_dedup(spark, d):
    df = sequences(spark, d).withColumn("umi_count", F.lit(None).cast("long"))
    return P.receptors(df, ("A", "N")).select("cell_id", "locus", "sequence_id")


@query(", f AS (SELECT cell_id, locus, seq FROM s QUALIFY count(*) OVER (PARTITION BY cell_id) = 2), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY locus, seq) AS i FROM f) SELECT cell_id, max(locus) FILTER (i = 1) AS locus_1, max(locus) FILTER (i = 2) AS locus_2, max(seq) FILTER (i = 1) AS seq_1, max(seq) FILTER (i = 2) AS seq_2 FROM r GROUP BY cell_id")
def receptor_pairs(spark, d):
    return P.paired(sequences(spark, d).select("cell_id", "locus", "seq"), ["seq"])


# counts


@query(", c AS (SELECT repertoire_id, 'v' AS kind, v_call AS feature, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT repertoire_id, 'j', j_call, count(*) FROM s GROUP BY ALL) SELECT repertoire_id, feature, round(n / sum(n) OVER (PARTITION BY repertoire_id, kind), 6) AS value FROM c")
def gene_freq(spark, d):
    return rounded(E.gene_frequencies(sequences(spark, d), ["v_call", "j_call"]), "value")


@query("SELECT v_call, j_call, locus, count(*) AS n FROM s GROUP BY ALL")
def vj_counts(spark, d):
    return A.histogram(sequences(spark, d), ["v_call", "j_call", "locus"])


@query(", b AS (SELECT repertoire_id, v_call, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT repertoire_id, v_call, n / sum(n) OVER (PARTITION BY repertoire_id) AS x FROM b) SELECT region, v_call, round(avg(x), 6) AS mean FROM c JOIN m USING (repertoire_id) GROUP BY ALL")
def vj_norm_mean(spark, d):
    shares = A.histogram(sequences(spark, d), [KEY, "v_call"], [KEY])
    return rounded(shares.join(metadata(spark, d), KEY).groupBy("region", "v_call").agg(F.avg("share").alias("mean")), "mean")


@query(", c AS (SELECT locus, length(seq)::BIGINT AS length, count(*) AS n FROM s GROUP BY ALL) SELECT locus, length, n, round(n / sum(n) OVER (PARTITION BY locus), 6) AS share FROM c")
def length_hist(spark, d):
    return rounded(A.histogram(sequences(spark, d).withColumn("length", F.length("seq").cast("long")), ["locus", "length"], ["locus"]), "share")


@query("SELECT duplicate_count, locus, count(*) AS n FROM s GROUP BY ALL")
def count_hist(spark, d):
    return A.histogram(sequences(spark, d), ["duplicate_count", "locus"])


@query(", c AS (SELECT i::VARCHAR AS position, substr(seq, i, 1) AS letter, count(*) AS n FROM s, unnest(range(1, length(seq) + 1)) AS t(i) GROUP BY ALL) SELECT position, letter, n, round(n / sum(n) OVER (PARTITION BY position), 6) AS share FROM c")
def aa_position_freq(spark, d):
    return rounded(A.letters_by_position(sequences(spark, d)), "share")


@query(IMGT + ", c AS (SELECT pos::VARCHAR AS position, substr(seq, i, 1) AS letter, count(*) AS n FROM w GROUP BY ALL) SELECT position, letter, n, round(n / sum(n) OVER (PARTITION BY position), 6) AS share FROM c")
def aa_imgt_freq(spark, d):
    return rounded(A.letters_by_position(sequences(spark, d), imgt=True), "share")


@query(", c AS (SELECT locus, i::VARCHAR AS position, substr(seq, i, 1) AS letter, count(*) / sum(count(*)) OVER (PARTITION BY locus, i) AS x FROM s, unnest(range(1, length(seq) + 1)) AS t(i) GROUP BY locus, i, letter) SELECT position, letter, round(coalesce(a.x, 0) - coalesce(b.x, 0), 6) AS change FROM (SELECT * FROM c WHERE locus = 'A') a FULL JOIN (SELECT * FROM c WHERE locus = 'N') b USING (position, letter)")
def aa_freq_change(spark, d):
    return rounded(A.frequency_change(sequences(spark, d), "locus", "A", "N"), "change")


@query("SELECT repertoire_id, count(DISTINCT (seq, v_call, j_call)) AS clonotypes FROM s GROUP BY ALL")
def clonotype_count(spark, d):
    return A.clonotypes(sequences(spark, d))


@query("SELECT a.region, b.nation, (SELECT count(*) FROM m WHERE m.region = a.region AND m.nation = b.nation) AS n FROM (SELECT DISTINCT region FROM m) a, (SELECT DISTINCT nation FROM m) b")
def label_crosstab(spark, d):
    return A.crosstab(metadata(spark, d), "region", "nation")


@query("SELECT region, count(*) AS n FROM m GROUP BY ALL")
def label_dist(spark, d):
    return A.histogram(metadata(spark, d), ["region"])


@query(", c AS (SELECT repertoire_id, count(DISTINCT (seq, v_call, j_call)) AS clonotypes FROM s GROUP BY ALL) SELECT region, repertoire_id, clonotypes, row_number() OVER (PARTITION BY region ORDER BY clonotypes DESC, repertoire_id) - 1 AS place FROM c JOIN m USING (repertoire_id)")
def clonotype_order(spark, d):
    df = A.clonotypes(sequences(spark, d)).join(metadata(spark, d).select(KEY, "region"), KEY)
    place = F.row_number().over(W.partitionBy("region").orderBy(F.desc("clonotypes"), KEY)) - 1
    return df.select("region", KEY, "clonotypes", place.cast("long").alias("place"))


# diversity


@query(", t AS (SELECT repertoire_id, duplicate_count / sum(duplicate_count) OVER (PARTITION BY repertoire_id) AS x FROM s) SELECT repertoire_id, round(-sum(x * ln(x)), 6) AS shannon FROM t GROUP BY ALL")
def shannon(spark, d):
    return rounded(A.shannon(sequences(spark, d)), "shannon")


PROFILE = ", t AS (SELECT repertoire_id, duplicate_count / sum(duplicate_count) OVER (PARTITION BY repertoire_id) AS x FROM s), e AS (SELECT repertoire_id, a AS alpha, CASE WHEN a = 1 THEN -sum(x * ln(x)) ELSE ln(sum(pow(x, a))) / (1 - a) END AS entropy, count(*) AS n FROM t, unnest([0.0::DOUBLE, 0.5, 1.0, 2.0, 10.0]) AS u(a) GROUP BY repertoire_id, a) "


@query(PROFILE + "SELECT repertoire_id, alpha, round(entropy, 6) AS entropy, n FROM e")
def renyi_profile(spark, d):
    return rounded(A.renyi(sequences(spark, d), [0, 0.5, 1, 2, 10]), "entropy")


@query(PROFILE + "SELECT repertoire_id, alpha, round(exp(entropy) / n, 6) AS evenness FROM e")
def evenness(spark, d):
    return rounded(A.evenness(sequences(spark, d), [0, 0.5, 1, 2, 10]), "evenness")


# distances

PAIRS = ", x AS (SELECT DISTINCT repertoire_id AS r, item FROM s), z AS (SELECT r, count(*) AS n FROM x GROUP BY r), q AS (SELECT a.r AS r1, b.r AS r2, count(*) AS i FROM x a JOIN x b ON a.item = b.item AND a.r <= b.r GROUP BY ALL), g AS (SELECT a.r AS r1, b.r AS r2, a.n AS n1, b.n AS n2, coalesce(i, 0) AS i FROM z a JOIN z b ON a.r <= b.r LEFT JOIN q ON q.r1 = a.r AND q.r2 = b.r) "


def _pairs(spark, d):
    return A.shared_items(J.presence(sequences(spark, d), ["item"]), ["item"])


@query(PAIRS + "SELECT r1, r2, round(1 - i / (n1 + n2 - i), 6) AS distance FROM g")
def jaccard_pairs(spark, d):
    return rounded(A.jaccard(_pairs(spark, d)), "distance")


@query(PAIRS + "SELECT r1, r2, round(1 - 2 * i / ((1 / n1 + 1 / n2) * n1 * n2), 6) + 0.0 AS distance FROM g")
def morisita_binary(spark, d):
    return rounded(A.morisita_horn_binary(_pairs(spark, d)), "distance").withColumn("distance", F.col("distance") + F.lit(0.0))


@query(PAIRS + "SELECT r1, r2, round(100.0 * i / least(n1, n2), 2) AS percent FROM g")
def overlap_percent(spark, d):
    return A.overlap_percent(_pairs(spark, d)).withColumn("percent", F.col("percent").cast("double"))


OVERLAP = ", k AS (SELECT repertoire_id AS r, seq, sum(duplicate_count)::DOUBLE AS c FROM s GROUP BY ALL), u AS (SELECT DISTINCT seq FROM k), e AS (SELECT a.seq AS sa, b.seq AS sb FROM u a JOIN u b ON length(a.seq) = length(b.seq) AND hamming(a.seq, b.seq) <= %d), o AS (SELECT x.r AS r1, y.r AS r2, sum(x.c * y.c) AS overlap FROM e JOIN k x ON x.seq = e.sa JOIN k y ON y.seq = e.sb GROUP BY ALL) "


def _overlap(spark, d, most):
    return J.overlap(sequences(spark, d), most, genes=False)


@query(OVERLAP % 0 + "SELECT r1, r2, overlap FROM o")
def fuzzy_overlap_d0(spark, d):
    return _overlap(spark, d, 0)


@query(OVERLAP % 1 + "SELECT r1, r2, overlap FROM o")
def fuzzy_overlap_d1(spark, d):
    return _overlap(spark, d, 1)


@query(OVERLAP % 2 + "SELECT r1, r2, overlap FROM o")
def fuzzy_overlap_d2(spark, d):
    return _overlap(spark, d, 2)


@query(OVERLAP % 1 + ", t AS (SELECT r, sum(c) AS total FROM k GROUP BY r), w AS (SELECT t.r, total, coalesce(overlap, 0) AS own FROM t LEFT JOIN o ON o.r1 = t.r AND o.r2 = t.r) SELECT a.r AS r1, b.r AS r2, round(greatest(1 - 2 * coalesce(overlap, 0) / ((a.own / (a.total * a.total) + b.own / (b.total * b.total)) * a.total * b.total), 0), 6) AS distance FROM w a JOIN w b ON a.r <= b.r LEFT JOIN o ON o.r1 = a.r AND o.r2 = b.r")
def morisita_counts(spark, d):
    return rounded(A.morisita_horn_sums(J.pair_sums(sequences(spark, d), 1, genes=False, every=True)), "distance")


# association

TESTED = ", x AS (SELECT DISTINCT repertoire_id, item FROM s), t AS (SELECT count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM m), c AS (SELECT item, count(*) FILTER (positive) AS a, count(*) FILTER (NOT positive) AS b FROM x JOIN m USING (repertoire_id) GROUP BY item), f AS (SELECT item, a, b, p - a AS c, q - b AS d FROM c, t), v AS (SELECT item, a, b, c, d, CASE WHEN a + b <= 1 THEN 2.0 ELSE least(1.0, list_sum([exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) FOR k IN range(a, least(a + b, a + c) + 1)])) END AS p_value FROM f) "


def _tested(spark, d):
    return J.presence(sequences(spark, d), ["item"]), metadata(spark, d).select(KEY, "positive")


@query(TESTED + "SELECT item, a AS positive_present, b AS negative_present, c AS positive_absent, d AS negative_absent FROM f")
def contingency(spark, d):
    return A.contingency(*_tested(spark, d), ["item"])


@query(TESTED + "SELECT item, a AS positive_present, b AS negative_present, c AS positive_absent, d AS negative_absent, round(p_value, 6)::DOUBLE AS p_value FROM v")
def fisher_p(spark, d):
    return rounded(A.with_fisher(A.contingency(*_tested(spark, d), ["item"])), "p_value")


@query(TESTED + "SELECT item FROM v WHERE p_value < 0.2")
def relevant_items(spark, d):
    return A.relevant(*_tested(spark, d), ["item"], 0.2)


@query(TESTED + "SELECT repertoire_id, count(y.item) AS relevant, count(*) AS total FROM x LEFT JOIN (SELECT item FROM v WHERE p_value < 0.2) y ON x.item = y.item GROUP BY ALL")
def seq_abundance(spark, d):
    present, labels = _tested(spark, d)
    return A.abundance(present, A.relevant(present, labels, ["item"], 0.2))


@query(TESTED.replace("SELECT DISTINCT repertoire_id, item FROM s", "SELECT DISTINCT repertoire_id, v_call || substr(seq, i, 4) AS item FROM s, unnest(range(1, length(seq) - 2)) AS t(i)") + "SELECT repertoire_id, count(y.item) AS relevant, count(*) AS total FROM x LEFT JOIN (SELECT item FROM v WHERE p_value < 0.2) y ON x.item = y.item GROUP BY ALL")
def kmer_abundance(spark, d):
    df = sequences(spark, d)
    present = df.select(KEY, F.explode(F.transform(X.kmers("seq", 4), lambda k: F.concat("v_call", k))).alias("item")).distinct()
    labels = metadata(spark, d).select(KEY, "positive")
    return A.abundance(present, A.relevant(present, labels, ["item"], 0.2))


# matching

REFERENCE = [("r1", "SMALLRING", "Brand#2", "ECONOMY"), ("r2", "REDWIDGET", "Brand#17", "SMALL"), ("r3", "BLUEBOLT", "Brand#4", "SMALL"), ("r4", "BLUEBOLTS", "Brand#3", "LARGE"), ("r5", "REDBOLT", "Brand#5", "PROMO")]
REF_SQL = ", ref AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in REFERENCE) + ") AS t(reference_id, rs, rv, rj)) "


def reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, "L") for r in REFERENCE], "reference_id string, seq string, v_call string, j_call string, locus string")


def _one_locus(spark, d):
    return sequences(spark, d).withColumn("locus", F.lit("L"))


@query(REF_SQL + "SELECT repertoire_id, reference_id, count(*) AS matches FROM s JOIN ref ON levenshtein(seq, rs) <= 1 GROUP BY ALL")
def match_reference(spark, d):
    return J.match_counts(_one_locus(spark, d), reference(spark), 1, genes=False, seq="seq")


@query(REF_SQL + "SELECT repertoire_id, reference_id, sum(duplicate_count)::BIGINT AS matches FROM s JOIN ref ON seq = rs AND v_call = rv AND j_call = rj GROUP BY ALL")
def match_reference_reads(spark, d):
    return J.match_counts(_one_locus(spark, d), reference(spark), 0, "all", seq="seq")


@query(REF_SQL + ", t AS (SELECT repertoire_id, count(*) AS total FROM s GROUP BY ALL) SELECT repertoire_id, reference_id, round(count(*) / total, 6) AS matches FROM s JOIN t USING (repertoire_id) JOIN ref ON levenshtein(seq, rs) <= 1 GROUP BY repertoire_id, reference_id, total")
def match_norm(spark, d):
    return rounded(J.match_counts(_one_locus(spark, d), reference(spark), 1, genes=False, normalised=True, seq="seq"), "matches")


@query(REF_SQL + "SELECT repertoire_id, count(*) AS matches FROM s JOIN ref ON levenshtein(seq, rs) <= 1 GROUP BY ALL")
def match_reference_sum(spark, d):
    found = J.match_counts(_one_locus(spark, d), reference(spark), 1, genes=False, seq="seq")
    return found.groupBy(KEY).agg(F.sum("matches").alias("matches"))


#: Reference receptors: cell, locus, sequence; the edits that each locus may have.
RECEPTORS, EDITS = [("c1", "A", "SMALLRING"), ("c1", "N", "REDWIDGET"), ("c2", "A", "BLUEBOLT"), ("c2", "N", "REDBOLT")], {"A": 1, "N": 0}
REC_SQL = ", rec AS (SELECT * FROM (VALUES " + ", ".join(str((*r, EDITS[r[1]])) for r in RECEPTORS) + ") AS t(cell, rl, rs, most)), rm AS (SELECT repertoire_id, cell, locus, duplicate_count FROM s JOIN rec ON locus = rl AND levenshtein(seq, rs) <= most) "


def _receptor_matches(spark, d, **params):
    rows = spark.createDataFrame([(*r, None, None) for r in RECEPTORS], "cell_id string, locus string, seq string, v_call string, j_call string")
    return J.receptor_match_counts(sequences(spark, d), rows, EDITS, genes=False, seq="seq", **params)


@query(REC_SQL + "SELECT repertoire_id, cell || '.' || locus AS feature, sum(duplicate_count)::BIGINT AS matches FROM rm GROUP BY ALL")
def receptor_matches(spark, d):
    return _receptor_matches(spark, d, reads="all")


@query(REC_SQL + "SELECT repertoire_id, locus AS feature, count(*) AS matches FROM rm GROUP BY ALL")
def receptor_matches_sum(spark, d):
    return _receptor_matches(spark, d, summed=True)


@query(REC_SQL + ", c AS (SELECT repertoire_id, cell || '.' || locus AS feature, count(*) AS n FROM rm GROUP BY ALL) SELECT repertoire_id, feature, round(n / sum(n) OVER (PARTITION BY repertoire_id), 6)::DOUBLE AS matches FROM c")
def receptor_matches_norm(spark, d):
    return rounded(_receptor_matches(spark, d, normalised=True), "matches")


@query(REC_SQL + ", c AS (SELECT repertoire_id, cell || '.' || locus AS feature, count(*) AS n FROM rm GROUP BY ALL) SELECT m.repertoire_id, rec.cell || '.' || rl AS feature, coalesce(c.n, 0) AS matches FROM m CROSS JOIN rec LEFT JOIN c ON c.repertoire_id = m.repertoire_id AND c.feature = rec.cell || '.' || rl")
def receptor_matches_zeros(spark, d):
    features = spark.createDataFrame([(f"{c}.{k}",) for c, k, _ in RECEPTORS], "feature string")
    return J.with_zeros(_receptor_matches(spark, d), metadata(spark, d), features, KEY, "matches")


FUZZY = ", k AS (SELECT DISTINCT repertoire_id, seq, v_call, j_call FROM s), u AS (SELECT DISTINCT seq, v_call, j_call FROM k), fp AS (SELECT DISTINCT u.seq, u.v_call, u.j_call, k.repertoire_id FROM u JOIN k ON u.v_call = k.v_call AND u.j_call = k.j_call AND length(u.seq) = length(k.seq) AND hamming(u.seq, k.seq) <= 1) "


def _fuzzy(spark, d):
    return J.fuzzy_presence(sequences(spark, d), 1).withColumn("item", F.concat_ws("_", "seq", "v_call", "j_call"))


@query(FUZZY + "SELECT seq, v_call, j_call, count(*) AS repertoires FROM fp GROUP BY ALL")
def fuzzy_presence(spark, d):
    return _fuzzy(spark, d).groupBy("seq", "v_call", "j_call").agg(F.count("*").alias("repertoires"))


@query(TESTED.replace(", x AS (SELECT DISTINCT repertoire_id, item FROM s)", FUZZY + ", x AS (SELECT repertoire_id, seq || '_' || v_call || '_' || j_call AS item FROM fp)") + "SELECT repertoire_id, count(y.item) AS relevant, count(*) AS total FROM x LEFT JOIN (SELECT item FROM v WHERE p_value < 0.2) y ON x.item = y.item GROUP BY ALL")
def fuzzy_abundance(spark, d):
    present, labels = _fuzzy(spark, d).select(KEY, "item"), metadata(spark, d).select(KEY, "positive")
    return A.abundance(present, A.relevant(present, labels, ["item"], 0.2))


@query(", k AS (SELECT DISTINCT repertoire_id AS r, seq, v_call, j_call FROM s), z AS (SELECT r, count(*) AS n FROM k GROUP BY r), q AS (SELECT a.r AS r1, b.r AS r2, count(*) AS i FROM k a JOIN k b ON a.v_call = b.v_call AND a.j_call = b.j_call AND length(a.seq) = length(b.seq) AND hamming(a.seq, b.seq) <= 1 GROUP BY ALL) SELECT r1, r2, round(greatest(coalesce(1 - i / nullif(a.n + b.n - i, 0), 0), 0), 6) AS distance FROM q JOIN z a ON a.r = r1 JOIN z b ON b.r = r2")
def fuzzy_jaccard(spark, d):
    return rounded(J.fuzzy_jaccard(sequences(spark, d), 1), "distance")


PATTERNS = [("p1", "RED.*", None), ("p2", "[BG]L?[UR]", None), ("p3", "BOLT$", "Brand#4")]


@query(", pat AS (SELECT * FROM (VALUES ('p1', 'RED.*', NULL), ('p2', '[BG]L?[UR]', NULL), ('p3', 'BOLT$', 'Brand#4')) AS t(pattern_id, regex, pv)) SELECT repertoire_id, pattern_id, sum(duplicate_count)::BIGINT AS matches FROM s JOIN pat ON regexp_matches(seq, regex) AND (pv IS NULL OR v_call = pv) GROUP BY ALL")
def regex_match(spark, d):
    patterns = spark.createDataFrame([(i, "L", r, v) for i, r, v in PATTERNS], "pattern_id string, locus string, regex string, v_call string")
    found = J.pattern_matches(_one_locus(spark, d), patterns, v_genes=True, seq="seq")
    return found.groupBy(KEY, "pattern_id").agg(F.sum("duplicate_count").alias("matches"))


@query(", k AS (SELECT DISTINCT seq, v_call, j_call FROM s), n AS (SELECT a.seq, a.v_call, a.j_call, count(b.seq) AS degree FROM k a LEFT JOIN k b ON a.v_call = b.v_call AND a.j_call = b.j_call AND a.seq <> b.seq AND length(a.seq) = length(b.seq) AND hamming(a.seq, b.seq) <= 1 GROUP BY ALL) SELECT degree, count(*) AS sequences FROM n GROUP BY degree")
def node_degree(spark, d):
    return J.node_degrees(sequences(spark, d))


@query(", pos AS (SELECT * FROM p WHERE id % 50 = 0) SELECT id, EXISTS (SELECT 1 FROM pos WHERE pos.v_call = p.v_call AND pos.j_call = p.j_call AND length(pos.seq) = length(p.seq) AND hamming(pos.seq, p.seq) <= 1) AS similar FROM p")
def similar_to_positive(spark, d):
    df = parts(spark, d)
    return J.similar_to_positive(df, df.where("id % 50 = 0")).select("id", "similar")


@query(", pos AS (SELECT * FROM p WHERE id % 50 = 0) SELECT id, EXISTS (SELECT 1 FROM pos WHERE pos.v_call = p.v_call AND pos.j_call = p.j_call AND levenshtein(pos.seq, p.seq) <= 2) AS similar FROM p")
def similar_by_edits(spark, d):
    df = parts(spark, d)
    return J.similar_to_positive(df, df.where("id % 50 = 0"), 2, "levenshtein").select("id", "similar")


@query(REF_SQL + "SELECT id, (SELECT count(*) FROM ref WHERE length(rs) = length(seq) AND hamming(rs, seq) <= 2)::BIGINT AS matches FROM p")
def annotate_reference(spark, d):
    df = parts(spark, d).withColumnRenamed("id", "sequence_id")
    out = J.annotated(df, reference(spark), 2, "matches", seq="seq")
    return out.select(F.col("sequence_id").alias("id"), F.col("matches").cast("long").alias("matches"))


@query("SELECT id, i - 1 AS position, substr(seq, i, 3) AS kmer FROM p, unnest(range(1, length(seq) - 1)) AS t(i) WHERE substr(seq, i, 3) IN ('RED', 'BOL', 'ING')")
def significant_kmer_positions(spark, d):
    words = spark.createDataFrame([("RED",), ("BOL",), ("ING",)], "kmer string")
    return J.containing(parts(spark, d), words, 3).select("id", F.col("position").cast("long").alias("position"), "kmer")


# motifs

GROWN = ", f AS (SELECT id, seq, size > 25 AS positive FROM p), i AS (SELECT id, j - 1 AS pos, substr(seq, j, 1) AS l, positive FROM f, unnest(range(1, length(seq) + 1)) AS t(j)), one AS (SELECT pos, l FROM i GROUP BY ALL HAVING count(*) >= 200), two AS (SELECT a.pos || '&' || b.pos || '-' || a.l || '&' || b.l AS motif, count(*) AS support, count(*) FILTER (a.positive) AS tp, count(*) FILTER (NOT a.positive) AS fp FROM i a JOIN i b ON a.id = b.id AND a.pos < b.pos JOIN one oa ON oa.pos = a.pos AND oa.l = a.l JOIN one ob ON ob.pos = b.pos AND ob.l = b.l GROUP BY ALL HAVING count(*) >= 200) "


def _labelled(spark, d):
    return parts(spark, d).select(F.col("id").alias("sequence_id"), "seq", (F.col("size") > 25).alias("positive"))


@query(GROWN + "SELECT motif, support FROM two UNION ALL SELECT pos || '-' || l, count(*) FROM i JOIN one USING (pos, l) GROUP BY pos, l")
def motif_support(spark, d):
    return M.grown(_labelled(spark, d), 2, 200).select("motif", "support")


@query(GROWN + "SELECT motif, tp, fp, (SELECT count(*) FROM f WHERE positive) - tp AS fn, (SELECT count(*) FROM f WHERE NOT positive) - fp AS tn FROM two")
def motif_confusion(spark, d):
    df = _labelled(spark, d)
    return M.confusion(df, M.grown(df, 2, 200).where(F.size("positions") == 2))


@query(GROWN + "SELECT motif, tp, fp FROM two WHERE tp >= 90 AND tp / (tp + fp) >= 0.48")
def motif_selected(spark, d):
    df = _labelled(spark, d)
    return M.selected(M.confusion(df, M.grown(df, 2, 200).where(F.size("positions") == 2)), 0.48, 0.0, 90).select("motif", "tp", "fp")


@query()
def motif_generalised(spark, d):
    return M.generalised(M.grown(_labelled(spark, d), 2, 200).where(F.size("positions") == 2)).select("motif")


@query(GROWN + ", g AS (SELECT split_part(motif, '-', 1) AS ps FROM two), h AS (SELECT split_part(ps, '&', 2)::BIGINT - split_part(ps, '&', 1)::BIGINT - 1 AS gap FROM g) SELECT 2::BIGINT AS size, gap, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM h GROUP BY gap")
def motif_gaps(spark, d):
    out = M.gap_shares(M.grown(_labelled(spark, d), 2, 200))
    return rounded(out.select(F.col("size").cast("long").alias("size"), F.col("gap").cast("long").alias("gap"), "share"), "share")


# features


@query("SELECT id, length(seq)::DOUBLE AS value FROM p")
def seq_length(spark, d):
    return E.lengths(parts(spark, d), "id").select("id", "value")


@query("SELECT id, string_agg(CASE WHEN substr(seq, i, 1) = a THEN '1' ELSE '0' END, '' ORDER BY i, a) AS bits FROM p, unnest(range(1, 13)) AS t(i), unnest(['A', 'B', 'C', 'D', 'E']) AS u(a) GROUP BY id")
def one_hot(spark, d):
    return parts(spark, d).select("id", F.array_join(E.one_hot("seq", 12, "ABCDE", flatten=True).cast("array<string>"), "").alias("bits"))


@query(", z AS (SELECT id, i AS position, i / 3::DOUBLE AS l, (length(seq) - 1 - i) / 3::DOUBLE AS r, length(seq) AS n FROM p, unnest(range(0, 12)) AS t(i)) SELECT id, position, round(CASE WHEN position < n THEN greatest(1 - l, 0) ELSE 0 END, 6)::DOUBLE AS first, round(CASE WHEN position < n THEN least(l, r, 1) ELSE 0 END, 6)::DOUBLE AS middle, round(CASE WHEN position < n THEN greatest(1 - r, 0) ELSE 0 END, 6)::DOUBLE AS last FROM z")
def position_weights(spark, d):
    rows = parts(spark, d).select("id", F.posexplode(E.position_info("seq", 12, 3)).alias("position", "w"))
    w = lambda i: F.round(F.get("w", i), 6)
    return rows.select("id", F.col("position").cast("long").alias("position"), w(0).alias("first"), w(1).alias("middle"), w(2).alias("last"))


@query(COUNTS + ", t AS (SELECT feature, sum(v) AS total FROM c GROUP BY feature) SELECT m.repertoire_id, t.feature, coalesce(c.v, 0) AS value, total FROM m CROSS JOIN t LEFT JOIN c ON c.repertoire_id = m.repertoire_id AND c.feature = t.feature")
def feature_totals(spark, d):
    return T.with_feature_totals(metadata(spark, d), _frequencies("NONE")(spark, d), KEY)


@query(", l AS (SELECT repertoire_id, trim(x) AS place FROM (SELECT repertoire_id, unnest(split(region || ',' || nation, ',')) AS x FROM m)), a AS (SELECT repertoire_id, avg(duplicate_count) AS score FROM s GROUP BY ALL) SELECT place, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(*) AS runs FROM l JOIN a USING (repertoire_id) GROUP BY place")
def index_by_label(spark, d):
    labelled = T.exploded_label(metadata(spark, d).select(KEY, F.concat_ws(",", "region", "nation").alias("place")), "place")
    scores = sequences(spark, d).groupBy(KEY).agg(F.avg("duplicate_count").alias("score"))
    out = T.index_by_label(labelled.join(scores, KEY), ["place"])
    return rounded(out.select("place", "mean", "sd", F.size("scores").cast("long").alias("runs")), "mean", "sd")


@query(REF_SQL + ", c AS (SELECT repertoire_id, reference_id AS feature, count(*) AS matches FROM s JOIN ref ON levenshtein(seq, rs) <= 1 GROUP BY ALL) SELECT m.repertoire_id, region, feature, matches FROM m LEFT JOIN c USING (repertoire_id)")
def matches_table(spark, d):
    counts = J.match_counts(_one_locus(spark, d), reference(spark), 1, genes=False, seq="seq").withColumnRenamed("reference_id", "feature")
    return T.matches_table(metadata(spark, d), ["region"], counts)


FACTORS = [(a, n, round((ord(a) * k) % 17 / 10 - 0.8, 3)) for a in "ABCDEGILMORSTUW" for k, n in ((3, "f1"), (7, "f2"))]


@query(", fac AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in FACTORS) + ") AS t(letter, feature, factor)), q AS (SELECT repertoire_id, sequence_id, feature, avg(factor::DOUBLE) AS v FROM s, unnest(range(1, length(seq) + 1)) AS t(i), fac WHERE letter = substr(seq, i, 1) GROUP BY ALL) SELECT repertoire_id, feature, round(avg(v), 6) AS value FROM q GROUP BY ALL")
def aa_property(spark, d):
    factors = spark.createDataFrame(FACTORS, "letter string, feature string, factor double")
    return rounded(E.property_means(sequences(spark, d), factors, KEY), "value")


@query("SELECT DISTINCT repertoire_id, 'labels_' || trim(x) AS feature, 1.0::DOUBLE AS value FROM (SELECT repertoire_id, unnest(split(region || ', ' || nation, ',')) AS x FROM m)")
def metadata_multihot(spark, d):
    return E.multi_hot(metadata(spark, d).withColumn("labels", F.concat_ws(", ", "region", "nation")), ["labels"])


@query("SELECT repertoire_id, 'gene:' || v_call AS feature, count(*)::DOUBLE AS value FROM s GROUP BY ALL UNION ALL SELECT repertoire_id, 'kmer:' || substr(seq, i, 2), count(*)::DOUBLE FROM s, unnest(range(1, length(seq))) AS t(i) GROUP BY ALL")
def composite(spark, d):
    df = sequences(spark, d)
    return E.composite({"gene": E.gene_frequencies(df, ["v_call"], normalisation="NONE"), "kmer": E.kmer_frequencies(df, KEY, normalisation="NONE", by_locus=False, k=2)}, KEY)


@query(COUNTS + ", x AS (SELECT feature, region, avg(v) AS a FROM c JOIN m USING (repertoire_id) GROUP BY ALL) SELECT f.feature, round(f.a, 6) AS x, round(g.a, 6) AS y FROM x f JOIN x g USING (feature) WHERE f.region = 'ASIA' AND g.region = 'EUROPE'")
def feature_compare(spark, d):
    df = _frequencies("NONE")(spark, d).join(metadata(spark, d), KEY)
    return rounded(A.feature_comparison(df, "region", "ASIA", "EUROPE"), "x", "y")


@query(COUNTS + "SELECT region, feature, round(avg(v), 6) AS mean, round(stddev_pop(v) / sqrt(count(v)), 6) AS error FROM c JOIN m USING (repertoire_id) GROUP BY ALL")
def feature_mean_err(spark, d):
    df = _frequencies("NONE")(spark, d).join(metadata(spark, d), KEY)
    return rounded(A.mean_and_error(df, ["region", "feature"], error="sem"), "mean", "error")


@query(COUNTS + ", x AS (SELECT feature, sum(v)::DOUBLE AS total FROM c GROUP BY ALL) SELECT feature, total FROM x ORDER BY abs(total) DESC, feature LIMIT 10")
def coef_top_n(spark, d):
    return T.top_coefficients(_frequencies("NONE")(spark, d).groupBy("feature").agg(F.sum("value").alias("total")), 10, "total")


@query("SELECT id, seq, NULL::VARCHAR AS extra FROM p UNION ALL SELECT id, NULL, v_call FROM p")
def union_fill(spark, d):
    from ..dataset import union

    df = parts(spark, d)
    return union(df.select("id", "seq"), df.select("id", F.col("v_call").alias("extra")), fill=True)


@query(", x AS (SELECT DISTINCT region, item FROM s JOIN m USING (repertoire_id)), a AS (SELECT item FROM x WHERE region = 'ASIA'), b AS (SELECT item FROM x WHERE region = 'EUROPE') SELECT count(*) FILTER (b.item IS NULL) AS only_found, count(*) FILTER (a.item IS NOT NULL AND b.item IS NOT NULL) AS both, count(*) FILTER (a.item IS NULL) AS only_truth FROM a FULL JOIN b ON a.item = b.item")
def venn_counts(spark, d):
    df = sequences(spark, d).join(metadata(spark, d).select(KEY, "region"), KEY)
    return T.recovered(df.where("region = 'ASIA'"), df.where("region = 'EUROPE'"), ["item"])


# import


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark, d):
    return R.json_fields(table(spark, d, "events"), "props", {"k": "k"}).select("event_id", F.col("k").cast("long").alias("k"))


@query(", c AS (SELECT id, i, translate(substr(seq, i, 3), 'BEDFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS codon FROM p, unnest(range(1, length(seq) - 1, 3)) AS t(i)), aa AS (SELECT * FROM (VALUES " + ", ".join(str((k, v)) for k, v in X.CODONS.items()) + ") AS t(codon, letter)) SELECT id, string_agg(coalesce(letter, '_'), '' ORDER BY i) AS protein FROM c LEFT JOIN aa USING (codon) GROUP BY id")
def translate_codons(spark, d):
    dna = F.translate("seq", "BEDFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    return parts(spark, d).select("id", X.translated(dna).alias("protein"))


@query("SELECT DISTINCT name, regexp_replace(regexp_replace(regexp_replace(name, '^TCR', 'TR'), '([VDJ])0', '\\1', 'g'), '-0([0-9])', '-\\1', 'g') AS imgt FROM (SELECT 'TCRBV0' || (id % 9) || '-0' || (id % 7) || '*01' AS name FROM p)")
def adaptive_gene_names(spark, d):
    df = parts(spark, d).select(F.concat(F.lit("TCRBV0"), F.col("id") % 9, F.lit("-0"), F.col("id") % 7, F.lit("*01")).alias("name")).distinct()
    return df.select("name", R.imgt_gene("name").alias("imgt"))


@query("SELECT DISTINCT hits, regexp_replace(regexp_replace(regexp_replace(split_part(hits, ',', 1), '\\(.*\\)', ''), '([A-Z0-9])DV', '\\1/DV'), '\\*00$', '') AS v_call FROM (SELECT 'TRAV' || (id % 9) || 'DV' || (id % 5) || '*00(' || id % 90 || '),TRAV1*00(2)' AS hits FROM p)")
def mixcr_calls(spark, d):
    hits = F.concat(F.lit("TRAV"), F.col("id") % 9, F.lit("DV"), F.col("id") % 5, F.lit("*00("), F.col("id") % 90, F.lit("),TRAV1*00(2)"))
    df = parts(spark, d).select(hits.alias("hits")).distinct().withColumn("allVHitsWithScore", F.col("hits"))
    return R.mixcr_calls(df, R.Options()).select("hits", F.col("allVHitsWithScore").alias("v_call"))


@query(", r AS (SELECT id, CASE id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'na' ELSE 'T' END AS flag, CASE id % 3 WHEN 0 THEN ' unresolved' WHEN 1 THEN ' x ' ELSE 'NaN' END AS txt FROM p) SELECT id, CASE WHEN lower(flag) IN ('true', 't', '1') THEN 'T' WHEN lower(flag) IN ('false', 'f', '0') THEN 'F' END AS productive, CASE WHEN lower(trim(txt)) NOT IN ('unresolved', 'no data', 'na', 'unknown', 'nan', '') THEN trim(txt) END AS txt FROM r")
def null_bool_normalise(spark, d):
    k = F.col("id") % 4
    flag = F.when(k == 0, "TRUE").when(k == 1, "false").when(k == 2, "na").otherwise("T")
    txt = F.when(F.col("id") % 3 == 0, " unresolved").when(F.col("id") % 3 == 1, " x ").otherwise("NaN")
    return R.normalised(parts(spark, d).select("id", flag.alias("productive"), txt.alias("txt")))


@query("SELECT id, seq FROM p WHERE regexp_matches(seq, '^[ACDEFGHIKLMNPQRSTVWY]*$')")
def illegal_filter(spark, d):
    return R.legal_only(parts(spark, d).select("id", "seq"), "seq", R.AMINO_ACIDS)


@query("SELECT id, CASE upper(substr(c, 1, 3)) WHEN 'TRB' THEN 'TRB' WHEN 'IGH' THEN 'IGH' END AS locus FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'TRBV1*01' WHEN 1 THEN 'IGHV3' ELSE 'XYZ1' END AS c FROM p)")
def locus_infer(spark, d):
    c = F.when(F.col("id") % 3 == 0, "TRBV1*01").when(F.col("id") % 3 == 1, "IGHV3").otherwise("XYZ1")
    return R.with_locus(parts(spark, d).select("id", c.alias("v_call"))).select("id", "locus")


@query("SELECT id, CASE WHEN length(seq) > 2 THEN substr(seq, 2, length(seq) - 2) END AS cdr3_aa, CASE WHEN length(seq) > 6 THEN substr(seq, 4, length(seq) - 6) END AS cdr3 FROM p")
def cdr3_from_junction(spark, d):
    return R.with_cdr3(parts(spark, d).select("id", F.col("seq").alias("junction_aa"), F.col("seq").alias("junction"))).select("id", "cdr3_aa", "cdr3")


# splits


@query("SELECT repertoire_id, ((row_number() OVER (ORDER BY md5(repertoire_id || ':0'), repertoire_id) - 1) % 5)::INT AS fold FROM m")
def kfold(spark, d):
    return U.k_fold(metadata(spark, d).select(KEY), KEY, 5)


@query("SELECT repertoire_id, CASE WHEN row_number() OVER (ORDER BY md5(repertoire_id || ':0'), repertoire_id) <= floor((SELECT count(*) FROM m) * 0.7) THEN 'train' ELSE 'test' END AS part FROM m")
def random_split(spark, d):
    return U.random_split(metadata(spark, d).select(KEY), KEY, 0.7)


@query("SELECT repertoire_id, region, ((row_number() OVER (PARTITION BY region ORDER BY md5(repertoire_id || ':0'), repertoire_id) - 1) % 3)::INT AS fold FROM m")
def stratified_kfold(spark, d):
    return U.stratified_k_fold(metadata(spark, d).select(KEY, "region"), KEY, "region", 3)


@query("SELECT a.repertoire_id, f.held_out, (dense_rank() OVER (ORDER BY f.held_out) - 1)::BIGINT AS fold, CASE WHEN a.region = f.held_out THEN 'test' ELSE 'train' END AS part FROM m a, (SELECT region AS held_out FROM m GROUP BY region HAVING count(*) >= 5) f")
def leave_one_group_out(spark, d):
    return U.leave_group_out(metadata(spark, d).select(KEY, "region"), "region", 5).select(KEY, "held_out", F.col("fold").cast("long").alias("fold"), "part")


@query("SELECT repertoire_id, CASE WHEN repertoire_id % 3 = 0 THEN 'train' ELSE 'test' END AS part FROM m WHERE repertoire_id % 3 < 2")
def manual_split(spark, d):
    m = metadata(spark, d).select(KEY)
    return U.manual_split(m, KEY, m.where("repertoire_id % 3 = 0"), m.where("repertoire_id % 3 = 1"))


@query("SELECT repertoire_id, sequence_id FROM s QUALIFY row_number() OVER (PARTITION BY repertoire_id ORDER BY md5(sequence_id || ':0'), sequence_id) <= 10")
def subsample(spark, d):
    return U.subsample(sequences(spark, d), 10).select(KEY, "sequence_id")


@query("SELECT sequence_id FROM s ORDER BY md5(sequence_id || ':3'), sequence_id LIMIT (SELECT round(count(*) * 0.01)::BIGINT FROM s)")
def sampled_examples(spark, d):
    return U.sample(sequences(spark, d), "sequence_id", 0.01, 3).select("sequence_id")


@query("SELECT repertoire_id, row_number() OVER (ORDER BY md5(repertoire_id || ':0'), repertoire_id) - 1 AS fold FROM m")
def leave_one_out(spark, d):
    return U.leave_one_out(metadata(spark, d).select(KEY), KEY)


# metrics

SCORED = "SELECT doc_id, toxic AS truth, ((doc_id * 37 + quality * 11 + toxic * 29) % 100) / 100.0::DOUBLE AS score, quality FROM labels"
SCORES = f", a AS ({SCORED}), g AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS guess FROM a) "


def _scored(spark, d):
    df = table(spark, d, "labels")
    score = ((F.col("doc_id") * 37 + F.col("quality") * 11 + F.col("toxic") * 29) % 100) / 100.0
    df = df.select("doc_id", F.col("toxic").alias("truth"), score.alias("score"), "quality")
    return df.withColumn("guess", (F.col("score") >= 0.5).cast("int"))


@query(SCORES + "SELECT truth, guess, count(*) AS n FROM g GROUP BY ALL")
def confusion(spark, d):
    return A.confusion(_scored(spark, d))


CELLS = "count(*) FILTER (truth = 1 AND guess = 1) AS tp, count(*) FILTER (truth <> 1 AND guess = 1) AS fp, count(*) FILTER (truth = 1 AND guess <> 1) AS fn, count(*) FILTER (truth <> 1 AND guess <> 1) AS tn"
RATES = "round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp::DOUBLE * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"
RATE_NAMES = ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "mcc"]


@query(SCORES + f", c AS (SELECT {CELLS} FROM g) SELECT tp, fp, fn, tn, {RATES} FROM c")
def metrics_binary(spark, d):
    return rounded(A.binary_metrics(_scored(spark, d)), *RATE_NAMES)


@query(SCORES + f", c AS (SELECT quality, {CELLS} FROM g GROUP BY quality) SELECT quality, tp, fp, fn, tn, {RATES} FROM c")
def metric_per_group(spark, d):
    return rounded(A.binary_metrics(_scored(spark, d), by=["quality"]), *RATE_NAMES)


@query(", t AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS guess FROM lineitem), c AS (SELECT x AS c, (SELECT count(*) FROM t WHERE truth = x) AS su, (SELECT count(*) FROM t WHERE guess = x) AS g, (SELECT count(*) FROM t WHERE truth = x AND guess = x) AS tp FROM (SELECT truth AS x FROM t UNION SELECT guess FROM t)), r AS (SELECT su, tp, tp / g AS p, tp / su AS r, 2 * (tp / g) * (tp / su) / (tp / g + tp / su) AS f FROM c) SELECT round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro, round(sum(p * su) / sum(su), 6) AS precision_weighted, round(sum(r * su) / sum(su), 6) AS recall_weighted, round(sum(f * su) / sum(su), 6) AS f1_weighted, round(sum(tp) / sum(su), 6) AS f1_micro FROM r")
def metrics_macro(spark, d):
    q = F.col("l_quantity")
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(q < 20, "A").when(q < 35, "N").otherwise("R").alias("guess"))
    out = A.macro_metrics(df)
    return rounded(out, *out.columns)


@query(SCORES + "SELECT round(sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc FROM (SELECT score FROM g WHERE truth = 1) x, (SELECT score FROM g WHERE truth = 0) y")
def auc_rank(spark, d):
    return rounded(A.auc(_scored(spark, d)), "auc")


@query(SCORES + ", c AS (SELECT score AS threshold, count(*) FILTER (truth <> 1) AS q, count(*) FILTER (truth = 1) AS p FROM g GROUP BY score) SELECT threshold, round(sum(q) OVER (ORDER BY threshold DESC) / sum(q) OVER (), 6) AS fpr, round(sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER (), 6) AS tpr FROM c")
def roc_points(spark, d):
    return rounded(A.roc_points(_scored(spark, d)), "fpr", "tpr")


@query(SCORES + "SELECT round(-avg(CASE WHEN truth = 1 THEN ln(greatest(score, 1e-15)) ELSE ln(1 - least(score, 1 - 1e-15)) END), 6) AS log_loss FROM g")
def log_loss(spark, d):
    return rounded(A.log_loss(_scored(spark, d)), "log_loss")


@query(", t AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY ALL), ra AS (SELECT a, sum(n) AS x, max(n) AS best FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS y FROM c GROUP BY b), z AS (SELECT (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM c) AS cc, (SELECT sum(x * (x - 1) / 2) FROM ra) AS rc, (SELECT sum(y * (y - 1) / 2) FROM rb) AS kc, (SELECT -sum(x / (SELECT sum(n) FROM c) * ln(x / (SELECT sum(n) FROM c))) FROM ra) AS ha, (SELECT -sum(y / (SELECT sum(n) FROM c) * ln(y / (SELECT sum(n) FROM c))) FROM rb) AS hb, (SELECT sum(n / (SELECT sum(n) FROM c) * ln(n * (SELECT sum(n) FROM c) / (x * y))) FROM c JOIN ra USING (a) JOIN rb USING (b)) AS mi, (SELECT sum(best) FROM ra) AS best) SELECT round((t * (t - 1) / 2 + 2 * cc - rc - kc) / (t * (t - 1) / 2), 6) AS rand, round((cc - rc * kc / (t * (t - 1) / 2)) / ((rc + kc) / 2 - rc * kc / (t * (t - 1) / 2)), 6) AS adjusted_rand, round(mi, 6) AS mutual_information, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * mi / (ha + hb), 6) AS v_measure, round(cc / sqrt(rc * kc), 6) AS fowlkes_mallows, round(best / t, 6) AS purity FROM z")
def ari_nmi_contingency(spark, d):
    df = table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))
    out = A.clustering_agreement(df, "a", "b")
    return rounded(out, *out.columns)


@query(SCORES + "SELECT round(avg((score - truth) ** 2), 6) AS brier FROM g")
def brier(spark, d):
    return rounded(A.brier(_scored(spark, d)), "brier")


@query(SCORES + ", c AS (SELECT score, count(*) FILTER (truth = 1) AS p, count(*) AS n FROM g GROUP BY score), o AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * cp / cn) / sum(p), 6)::DOUBLE AS average_precision FROM o")
def average_precision(spark, d):
    return rounded(A.average_precision(_scored(spark, d)), "average_precision")


@query(", v AS (SELECT l_returnflag AS truth, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y FROM lineitem), t AS (SELECT truth, 'A' AS class, x AS score FROM v UNION ALL SELECT truth, 'N', y FROM v UNION ALL SELECT truth, 'R', x * y FROM v), c AS (SELECT class, truth = class AS own, CASE WHEN truth <> class THEN truth END AS other, score, count(*)::DOUBLE AS n FROM t GROUP BY ALL), pr AS (SELECT a.class, b.other, sum(a.n * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS w, sum(a.n * b.n) AS z FROM c a JOIN c b ON a.class = b.class AND a.own AND NOT b.own GROUP BY ALL) SELECT round((SELECT avg(r) FROM (SELECT sum(w) / sum(z) AS r FROM pr GROUP BY class)), 6) AS ovr, round((SELECT avg(w / z) FROM pr), 6) AS ovo")
def auc_multiclass(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("truth"), F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    scores = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), v.alias("score")) for c, v in (("A", F.col("x")), ("N", F.col("y")), ("R", F.col("x") * F.col("y")))]))
    df = df.select("truth", scores.alias("s")).select("truth", "s.*")
    both = A.multiclass_auc(df).withColumnRenamed("auc", "ovr").join(A.multiclass_auc(df, pairwise=True).withColumnRenamed("auc", "ovo"), F.lit(True))
    return rounded(both, "ovr", "ovo")


@query(", e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS t(i)), mu AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT i, avg(x) AS g FROM e GROUP BY i), dd AS (SELECT vec_id, label, sum((x - m) ** 2) AS d2 FROM e JOIN mu USING (label, i) GROUP BY ALL), sp AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s, count(*) AS n FROM dd GROUP BY label), b AS (SELECT sum(n * (m - g) ** 2) AS b FROM mu JOIN g USING (i)), pr AS (SELECT a.label, z.label AS other, sqrt(sum((a.m - z.m) ** 2)) AS far FROM mu a JOIN mu z ON a.i = z.i AND a.label <> z.label GROUP BY ALL), r AS (SELECT pr.label, max((a.s + z.s) / far) AS r FROM pr JOIN sp a ON a.label = pr.label JOIN sp z ON z.label = pr.other GROUP BY pr.label) SELECT round((SELECT b FROM b) / ((SELECT count(*) FROM sp) - 1) / ((SELECT sum(w) FROM sp) / ((SELECT sum(n) FROM sp) - (SELECT count(*) FROM sp))), 6) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin")
def cluster_indices(spark, d):
    df = _vectors(spark, d).withColumnRenamed("label", "cluster")
    return rounded(A.internal_indices(df, 64), "calinski_harabasz", "davies_bouldin")


@query(", t AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY ALL), ra AS (SELECT a, sum(n) AS x FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS y FROM c GROUP BY b), z AS (SELECT sum(n) AS t FROM c), em AS (SELECT sum(n / t * ln(t * n / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(t - x - y + n + 1))) AS expected FROM ra, rb, z, unnest(range(greatest(1, x + y - t)::BIGINT, least(x, y)::BIGINT + 1)) AS u(n)), mi AS (SELECT sum(n / t * ln(n * t / (x * y))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), z), ha AS (SELECT -sum(x / t * ln(x / t)) AS ha FROM ra, z), hb AS (SELECT -sum(y / t * ln(y / t)) AS hb FROM rb, z) SELECT round(expected, 6) AS expected, round((mi - expected) / ((ha + hb) / 2 - expected), 6) AS adjusted FROM em, mi, ha, hb")
def ami(spark, d):
    df = table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))
    return rounded(A.adjusted_mutual_information(df, "a", "b"), "expected", "adjusted")


# models, all but the first without SQL


@query(", c AS (SELECT length(seq)::BIGINT AS length, i - 1 AS position, substr(seq, i, 1) AS letter, count(*) AS n FROM p, unnest(range(1, length(seq) + 1)) AS t(i) GROUP BY ALL) SELECT length, position, letter, round(n / sum(n) OVER (PARTITION BY length, position), 6) AS p FROM c")
def pwm_fit(spark, d):
    out = L.pwm_fit(parts(spark, d))
    return rounded(out.select(F.col("length").cast("long").alias("length"), F.col("position").cast("long").alias("position"), "letter", "p"), "p")


@query(", k AS (SELECT id, v_call = 'Brand#4' AS four, substr(seq, i, 3) AS kmer FROM p, unnest(range(1, length(seq) - 1)) AS t(i)), pa AS (SELECT kmer, ln((count(*) + 1) / (sum(count(*)) OVER () + count(*) OVER ())) AS lp FROM k WHERE four GROUP BY kmer), pb AS (SELECT kmer, ln((count(*) + 1) / (sum(count(*)) OVER () + count(*) OVER ())) AS lq FROM k WHERE NOT four GROUP BY kmer) SELECT id, round(avg(coalesce(lp, (SELECT min(lp) FROM pa)) - coalesce(lq, (SELECT min(lq) FROM pb))), 6) AS divergence FROM k LEFT JOIN pa USING (kmer) LEFT JOIN pb USING (kmer) GROUP BY id")
def kmer_kl(spark, d):
    df = parts(spark, d)
    four = F.col("v_call") == "Brand#4"
    return rounded(L.kmer_divergence(df, L.kmer_model(df.where(four), 3), L.kmer_model(df.where(~four), 3), 3), "divergence")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))


@query()
def kmeans(spark, d):
    return L.kmeans(_vectors(spark, d), 4).select("id", "cluster")


@query()
def pca(spark, d):
    return L.pca(_vectors(spark, d), 2).select("id", F.round(F.get("components", 0), 6).alias("c1"), F.round(F.get("components", 1), 6).alias("c2"))


@query()
def kernel_pca(spark, d):
    return L.kernel_pca(_vectors(spark, d), 2).select("id", F.round(F.get("components", 0), 6).alias("c1"), F.round(F.get("components", 1), 6).alias("c2"))


@query()
def clustering_stability(spark, d):
    return L.stability(_vectors(spark, d), {"k2": 2, "k4": 4}, 64, runs=2)


@query()
def logreg_cv(spark, d):
    df = _vectors(spark, d).withColumns({"label": (F.col("label") > 4).cast("double"), "fold": (F.col("id") % 3).cast("int")})
    return L.cross_validated(df, {"l2": L.classifier("LogisticRegression", regParam=0.1, maxIter=10)})


@query(", q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 25 = 0), t AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 25 <> 0), n AS (SELECT q.vec_id AS id, t.vec_id AS t_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS r FROM q, t), v AS (SELECT id, label, count(*) AS n, min(r) AS f FROM n WHERE r <= 5 GROUP BY ALL) SELECT id, arg_max(label, n * 100 - f)::DOUBLE AS label FROM v GROUP BY id")
def knn_vote(spark, d):
    df = _vectors(spark, d)
    return L.knn(df.where("id % 25 <> 0"), df.where("id % 25 = 0"), 5)


@query()
def word2vec(spark, d):
    return E.word2vec(parts(spark, d), "j_call", size=4)


@query()
def beta_binomial(spark, d):
    present, labels = _tested(spark, d)
    rows = A.abundance(present, A.relevant(present, labels, ["item"], 0.2)).join(labels, KEY)
    return rounded(L.BetaBinomial().fit(rows).transform(rows), "log_odds").select(KEY, "log_odds", "guess")


@query()
def random_repertoires(spark, d):
    return G.random_repertoires(spark, 20, {10: 0.5, 20: 0.5}, {12: 0.5, 15: 0.5}, {"disease": {"yes": 0.4, "no": 0.6}})[0]


@query()
def implant_signals(spark, d):
    signal = G.Signal("signal", (G.Seed("AC/DE", 0, 2),))
    df = parts(spark, d).select(F.col("id").cast("string").alias("sequence_id"), F.col("seq").alias("sequence_aa"))
    return G.annotate(G.implanted(df, signal), [signal])


@query("SELECT id AS sequence_id, regexp_matches(seq, 'RED') AS red, regexp_matches(seq, 'B.L') AS bol FROM p")
def annotate_signals(spark, d):
    df = parts(spark, d).select(F.col("id").alias("sequence_id"), F.col("seq").alias("sequence_aa"))
    return df.select("sequence_id", (F.size(X.rolling_match("sequence_aa", "RED", 3)) > 0).alias("red"), (F.size(X.rolling_match("sequence_aa", "B.L", 3)) > 0).alias("bol"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    from ..streaming.streams import windowed_counts as counts

    return counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


# reports


@query(", x AS (SELECT *, sequence_id IN (SELECT sequence_id FROM s WHERE v_call = 'Brand#4') AS hit FROM s) SELECT repertoire_id, count(*) FILTER (hit) AS matches, round(100.0 * count(*) FILTER (hit) / count(*), 6)::DOUBLE AS share, round(100.0 * coalesce(sum(duplicate_count) FILTER (hit), 0) / sum(duplicate_count), 6)::DOUBLE AS clonal_share FROM x GROUP BY ALL")
def match_summary(spark, d):
    df = sequences(spark, d)
    return rounded(T.match_summary(df, df.where("v_call = 'Brand#4'")), "share", "clonal_share")


@query(", x AS (SELECT a.j_call, hamming(a.seq, b.seq)::BIGINT AS distance FROM p a JOIN p b ON a.j_call = b.j_call AND a.id < b.id AND length(a.seq) = length(b.seq)), c AS (SELECT j_call, distance, count(*) AS n FROM x GROUP BY ALL) SELECT j_call, distance, round(n / sum(n) OVER (PARTITION BY j_call), 6) AS share FROM c")
def distance_histogram(spark, d):
    return rounded(T.distance_histogram(parts(spark, d), "j_call").withColumn("distance", F.col("distance").cast("long")), "share")


@query(TESTED + ", n AS (SELECT positive, repertoire_id, th, count(*) FILTER (p_value < th) AS n FROM x JOIN v USING (item) JOIN m USING (repertoire_id), unnest([0.1, 0.3]::DOUBLE[]) AS u(th) GROUP BY ALL) SELECT 1::BIGINT AS k, th AS p, positive, round(avg(n), 6) AS relevant FROM n GROUP BY ALL")
def significant_features(spark, d):
    present, labels = _tested(spark, d)
    out = T.significant_features({1: present}, labels, [0.1, 0.3])
    return rounded(out.withColumn("k", F.col("k").cast("long")), "relevant")


@query(TESTED + "SELECT item, count(*) AS examples FROM x WHERE item IN (SELECT item FROM v WHERE p_value < 0.2) GROUP BY ALL")
def relevant_presence(spark, d):
    present, labels = _tested(spark, d)
    return T.relevant_presence(present, A.relevant(present, labels, ["item"], 0.2))


@query(", x AS (SELECT l_suppkey % 5 AS setting, avg(l_discount) AS score FROM lineitem GROUP BY l_suppkey) SELECT setting, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM x GROUP BY ALL")
def setting_performance(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("score")).withColumn("setting", F.col("l_suppkey") % 5)
    return rounded(T.setting_performance(df, ["setting"]), "mean", "sd")


@query("SELECT nation AS setting, count(*) AS n FROM m GROUP BY ALL ORDER BY n DESC, setting LIMIT 1")
def optimal_setting(spark, d):
    return T.optimal_setting(metadata(spark, d).withColumnRenamed("nation", "setting"))


@query(SCORES + "SELECT quality, count(*) FILTER (truth <> 1 AND guess = 1) AS fp, count(*) FILTER (truth = 1 AND guess <> 1) AS fn FROM g GROUP BY ALL")
def confounder_errors(spark, d):
    return T.errors_by(_scored(spark, d), "quality")


FLAGGED = ", b AS (SELECT locus, seq LIKE '%RED%' AS red, seq LIKE '%BOL%' AS bol, length(seq) > 9 AS long FROM s) "


def _flagged(spark, d):
    return sequences(spark, d).select("locus", F.col("seq").contains("RED").alias("red"), F.col("seq").contains("BOL").alias("bol"), (F.length("seq") > 9).alias("long"))


@query(FLAGGED + "SELECT a, b, count(*) AS n FROM (SELECT unnest(x) AS a, x FROM (SELECT list_filter([CASE WHEN red THEN 'red' END, CASE WHEN bol THEN 'bol' END, CASE WHEN long THEN 'long' END], lambda v: v IS NOT NULL) AS x FROM b)) AS t, unnest(x) AS u(b) WHERE a <= b GROUP BY ALL")
def signal_frequencies(spark, d):
    return G.signal_frequencies(_flagged(spark, d), ["red", "bol", "long"])


@query(FLAGGED + "SELECT red::BIGINT + bol::BIGINT + long::BIGINT AS signals, count(*) AS n FROM b GROUP BY ALL")
def signal_cardinalities(spark, d):
    out = G.cardinalities(_flagged(spark, d), ["red", "bol", "long"])
    return out.withColumn("signals", F.col("signals").cast("long"))


@query(FLAGGED + "SELECT locus, unnest(['red', 'bol', 'long']) AS signal, unnest([round(avg(red::INT), 6), round(avg(bol::INT), 6), round(avg(long::INT), 6)]) AS share FROM b GROUP BY locus")
def signal_shares(spark, d):
    return rounded(T.origin_shares(_flagged(spark, d), "locus", ["red", "bol", "long"]), "share")


@query(FLAGGED + ", f AS (SELECT unnest(['red', 'bol', 'long']) AS a, unnest([red, bol, long]) AS x, [red, bol, long] AS y FROM b), h AS (SELECT a, unnest(['red', 'bol', 'long']) AS b, x, unnest(y) AS y FROM f) SELECT a, b, round(count(*) FILTER (x AND y) / count(*), 6) AS joint, round(count(*) FILTER (x AND y) / count(*) FILTER (y), 6) AS given FROM h GROUP BY a, b")
def signal_conditional(spark, d):
    return rounded(T.conditional(_flagged(spark, d), ["red", "bol", "long"]), "joint", "given")


@query("SELECT CASE WHEN log10(l_extendedprice) < 3 THEN 0 WHEN log10(l_extendedprice) >= 5 THEN 11 ELSE floor((log10(l_extendedprice) - 3) / 0.2) + 1 END::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def pgen_histogram(spark, d):
    return G.log_histogram(table(spark, d, "lineitem"), "l_extendedprice", 3.0, 5.0, 10)


@query(", x AS (SELECT sequence_id, row_number() OVER (ORDER BY sequence_id) AS r FROM s WHERE seq LIKE '%RED%') SELECT sequence_id FROM x WHERE r BETWEEN 11 AND 30")
def signal_quota(spark, d):
    return G.quota(sequences(spark, d).withColumn("red", F.col("seq").contains("RED")), "red", 20, 10).select("sequence_id")


@query(", a AS (SELECT DISTINCT seq FROM s WHERE locus = 'A'), b AS (SELECT DISTINCT seq FROM p WHERE size > 40) SELECT count(*) FILTER (b.seq IS NULL) AS only_found, count(*) FILTER (a.seq IS NOT NULL AND b.seq IS NOT NULL) AS both, count(*) FILTER (a.seq IS NULL) AS only_truth FROM a FULL JOIN b ON a.seq = b.seq")
def recovered_features(spark, d):
    return T.recovered(sequences(spark, d).where("locus = 'A'"), parts(spark, d).where("size > 40"), ["seq"])


@query("SELECT label::BIGINT AS label, (vec_id % 4)::BIGINT AS cluster, count(*) AS n FROM embeddings GROUP BY ALL")
def cluster_labels(spark, d):
    df = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), (F.col("vec_id") % 4).alias("cluster"))
    return A.crosstab(df, "label", "cluster")


NEAR = PAIRS + ", e AS (SELECT r1, r2 FROM g WHERE r1 <> r2 AND 1 - i / (n1 + n2 - i) <= 0.822 UNION SELECT r2, r1 FROM g WHERE r1 <> r2 AND 1 - i / (n1 + n2 - i) <= 0.822)"


def _near(spark, d):
    pairs = A.jaccard(_pairs(spark, d)).where("r1 <> r2 AND distance <= 0.822")
    return pairs.select(F.col("r1").alias("id_1"), F.col("r2").alias("id_2")), metadata(spark, d).select(F.col(KEY).alias("id"))


@query(NEAR + ", c AS (SELECT repertoire_id AS id, repertoire_id AS v FROM m UNION SELECT c.id, e.r2 FROM c JOIN e ON e.r1 = c.v) SELECT id, min(v) AS cluster FROM c GROUP BY id")
def single_linkage(spark, d):
    return L.linked_clusters(*_near(spark, d))


@query(NEAR + ", k AS (SELECT r1 AS id FROM e GROUP BY r1 HAVING count(*) >= 2), c AS (SELECT id, id AS v FROM k UNION SELECT c.id, e.r2 FROM c JOIN e ON e.r1 = c.v JOIN k ON k.id = e.r2), l AS (SELECT id, min(v) AS cluster FROM c GROUP BY id), b AS (SELECT e.r1 AS id, min(cluster) AS near FROM e JOIN l ON l.id = e.r2 GROUP BY e.r1) SELECT repertoire_id AS id, coalesce(l.cluster, b.near) AS cluster FROM m LEFT JOIN l ON l.id = repertoire_id LEFT JOIN b ON b.id = repertoire_id")
def density_clusters(spark, d):
    return L.density_clusters(*_near(spark, d), least=3)


@query(PAIRS + ", f AS (SELECT r1 AS id, r2 AS other, i, n1, n2 FROM g WHERE r1 <> r2 UNION ALL SELECT r2, r1, i, n1, n2 FROM g WHERE r1 <> r2), o AS (SELECT id, region, row_number() OVER (PARTITION BY id ORDER BY 1 - i / (n1 + n2 - i), other) AS r FROM f JOIN m ON m.repertoire_id = other), v AS (SELECT id, region, count(*) AS n, min(r) AS f FROM o WHERE r <= 5 GROUP BY ALL) SELECT id, arg_max(region, n * 100 - f) AS label FROM v GROUP BY id")
def knn_precomputed(spark, d):
    labels = metadata(spark, d).select(F.col(KEY).alias("id"), F.col("region").alias("label"))
    near = V.nearest(J.presence(sequences(spark, d), ["item"]), ["item"], labels.select(F.col("id").alias(KEY)), 5)
    return L.knn_precomputed(near, labels, 5)


@query()
def pwm_sample(spark, d):
    df = parts(spark, d)
    lengths = df.groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("n"))
    lengths = lengths.select("length", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("p"))
    return L.pwm_sample(L.pwm_fit(df), lengths, 100)


@query()
def nested_cv(spark, d):
    df = _vectors(spark, d).withColumns({"label": (F.col("label") > 4).cast("double"), "outer": (F.col("id") % 2).cast("int"), "inner": (F.col("id") % 3).cast("int")})
    settings = {"weak": L.classifier("LogisticRegression", regParam=0.01, maxIter=5), "strong": L.classifier("LogisticRegression", regParam=1.0, maxIter=5)}
    return L.nested(df, settings, "outer", "inner")
