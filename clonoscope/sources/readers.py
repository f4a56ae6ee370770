"""Readers of exchange formats: one scan with a column mapping per format, then one chain of column transformations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..dataset import Dataset
from ..functions import text as X
from ..operators.joins import bounded
from ..schema import AMINO_ACIDS, FLAGS, NUCLEOTIDES, PAIRS, TYPES, region_column

#: What stands for no value, and for true, in input files; characters that column names lose.
NULLS = ("unresolved", "no data", "na", "unknown", "nan", "")
TRUE, FALSE = ("true", "t", "1"), ("false", "f", "0")


@dataclass(frozen=True)
class Options:
    """What an import needs to know."""

    path: str = ""
    separator: str = "\t"
    header: bool = True
    columns: dict[str, str] = field(default_factory=dict)  # input name to ours
    metadata_file: str | None = None
    kind: str = "sequence"
    receptor_chains: str | None = None
    labels: tuple[str, ...] = ()
    region: str = "IMGT_CDR3"
    only_productive: bool = True
    only_in_frame: bool = False
    stop_codon_allowed: bool = False
    remove_empty: bool = True
    remove_illegal: bool = True
    organism: str = "human"
    gene_map: str | None = None  # a two-column table (name, IMGT name) for vendor gene names
    before: Callable[[DataFrame, Options], DataFrame] | None = None


def scan(spark: SparkSession, o: Options) -> DataFrame:
    """Files of a folder (*.tsv, *.csv, *.txt) or one file, as strings, with file_name. All columns stay; those that nothing uses later Catalyst leaves out of the rows."""
    reader = spark.read.options(sep=o.separator, header=str(o.header).lower(), pathGlobFilter="*.{tsv,csv,txt}", recursiveFileLookup="true")
    df = reader.csv(o.path).withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    if not o.header:
        df = df.withColumnsRenamed({f"_c{i}": n for i, n in ((int(k), v) for k, v in o.columns.items())})
    return df


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_").replace("#", "_").replace("&", "_").replace(".", "_") for c in df.columns])


def null_like(c: str):
    """NULL for what stands for no value."""
    return F.when(~F.lower(F.trim(F.col(c))).isin(*NULLS), F.trim(F.col(c)))


def flag(c: str):
    """T, F or NULL."""
    low = F.lower(F.col(c).cast("string"))
    return F.when(low.isin(*TRUE), "T").when(low.isin(*FALSE), "F")


def normalised(df: DataFrame) -> DataFrame:
    """Strings trimmed and NULL where they mean nothing, flags as T or F, sequences in upper case, core columns in their types."""
    kinds = dict(df.dtypes)
    for c in [c for c in df.columns if kinds[c] == "string"]:
        value = null_like(c)
        if c in ("sequence", "sequence_aa", "cdr3", "cdr3_aa", "junction", "junction_aa"):
            value = F.nullif(F.upper(F.replace(value, F.lit("#"), F.lit(""))), F.lit(""))
        df = df.withColumn(c, value)
    for c in df.columns:
        if c in FLAGS:
            df = df.withColumn(c, flag(c))
        elif c in TYPES and TYPES[c].typeName() in ("long", "double"):
            number = F.expr(f"try_cast(`{c}` AS DOUBLE)")
            number = F.when(number >= 0, number)  # -1 stands for no count
            df = df.withColumn(c, number.cast("long") if TYPES[c].typeName() == "long" else number)
    return df


def with_cdr3(df: DataFrame) -> DataFrame:
    """CDR3 from the junction, where the table has none."""
    for part, whole, cut in (("cdr3", "junction", 3), ("cdr3_aa", "junction_aa", 1)):
        if whole in df.columns:
            own = F.nullif(X.inner(whole, cut), F.lit(""))
            df = df.withColumn(part, F.coalesce(part, own) if part in df.columns else own)
    return df


def legal_only(df: DataFrame, column: str, alphabet: str) -> DataFrame:
    return df.where(F.col(column).isNull() | F.regexp_like(F.col(column), F.lit(f"^[{alphabet}]*$")))


def by_file(df: DataFrame, **facts) -> DataFrame:
    """df with aggregates over the file that a row is from; over all rows where there is no file name. Files are few beside rows, so that
    adaptive execution broadcasts the table of facts."""
    facts = [f.alias(k) for k, f in facts.items()]
    if "file_name" in df.columns:
        return df.join(df.groupBy("file_name").agg(*facts), "file_name")
    return df.crossJoin(F.broadcast(df.agg(*facts)))  # one row


def with_flag(df: DataFrame, column: str) -> DataFrame:
    """Rows whose flag is T; files in which a row has no flag stay whole."""
    if column not in df.columns:
        return df
    return by_file(df, __all=F.bool_and(F.col(column).isNotNull())).where(~F.col("__all") | (F.col(column) == "T")).drop("__all")


def with_locus(df: DataFrame) -> DataFrame:
    """The locus by its own name if all rows of the file have one; else by the first letters of the V calls, if all have one, else of the
    J calls, if all have one; else as it is."""
    own = X.locus_of("locus") if "locus" in df.columns else F.lit(None).cast("string")
    calls = [c for c in ("v_call", "j_call") if c in df.columns]
    every = lambda c: F.coalesce(F.bool_and(F.col(c).isNotNull()), F.lit(False))
    facts = {f"__{c}": every(c) for c in ["locus", *calls] if c in df.columns}
    if not facts:
        return df
    df = by_file(df, **facts)
    locus = F.when(F.col("__locus"), own) if "__locus" in facts else None
    for c in calls:
        by = X.locus_of(F.substring(c, 1, 3))
        locus = F.when(F.col(f"__{c}"), by) if locus is None else locus.when(F.col(f"__{c}"), by)
    return df.withColumn("locus", locus.otherwise(own)).drop(*facts)


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """df with keys of a JSON object column as columns (key to name); text that isn't such an object gives NULLs."""
    values = F.from_json(column, "map<string,string>")
    return df.withColumns({name: values[key] for key, name in fields.items()})


def with_ids(df: DataFrame) -> DataFrame:
    """A missing sequence_id is a hash of the row: the same in every run."""
    own = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != "sequence_id"])), 256)
    return df.withColumn("sequence_id", F.coalesce("sequence_id", own) if "sequence_id" in df.columns else own)


def with_defaults(df: DataFrame, *columns: str) -> DataFrame:
    """Core columns that are missing, as NULL."""
    return df.withColumns({c: F.lit(None).cast(TYPES[c]) for c in columns if c not in df.columns})


def chain(df: DataFrame, o: Options) -> DataFrame:
    """What every format goes through, in this order."""
    df = clean_names(df)
    if o.before:
        df = o.before(df, o)
    df = normalised(df.withColumnsRenamed({k: v for k, v in o.columns.items() if v not in df.columns}))
    df = with_cdr3(df)
    df = with_defaults(df, "cdr3", "cdr3_aa", "v_call", "j_call", "duplicate_count")
    aa, nt = region_column(o.region), region_column(o.region, "NUCLEOTIDE")
    there = [c for c in (aa, nt) if c in df.columns]
    if o.remove_empty and there:
        df = df.where(F.coalesce(*there).isNotNull())
    if o.remove_illegal:
        for c in there:
            df = legal_only(df, c, (AMINO_ACIDS + ("*" if o.stop_codon_allowed else "")) if c.endswith("_aa") else NUCLEOTIDES)
    if o.only_productive:
        df = with_flag(df, "productive")
    if o.only_in_frame:
        df = with_flag(df, "vj_in_frame")
    df = with_locus(df)
    if o.receptor_chains:
        df = df.where(F.col("locus").isin(*PAIRS[o.receptor_chains]))
    return with_ids(df)


def read(spark: SparkSession, o: Options) -> Dataset:
    """A dataset: repertoires by the metadata file's filename column, receptors as cells of two chains, or sequences."""
    df = chain(scan(spark, o), o)
    if o.kind == "repertoire":
        meta = spark.read.csv(o.metadata_file, header=True)
        if meta.groupBy("filename").count().where("count > 1").limit(1).count():
            raise ValueError("a file name stands for two repertoires")
        name = F.element_at(F.split("filename", "/"), -1)
        meta = meta.withColumn("repertoire_id", F.coalesce("identifier", F.split_part(name, F.lit("."), F.lit(1))) if "identifier" in meta.columns else F.split_part(name, F.lit("."), F.lit(1)))
        keys = meta.select("repertoire_id", name.alias("file_name"))
        df = df.drop("repertoire_id").join(keys, "file_name").drop("file_name")
        return Dataset(df, meta, "repertoire", [c for c in meta.columns if c not in ("filename", "identifier", "repertoire_id", "subject_id")])
    if o.kind == "receptor":
        from ..operators.filters import receptors

        df = receptors(with_defaults(df, "umi_count", "duplicate_count"), PAIRS[o.receptor_chains] if o.receptor_chains else None)
    return Dataset(df.drop("file_name"), None, o.kind, list(o.labels))


# formats: what comes before the common chain


def mixcr_calls(df: DataFrame, o: Options) -> DataFrame:
    """The first hit of a list, without score; DV as /DV; *00 is no allele."""
    def best(c: str):
        first = F.regexp_replace(F.split_part(F.col(c), F.lit(","), F.lit(1)), r"\(.*\)", "")
        return F.regexp_replace(F.regexp_replace(first, r"(?<!/)DV", "/DV"), r"\*00$", "")

    return df.withColumns({c: best(c) for c in df.columns if c.startswith("all") and c.endswith("HitsWithScore")})


def igor_rows(df: DataFrame, o: Options) -> DataFrame:
    """Rows with anchors; the junction translated; in-frame as a flag."""
    if "anchors_found" in df.columns:
        df = df.where(F.col("anchors_found").cast("string") == "1")
    return df.withColumns({"junction": F.col("nt_CDR3"), "junction_aa": X.translated("nt_CDR3"), "vj_in_frame": flag("is_inframe"), "productive": flag("is_inframe")})


def vdjdb_rows(df: DataFrame, o: Options) -> DataFrame:
    """JSON columns as columns; sequence_id from complex and chain, numbered by the rows' content where several rows have it. Complex 0 stands
    for no pair: such rows have no cell, and get a hash as their id."""
    everything = F.to_json(F.struct(*sorted(c for c in df.columns if c != "file_name")))
    df = df.withColumn("__row", everything)
    if "Meta" in df.columns:
        df = json_fields(df, "Meta", {"subject.id": "subject_id", "frequency": "epitope_frequency"})
    pair = F.nullif(F.regexp_replace("complex_id", r"\.0$", ""), F.lit("0"))
    df = df.withColumns({"cell_id": pair, "locus": F.col("Gene")}).withColumn("__id", F.concat("cell_id", F.lit("_"), "Gene"))
    # Rows without a pair are numbered apart, each for itself, and the number isn't used.
    w = W.partitionBy(F.coalesce("__id", "__row"))
    number = F.row_number().over(w.orderBy("__row"))
    df = df.withColumn("sequence_id", F.when(F.count("*").over(w) > 1, F.concat("__id", F.lit("_"), number)).otherwise(F.col("__id")))
    return df.drop("__row", "__id", "Meta", "CDR3fix", "Method")


def imgt_gene(c: str):
    """Vendor gene names by rule: TCRB as TRB, and no leading zeros in family, gene and segment numbers (but in alleles)."""
    name = F.regexp_replace(F.col(c), r"^TCR", "TR")
    return F.regexp_replace(F.regexp_replace(name, r"([VDJ])0", "$1"), r"-0(\d)", "-$1")


def immunoseq_rows(df: DataFrame, o: Options) -> DataFrame:
    """Vendor gene names to IMGT (an own table first, then the rule), the junction cut out of the read, flags from the frame type."""
    have = set(df.columns)
    aa = "amino_acid" if "amino_acid" in have else "aminoAcid"
    nt = "rearrangement" if "rearrangement" in have else "nucleotide"
    if nt in have:
        start = F.lit(85) - 3 * F.length(aa)
        df = df.withColumns({"sequence": F.col(nt), "junction": F.when(F.length(aa) > 0, F.substring(nt, start, 3 * F.length(aa) - 6))})
    frame = next((c for c in ("frame_type", "sequenceStatus") if c in have), None)
    if frame:
        df = df.withColumns({"vj_in_frame": F.when(F.upper(frame) == "IN", "T").otherwise("F"), "stop_codon": F.when(F.upper(frame) == "STOP", "T").otherwise("F"), "productive": F.when(F.length(aa) > 0, "T").otherwise("F")})
    for ours, names in (("v_call", ("v_resolved", "vGeneName")), ("j_call", ("j_resolved", "jGeneName"))):
        if src := next((c for c in names if c in have), None):
            df = df.withColumn(ours, imgt_gene(src))
            if o.gene_map:
                table = df.sparkSession.read.csv(o.gene_map, header=True).toDF("__name", "__imgt")
                df = df.join(bounded(table.dropDuplicates(["__name"])), F.col(src) == F.col("__name"), "left").withColumn(ours, F.coalesce("__imgt", ours)).drop("__name", "__imgt")
    return df.withColumn("junction_aa", F.col(aa))


def ireceptor(spark: SparkSession, folder: str, o: Options) -> Dataset:
    """An unpacked archive: AIRR tables, and JSON metadata with one entry per repertoire, sample and processing; diagnoses become columns."""
    info = spark.read.json(f"{folder}/*.json", multiLine=True)
    rows = info.select(F.explode("Repertoire").alias("r")).select("r.*")
    rows = rows.withColumn("sample", F.explode_outer("sample")).withColumn("data_processing", F.explode_outer("data_processing"))
    meta = rows.select("repertoire_id", F.col("sample.sample_processing_id").alias("sample_processing_id"), F.col("data_processing.data_processing_id").alias("data_processing_id"), F.col("subject.subject_id").alias("subject_id"), F.col("subject.diagnosis").alias("diagnosis"))
    names = meta.select(F.explode("diagnosis").alias("d")).select(F.col("d.disease_diagnosis.label").alias("label")).where("label IS NOT NULL").distinct()
    labels = sorted(r[0] for r in names.collect())
    found = F.transform("diagnosis", lambda d: d["disease_diagnosis"]["label"])
    has = {x: F.array_contains(found, x) for x in labels}
    meta = meta.withColumns(has).drop("diagnosis")
    seqs = chain(scan(spark, replace(o, path=folder)), o)
    keys = [k for k in ("repertoire_id", "sample_processing_id", "data_processing_id") if k in seqs.columns]
    own = F.concat_ws("_", *keys)
    seqs = seqs.withColumn("repertoire_id", own).drop(*keys[1:], "file_name")
    return Dataset(seqs, meta.withColumn("repertoire_id", own).drop(*keys[1:]), "repertoire", labels)


#: Per format, separator, header, and the names that columns have there.
FORMATS: dict[str, Options] = {
    "AIRR": Options(),
    "Generic": Options(),
    "TenxGenomics": Options(separator=",", columns={"barcode": "cell_id", "chain": "locus", "v_gene": "v_call", "d_gene": "d_call", "j_gene": "j_call", "c_gene": "c_call", "cdr3": "junction_aa", "cdr3_nt": "junction", "reads": "consensus_count", "umis": "umi_count", "raw_clonotype_id": "clone_id", "raw_consensus_id": "sequence_id"}),
    "MiXCR": Options(columns={"cloneCount": "duplicate_count", "allVHitsWithScore": "v_call", "allJHitsWithScore": "j_call", "aaSeqCDR3": "junction_aa", "nSeqCDR3": "junction", "aaSeqCDR1": "cdr1_aa", "nSeqCDR1": "cdr1", "aaSeqCDR2": "cdr2_aa", "nSeqCDR2": "cdr2"}, before=mixcr_calls),
    "OLGA": Options(header=False, columns={"0": "junction", "1": "junction_aa", "2": "v_call", "3": "j_call"}),
    "IGoR": Options(separator=",", before=igor_rows),
    "VDJdb": Options(columns={"CDR3": "junction_aa", "V": "v_call", "J": "j_call", "Epitope": "epitope", "Epitope_gene": "epitope_gene", "Epitope_species": "epitope_species"}, before=vdjdb_rows),
    "ImmunoSEQRearrangement": Options(columns={"templates": "duplicate_count"}, before=immunoseq_rows),
    "ImmunoSEQSample": Options(columns={"count_(templates/reads)": "duplicate_count"}, before=immunoseq_rows),
}


def read_format(spark: SparkSession, name: str, path: str, **options) -> Dataset:
    """read_format(spark, "AIRR", folder, kind="repertoire", metadata_file=...)."""
    base = FORMATS[name]
    if "columns" in options:
        options["columns"] = base.columns | options["columns"]
    return read(spark, replace(base, path=path, **options))


def read_patterns(spark: SparkSession, path: str, chains: list[str]) -> DataFrame:
    """(pattern_id, locus, regex, v_call) from a table id, {chain}_regex, {chain}V."""
    df = spark.read.csv(path, sep="\t", header=True)
    parts = []
    for c in chains:
        if f"{c}_regex" in df.columns:
            v = F.nullif(F.col(f"{c}V"), F.lit("")) if f"{c}V" in df.columns else F.lit(None).cast("string")
            parts.append(df.select(F.concat_ws("_", "id", F.lit(c)).alias("pattern_id"), F.lit(c).alias("locus"), F.nullif(F.col(f"{c}_regex"), F.lit("")).alias("regex"), v.alias("v_call")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("regex IS NOT NULL")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(motif, positions, letters) from a table indices, amino_acids."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(F.concat("indices", F.lit("-"), "amino_acids").alias("motif"), F.split("indices", "&").cast("array<int>").alias("positions"), F.split("amino_acids", "&").alias("letters"))
