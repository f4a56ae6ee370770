"""Writers: AIRR tables, design matrices, GLIPH2 input, models and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..schema import NEUTRAL, TYPES


def neutral(df: DataFrame) -> DataFrame:
    """NULLs of core columns as the neutral values of exchange files."""
    return df.withColumns({c: F.coalesce(c, F.lit(NEUTRAL[TYPES[c]])) for c in df.columns if c in TYPES})


def salted(df: DataFrame, key: str = "repertoire_id", parts: int = 16) -> DataFrame:
    """Rows dealt out by key and a part of their hash: a large repertoire is several tasks, and files."""
    return df.repartition(key, F.pmod(F.xxhash64(*df.columns), F.lit(parts)))


def write_airr(data: Dataset, path: str) -> None:
    """Tables of tab-separated text under path/sequences (a folder per repertoire), metadata under path/metadata."""
    rows = neutral(data.sequences)
    writer = salted(rows).write.partitionBy("repertoire_id") if data.kind == "repertoire" else rows.write
    writer.options(sep="\t", header="true").csv(f"{path}/sequences")
    if data.metadata is not None:
        data.metadata.write.options(header="true").csv(f"{path}/metadata")


def write_dataset(data: Dataset, path: str) -> None:
    """Parquet, whose schema travels with it."""
    data.sequences.write.parquet(f"{path}/sequences")
    if data.metadata is not None:
        data.metadata.write.parquet(f"{path}/metadata")


def write_design(df: DataFrame, path: str, key: str, form: str = "parquet", features: list[str] | None = None) -> None:
    """Long (example, feature, value), or wide for a list of features; parquet or csv."""
    from ..operators.encoders import wide

    out = wide(df, key, features) if features else df
    out.write.options(header="true").format(form).save(path)


def gliph2(pairs: DataFrame, subject: str = "subject_id", condition: str = "condition") -> DataFrame:
    """The columns of a GLIPH2 input table from receptors in one row each (as filters.paired with seq, v_call, j_call of TRA, TRB)."""
    return pairs.select(F.col("seq_2").alias("CDR3b"), F.col("v_call_2").alias("TRBV"), F.col("j_call_2").alias("TRBJ"), F.col("seq_1").alias("CDR3a"), F.concat_ws(":", subject, condition).alias("subject_condition"), F.lit(1).alias("count"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(header="true").csv(path)


def write_bags(data: Dataset, path: str) -> None:
    """Repertoires as folders of tab-separated sequences and counts, for an outside trainer."""
    salted(data.sequences.select("repertoire_id", "sequence_aa", "duplicate_count")).write.partitionBy("repertoire_id").options(sep="\t", header="true").csv(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def apply_model(path: str, df: DataFrame) -> DataFrame:
    """A stored pipeline model's predictions."""
    return load_model(path).transform(df)
