"""A declarative front end: a dictionary (say, from JSON) of definitions and instructions, run as lazy tables.

    {"datasets": {"d": {"format": "AIRR", "path": "...", "kind": "repertoire", "metadata_file": "..."}},
     "preprocessing": {"p": [{"by_count": {"least": 2}}]},
     "encodings": {"e": {"kmer_frequencies": {"seq": "cdr3_aa", "k": 3}}},
     "instructions": {"i": {"dataset": "d", "preprocessing": "p", "encoding": "e", "report": {"mean_and_error": {"by": ["feature"]}}}}}
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import encoders, filters, reports, stats
from ..sources.readers import read_format

STEPS = {f.__name__: f for f in (filters.by_length, filters.by_count, filters.repertoires_by_size, filters.chains_only, filters.collapsed, filters.pairs_by_length)}
ENCODERS = {f.__name__: f for f in (encoders.kmer_frequencies, encoders.gene_frequencies, encoders.lengths, stats.shannon, stats.renyi, stats.evenness)}
REPORTS = {f.__name__: f for f in (stats.histogram, stats.letters_by_position, stats.clonotypes, stats.mean_and_error, reports.distance_histogram)}
SECTIONS = {"datasets", "preprocessing", "encodings", "instructions"}


def _call(table: dict, step: dict, df: DataFrame) -> DataFrame:
    (name, params), = step.items()
    if name not in table:
        raise ValueError(f"{name} is not one of {sorted(table)}")
    return table[name](df, **params)


def run(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    """The result table of each instruction."""
    if unknown := set(spec) - SECTIONS:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    out = {}
    for name, todo in spec["instructions"].items():
        options = dict(spec["datasets"][todo["dataset"]])
        df = read_format(spark, options.pop("format"), options.pop("path"), **options).sequences
        for step in spec.get("preprocessing", {}).get(todo.get("preprocessing"), []):
            df = _call(STEPS, step, df)
        if "encoding" in todo:
            df = _call(ENCODERS, spec["encodings"][todo["encoding"]], df)
        if "report" in todo:
            df = _call(REPORTS, todo["report"], df)
        out[name] = df
    return out
