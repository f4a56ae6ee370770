"""A dataset: one table of sequences and one of metadata; subsets are semi-joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEYS = {"repertoire": "repertoire_id", "sequence": "sequence_id", "receptor": "cell_id"}


@dataclass(frozen=True)
class Dataset:
    """kind: what an example is (repertoire, sequence or receptor). metadata has one row per repertoire; others have none."""

    sequences: DataFrame
    metadata: DataFrame | None = None
    kind: str = "repertoire"
    labels: list[str] = field(default_factory=list)

    @property
    def key(self) -> str:
        return KEYS[self.kind]

    def examples(self) -> DataFrame:
        """The distinct example ids."""
        table = self.metadata if self.kind == "repertoire" and self.metadata is not None else self.sequences
        return table.select(self.key).where(F.col(self.key).isNotNull()).distinct()

    def count(self) -> int:
        return self.examples().count()

    def subset(self, ids: DataFrame) -> Dataset:
        """The examples whose ids are in a table's column of the key's name."""
        ids = ids.select(self.key).distinct()
        meta = self.metadata.join(ids, self.key, "left_semi") if self.metadata is not None else None
        return replace(self, sequences=self.sequences.join(ids, self.key, "left_semi"), metadata=meta)

    def between(self, first: int, last: int) -> Dataset:
        """Examples number first to last - 1 in the order of their ids (for repertoires, last is included)."""
        number = F.row_number().over(W.orderBy(self.key)) - 1
        end = last if self.kind == "repertoire" else last - 1
        return self.subset(self.examples().withColumn("n", number).where(F.col("n").between(first, end)))

    def with_metadata(self, *columns: str) -> DataFrame:
        """The sequences with columns of their repertoires."""
        if self.metadata is None:
            return self.sequences
        return self.sequences.join(self.metadata.select("repertoire_id", *columns), "repertoire_id")

    def label_values(self) -> DataFrame:
        """label, values: the distinct values of each label."""
        table = self.metadata if self.metadata is not None else self.sequences
        return table.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, self.labels)), F.array(*[F.col(x).cast("string") for x in self.labels]))).alias("label", "value")).groupBy("label").agg(F.sort_array(F.collect_set("value")).alias("values"))


def union(a: DataFrame, b: DataFrame, fill: bool = False) -> DataFrame:
    """All rows of both; columns must be the same unless fill, then missing ones are NULL."""
    if not fill and set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b, allowMissingColumns=fill)
