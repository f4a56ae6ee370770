"""What the operators share: reading tables, cutting lineage, blanks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks of the contracts, the class [\x20\x09-\x0D], and its complement as a word.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"
#: With these settings a query's shuffle files go when it is done, not when the driver happens to collect its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_own: dict[str, str] = {}
#: Where the tables are that cut wrote.
_paths: WeakKeyDictionary = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; an own one only in local mode, where there is one machine."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = made = tempfile.mkdtemp(prefix="clonoscope-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _own[sc.applicationId]


@contextmanager
def settings(spark: SparkSession, now: dict[str, str]) -> Iterator[None]:
    """While it holds, the session has these settings."""
    before = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later stages don't recompute what made it,
    and a lost executor costs only its running tasks. The write's own shuffle files go when it is done.
    rows: of an Arrow batch (of 8 MB at most), where Python makes large values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    now = dict(CLEANED)
    if rows:
        now |= {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    with settings(spark, now):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut wrote and nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            jvm, sc = table.sparkSession._jvm, table.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def squeezed(text: Column) -> Column:
    """text without blanks; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def md5_u32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def components(links: DataFrame) -> DataFrame:
    """links (u, v) as (u, v): every vertex u of a link but the smallest of its component, with that smallest vertex v.

    Alternating large and small stars: each vertex sends its larger, then its smaller neighbours to its smallest one, until
    nothing changes. Vertices meet by partial aggregation and joins only; each round is written as a table.
    """
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        with settings(links.sparkSession, CLEANED):
            now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            return links
        state = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        drop(before)
