"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back; lineage ends there and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again, and let Spark drop shuffle files that nothing refers to."""
    for table in tables:
        drop_path(table.sparkSession, table.scratch)
    if tables:
        sweep(tables[0])


def sweep(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished work, to which nothing refers once its result is on disk."""
    df.sparkSession.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, wherever the shared folder lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True where the id's crc32 leaves that rest; a null id is never held out."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(mod)) == rest, F.lit(False))


def stratum_counts(rows: DataFrame, stratum: str) -> dict:
    """Rows of each stratum."""
    return {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}


def bounded_sample(rows: DataFrame, stratum: str, bound: int, key: str = "doc_id", counts: dict | None = None) -> DataFrame:
    """Rows of each stratum whose hashed key falls below bound / (rows of the stratum): about ``bound`` rows of each.

    A count per stratum decides the share, a row's own hash decides whether it is in; nothing is sorted or shuffled.
    Strata must be few (classes, languages): their counts come to the driver, unless they are given.
    """
    counts = stratum_counts(rows, stratum) if counts is None else counts
    share = F.lit(0.0)
    for value, n in counts.items():
        if value is not None:
            share = F.when(F.col(stratum) == value, F.lit(min(1.0, bound / n))).otherwise(share)
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(spot < share)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """id, text and label of about ``bound`` labelled documents of each class, 0 and 1.

    The labels are thinned first, and again if there are still more than four times ``bound`` of them, as after many labels
    of one id: what is left is bounded, so it is broadcast and only the texts of the sample are shuffled. Other values, null
    labels and null ids are left out; a document with several labels counts once for each; of several texts of one id the
    smallest counts.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label")).where(F.col(column).isin(0, 1) & F.col("id").isNotNull()).distinct()
    few = thinned(materialize(bounded_sample(known, "label", bound, "id"), "labels"), F.lit(1), 4 * bound)
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def thinned(rows: DataFrame, weight: Column, bound: int) -> DataFrame:
    """rows, a table on disk, with those left out, by a hash of id, that make the sum of their weights more than ``bound``, about."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    spot = F.pmod(F.xxhash64(F.col("id"), F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    return rows if total <= bound else rows.where(spot < bound / total)
