"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import mixing as mixer
from tidemark.llm import quality as judge
from tidemark.llm import records
from tidemark.llm.common import SPACE_WORDS, materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it is fitted on about 2,000 labelled ones of each class among docs.

    Each row is judged by its text, null as empty; null and repeated ids, and columns named like the verdict's, stay as they are.
    """
    model = judge.train(docs, read(spark, sf_dir, "labels"))
    judged = judge.predict(docs, model, tuple(docs.columns))
    return judged.where(F.col(judged.columns[-1]) == 1).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole, rounded; a text without words stays out.

    A row is known by doc_id, source and text, null or not. Rows that agree in all three share their copies as evenly as can be.
    """
    row = lambda key: F.struct("doc_id", "source", key)
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)
    taken = mixer.mix(docs).where("size > 0").groupBy(row("__key").alias("__row")).agg(F.sum(copies).alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    met = docs.withColumn("__row", row(F.xxhash64("text"))).join(taken, "__row")
    nth = met.withColumn("__nth", F.row_number().over(Window.partitionBy("__row").orderBy(F.xxhash64(*docs.columns))))
    share = F.expr("int((__nth * __copies) div __rows - ((__nth - 1) * __copies) div __rows)")
    return nth.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), share))).select(docs.columns)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left, in files; a row for each record read back."""
    return records.token_records(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Rows of one id are one document. Rows without words and rows with a null id are kept, whatever else has their id.
    """
    from tidemark.llm.minhash import near_duplicates

    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    worded = F.coalesce(F.col("text").rlike(SPACE_WORDS), F.lit(False))
    return docs.join(gone, (F.col("doc_id") == F.col("__id")) & worded, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a window of a benchmark item; a row is known by doc_id, null or not, and text."""
    from tidemark.llm.decontamination import phrase_matches, windows_of

    hit = materialize(phrase_matches(docs, windows_of(read(spark, sf_dir, "benchmark"))).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__hit")), "hits")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hit")), "left_anti")
