"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, held_out, read, stratum_counts
from tidemark.llm.words import Words, ngrams, slices, sums, text_array

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Training documents of one language, about; the share of a language that is in follows from its count.
TRAIN_DOCS = 3000
SMOOTHING = 0.5


@dataclass
class LangModel:
    """log_prob: a row for each bucket, a column for each of langs; log_prior by language."""

    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket and language, summed over the task."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in rows:
        for part in slices(batch):
            words = Words(text_array(part))
            owners, ids = ngrams(words.distinct, SIZES, BUCKETS)
            langs = part.column("lang").to_pylist()
            text_of = words.text_of_word()
            for lang in set(langs):
                of = np.array([x == lang for x in langs])
                times = np.bincount(words.codes[of[text_of]], minlength=len(words.distinct)).astype(np.float64)
                total[lang] = total.get(lang, 0) + np.bincount(ids, weights=times[owners], minlength=BUCKETS)
                docs[lang] = docs.get(lang, 0) + int(of.sum())
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], docs[lang]), pa.float64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame) -> LangModel | None:
    """Learn from text and lang; null languages are left out, none at all gives no model.

    N-grams are counted in about TRAIN_DOCS documents of each language, chosen by a hash of doc_id; priors are the shares of
    the languages among all labelled documents. Counts are added up in Spark; what comes to the driver is at most one number
    for each bucket and language.
    """
    known = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    of_lang = stratum_counts(known, "lang")
    sample = bounded_sample(known, "lang", TRAIN_DOCS, counts=of_lang)
    counts = sample.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if not len(counts):
        return None
    langs = sorted(counts["lang"].unique())
    table, docs = np.zeros((BUCKETS, len(langs))), np.array([of_lang[lang] for lang in langs], float)
    for j, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        at, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        table[at[at >= 0], j] = n[at >= 0]
    table += SMOOTHING
    return LangModel(langs, np.log(table / table.sum(axis=0)), np.log(docs / docs.sum()))


def score_texts(texts: pa.Array, model: LangModel) -> tuple[np.ndarray, np.ndarray]:
    """(language number, posterior of it) of each text."""
    words = Words(texts)
    owners, ids = ngrams(words.distinct, SIZES, BUCKETS)
    n, k = len(words.distinct), len(model.langs)
    of_word = np.stack([np.bincount(owners, weights=model.log_prob[ids, j], minlength=n) for j in range(k)], axis=1) if n else np.zeros((0, k))
    total = sums(of_word[words.codes], words.starts) + model.log_prior
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    best = total.argmax(axis=1)
    return best, 1.0 / odds.sum(axis=1)


def predict(docs: DataFrame, model: LangModel | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs.

    A null text and one without any letter get ``und`` and 0; so does every text if nothing could be learned. Other columns
    of docs are ignored; repeated rows are scored each.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            for part in slices(batch):
                best, score = score_texts(text_array(part), model)
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[np.where(letters, best, -1)], pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    found = predict(docs, train(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
