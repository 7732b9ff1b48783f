"""Toxicity: subword-bag embeddings, averaged into a linear softmax and trained together with it in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, labelled_sample, materialize, read, thinned
from tidemark.llm.words import HEAVY_SLICE_BYTES, Words, by_owner, ngrams, slices, sums, text_array

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 2
#: Words of a passage; passages begin at every word, and a document is as toxic as its worst passage.
PASSAGE = 2
#: Distinct words whose subwords are worked on at once.
CHUNK = 1 << 15
#: Labelled documents of each class used to fit, about, and the most bytes of all their texts, about.
TRAIN_DOCS, TRAIN_BYTES = 2000, 16 << 20
STEPS, RATE = 25, 0.2
#: Documents that a subword must be in to count, and the count at which its first log odds are halved.
LEAST, SHRINK = 5, 5
THRESHOLD = 0.3


@dataclass
class Bag:
    """e: a vector for each subword bucket; w (DIM x 2) and b: the softmax above the mean of a passage's vectors."""

    e: np.ndarray
    w: np.ndarray
    b: np.ndarray


class Passages:
    """Words, the subwords of each distinct word, and passages of PASSAGE words, none across texts.

    A passage begins at every word that has PASSAGE - 1 more behind it in its text; a text of fewer words is one passage.
    """

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        self.codes = self.words.codes.astype(np.int32)
        parts = [by_owner(*ngrams(words, SIZES, BUCKETS, whole=True), len(words)) for words in (self.words.distinct.slice(at, CHUNK) for at in range(0, len(self.words.distinct), CHUNK))]
        self.ids = np.concatenate([ids.astype(np.int32) for ids, _ in parts]) if parts else np.zeros(0, np.int32)
        self.id_starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, s in parts]))]) if parts else np.zeros(1, np.int64)
        self.n_ids = np.maximum(1, np.diff(self.id_starts))
        n_words = np.diff(self.words.starts)
        per_text = np.where(n_words > 0, np.maximum(1, n_words - PASSAGE + 1), 0)
        self.of_text = np.concatenate([[0], np.cumsum(per_text)])
        self.text = np.repeat(np.arange(len(per_text), dtype=np.int32), per_text)
        self.first = (np.arange(len(self.text)) + np.repeat(self.words.starts[:-1] - self.of_text[:-1], per_text)).astype(np.int32)
        self.length = np.minimum(PASSAGE, n_words)[self.text].astype(np.int8)

    def nth(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(passages that have a word k, its code in each)."""
        has = np.flatnonzero(self.length > k)
        return has, self.codes[self.first[has] + k]

    def vectors(self, e: np.ndarray) -> np.ndarray:
        """Mean subword vector of each distinct word."""
        out = np.zeros((len(self.id_starts) - 1, DIM))
        for at in range(0, len(out), CHUNK):
            own = self.id_starts[at : at + CHUNK + 1]
            out[at : at + CHUNK] = sums(e[self.ids[own[0] : own[-1]]], own - own[0])
        return out / self.n_ids[:, None]

    def spread(self, per_word: np.ndarray) -> np.ndarray:
        """Sum over the words of each subword."""
        out = np.zeros((BUCKETS, per_word.shape[1]))
        for at in range(0, len(per_word), CHUNK):
            own = self.id_starts[at : at + CHUNK + 1]
            ids, times = self.ids[own[0] : own[-1]], np.diff(own)
            for k in range(per_word.shape[1]):
                out[:, k] += np.bincount(ids, weights=np.repeat(per_word[at : at + CHUNK, k], times), minlength=BUCKETS)
        return out

    def keep(self, wanted: np.ndarray) -> None:
        """Forget the subwords that aren't wanted; means are still over all of them."""
        held = wanted[self.ids]
        self.id_starts = np.concatenate([[0], np.cumsum(held)])[self.id_starts]
        self.ids = self.ids[held]

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """Mean of the words' vectors of each passage, added word by word, so equal passages have equal means."""
        out = np.zeros((len(self.first), vectors.shape[1]))
        for k in range(PASSAGE):
            has, codes = self.nth(k)
            out[has] += vectors[codes]
        return out / self.length[:, None]

    def back(self, per_passage: np.ndarray) -> np.ndarray:
        """Sum over the words of each passage, by distinct word."""
        n = len(self.words.distinct)
        out = np.zeros((n, per_passage.shape[1]))
        for k in range(PASSAGE):
            has, codes = self.nth(k)
            for j in range(per_passage.shape[1]):
                out[:, j] += np.bincount(codes, weights=per_passage[has, j], minlength=n)
        return out


def toxic_share(model: Bag, means: np.ndarray) -> np.ndarray:
    """Second class of the softmax."""
    z = means @ model.w + model.b
    return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))


def score_texts(texts: pa.Array, model: Bag) -> np.ndarray:
    """The worst passage's share of each text; an empty text gets the share of an empty bag."""
    got = Passages(texts)
    share = toxic_share(model, got.means(got.vectors(model.e)))
    out = np.full(len(texts), toxic_share(model, np.zeros((1, DIM)))[0])
    full = np.flatnonzero(np.diff(got.of_text) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(share, got.of_text[full])
    return out


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 1) -> Bag:
    """Embeddings and softmax together, by full-batch Adam on the log loss.

    The first coordinate begins as the shrunk log odds of a subword between toxic and clean documents, the others as noise.
    A toxic document counts by its worst passage alone, a clean one by its worst passage and by all, so that clean words
    around an insult stay clean. Subwords of fewer than LEAST documents stay at zero: they can't be told from chance.
    """
    got = Passages(texts)
    rng = np.random.default_rng(seed)
    n_words = len(got.words.distinct)
    pairs = np.unique(got.words.text_of_word() * max(1, n_words) + got.words.codes)
    toxic = labels[pairs // max(1, n_words)] == 1
    counts = [np.bincount(pairs[x] % max(1, n_words), minlength=n_words) for x in (toxic, ~toxic)]
    a, b = got.spread(np.stack(counts, axis=1).astype(np.float64)).T
    del pairs, toxic, counts
    odds = np.log((a + 0.5) / (a.sum() + 1)) - np.log((b + 0.5) / (b.sum() + 1))
    known = a + b >= LEAST
    model = Bag(rng.normal(0, 0.05, (BUCKETS, DIM)), np.tile([-1.0, 1.0], (DIM, 1)) + rng.normal(0, 0.1, (DIM, 2)), np.array([1.0, -1.0]))
    model.e[:, 0] = odds * np.maximum(a, b) / (np.maximum(a, b) + SHRINK)
    model.e[~known] = 0
    got.keep(known)
    n = np.bincount(got.text, minlength=len(labels))
    y = labels[got.text].astype(np.float64)
    half = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    even = (half / np.maximum(1, n))[got.text]
    full = np.flatnonzero(n > 0)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.e, model.w, model.b)]
    for step in range(1, STEPS + 1):
        means = got.means(got.vectors(model.e))
        share = toxic_share(model, means)
        top = np.zeros(len(labels))
        top[full] = np.maximum.reduceat(share, got.of_text[full])
        hit = np.flatnonzero(share == top[got.text])
        first = np.full(len(labels), -1)
        first[got.text[hit][::-1]] = hit[::-1]
        worst = np.zeros(len(share), bool)
        worst[first[first >= 0]] = True
        err = (share - y) * np.where(y == 1, worst * half[got.text], 0.5 * worst * half[got.text] + 0.5 * even)
        dz = np.stack([-err, err], axis=1)
        dvec = got.back(dz @ model.w.T / got.length[:, None])
        de = got.spread(dvec / got.n_ids[:, None])
        for x, g, m, rate in zip((model.e, model.w, model.b), (de, means.T @ dz, dz.sum(axis=0)), moments, (RATE / 5, RATE, RATE), strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g**2
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-5)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Bag | None:
    """Learn from doc_id, text of docs and doc_id, toxic of labels; a single class or none gives no model.

    About TRAIN_DOCS documents of each class, chosen by a hash of doc_id, come to the driver, thinned by the same hash if they
    have more than TRAIN_BYTES together. Null texts count as empty, null ids and labels are left out.
    """
    known = materialize(labelled_sample(docs, labels, "toxic", TRAIN_DOCS), "toxic-sample")
    got = thinned(known, F.coalesce(F.octet_length("text"), F.lit(0)), TRAIN_BYTES).toArrow().combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
    wanted = got.column("label").to_numpy().astype(np.int64)
    if len(set(wanted.tolist())) < 2:
        return None
    return fit(text_array(pa.RecordBatch.from_arrays([got.column("text").combine_chunks()], ["text"])), wanted)


def predict(docs: DataFrame, model: Bag | None) -> DataFrame:
    """doc_id, score, predicted for every row of docs.

    A null text counts as an empty one; repeated rows are scored each; without a model every score is 0. Other columns of
    docs are not read.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=HEAVY_SLICE_BYTES):
                score = score_texts(text_array(part), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out), read(spark, sf_dir, "labels").where(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
