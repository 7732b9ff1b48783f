"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import held_out, labelled_sample, materialize, read, thinned
from tidemark.llm.words import HEAVY_SLICE_BYTES, Words, ngrams, slices, text_array

#: Features: one bucket for each hashed word, then BINS one-hot bins for each statistic.
WORD_BUCKETS = 1 << 13
BINS = 12
RANK = 6
#: Labelled documents of each class used to fit, about, and the most entries (8 bytes each) of all of them, about.
TRAIN_DOCS, TRAIN_ENTRIES = 2000, 2_000_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.08, 1e-5
THRESHOLD = 0.5
#: Weight of the word part against the statistics: a text's word counts are scaled to this Euclidean length.
WORD_SCALE = 0.5

_CLASSES = np.full(256, 7)
_CLASSES[[*range(ord("a"), ord("z") + 1)]] = 0
_CLASSES[[*range(ord("A"), ord("Z") + 1)]] = 1
_CLASSES[[*range(ord("0"), ord("9") + 1)]] = 2
_CLASSES[[32, 9, 11, 12, 13]] = 3
_CLASSES[10] = 4
_CLASSES[[ord(x) for x in ".,;:'-"]] = 5
_CLASSES[ord("!")] = 6
_CLASSES[128:] = 8
N_CLASSES = 9
N_STATS = 16
N_FEATURES = WORD_BUCKETS + N_STATS * BINS


@dataclass
class Machine:
    """w0, w (features) and v (features x rank) of the factorisation machine; cuts: bin edges of each statistic."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    cuts: np.ndarray


def statistics(texts: pa.Array, words: Words) -> np.ndarray:
    """Structure statistics of each text, a row each; all zero for an empty one."""
    n = len(texts)
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1]
    counts = np.zeros((n, 256))
    for i in range(n):
        counts[i] = np.bincount(flat[offsets[i] : offsets[i + 1]], minlength=256)
    by_class = counts @ np.eye(N_CLASSES)[_CLASSES]
    size, n_words = np.maximum(1, counts.sum(axis=1)), np.diff(words.starts)
    some = np.maximum(1, n_words)
    text_of = words.text_of_word()
    again = np.zeros(n)
    fresh = np.zeros(n)
    if len(words.codes):
        for lag in (1, 2, 3):
            same = (words.codes[lag:] == words.codes[:-lag]) & (text_of[lag:] == text_of[:-lag])
            again += np.bincount(text_of[lag:][same], minlength=n)
        pairs = np.unique(text_of * len(words.distinct) + words.codes)
        fresh = np.bincount(pairs // len(words.distinct), minlength=n)
    letters = np.maximum(1, by_class[:, [0, 1, 8]].sum(axis=1))
    mean_length = np.where(n_words > 0, (size - by_class[:, 3] - by_class[:, 4]) / some, 0)
    columns = [by_class[:, k] / size for k in range(N_CLASSES)]
    columns += [by_class[:, 1] / letters, by_class[:, [6, 7]].sum(axis=1) / some, again / some, fresh / some, mean_length, np.log1p(n_words), np.log1p(size)]
    return np.stack(columns, axis=1)


def word_entries(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) of each hashed word of each text, in order of text."""
    _, bucket = ngrams(words.distinct, (1,), WORD_BUCKETS, whole=True)
    bucket = bucket[len(bucket) - len(words.distinct) :]
    keys, times = np.unique(words.text_of_word() * WORD_BUCKETS + bucket[words.codes], return_counts=True)
    rows = keys // WORD_BUCKETS
    value = np.sqrt(times.astype(np.float64))
    norm = np.sqrt(np.bincount(rows, weights=value**2, minlength=len(texts)))
    return rows.astype(np.int32), (keys % WORD_BUCKETS).astype(np.int32), (value * WORD_SCALE / np.maximum(norm[rows], 1e-9)).astype(np.float32)


def binned(stats: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The feature of each statistic's bin, a row for each text."""
    bins = np.stack([np.searchsorted(cuts[k], stats[:, k], "right") for k in range(N_STATS)], axis=1)
    return (WORD_BUCKETS + np.arange(N_STATS) * BINS + bins).astype(np.int32)


def with_statistics(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, stats: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' entries and one for each statistic's bin."""
    n = len(stats)
    rows = np.concatenate([rows, np.repeat(np.arange(n, dtype=np.int32), N_STATS)])
    cols = np.concatenate([cols, binned(stats, cuts).ravel()])
    return rows, cols, np.concatenate([value, np.full(n * N_STATS, 1 / np.sqrt(N_STATS), np.float32)])


def margin(model: Machine, rows: np.ndarray, cols: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """w0 + sum w x + half of ((sum v x)^2 - sum (v x)^2) over the rank: linear in the number of entries."""
    out = model.w0 + np.bincount(rows, weights=model.w[cols] * value, minlength=n)
    for f in range(model.v.shape[1]):
        vx = model.v[cols, f] * value
        out += 0.5 * (np.bincount(rows, weights=vx, minlength=n) ** 2 - np.bincount(rows, weights=vx**2, minlength=n))
    return out


def score_texts(texts: pa.Array, model: Machine) -> np.ndarray:
    words = Words(texts, lower=False)
    entries = with_statistics(*word_entries(texts, words), statistics(texts, words), model.cuts)
    return 1 / (1 + np.exp(-np.clip(margin(model, *entries, len(texts)), -50, 50)))


def fit(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, stats: np.ndarray, labels: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss with classes weighed alike, Adagrad over shuffled minibatches.

    rows, cols and value are the words' entries of all texts, stats their statistics.
    """
    n = len(labels)
    low = stats[labels == 0] if (labels == 0).any() else stats
    both = np.concatenate([np.quantile(x, np.linspace(0, 1, BINS // 2 + 2)[1:-1], axis=0) for x in (low, stats[labels == 1] if (labels == 1).any() else stats)])
    cuts = np.sort(both, axis=0).T[:, : BINS - 1]
    rows, cols, value = with_statistics(rows, cols, value, stats, cuts)
    order = np.argsort(rows, kind="stable")
    rows, cols, value = rows[order], cols[order], value[order]
    starts = np.searchsorted(rows, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, RANK))
    g0, gw, gv = 1e-6, np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * n
    for _ in range(EPOCHS):
        shuffled = rng.permutation(n)
        for at in range(0, n, BATCH):
            ids = shuffled[at : at + BATCH]
            where = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in ids])
            r, c, x = np.repeat(np.arange(len(ids)), starts[ids + 1] - starts[ids]), cols[where], value[where]
            vx = v[c] * x[:, None]
            s = np.stack([np.bincount(r, weights=vx[:, f], minlength=len(ids)) for f in range(RANK)], axis=1)
            q = np.bincount(r, weights=(vx**2).sum(axis=1), minlength=len(ids))
            z = w0 + np.bincount(r, weights=w[c] * x, minlength=len(ids)) + 0.5 * ((s**2).sum(axis=1) - q)
            e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[ids]) * weight[ids] / len(ids)
            own, back = np.unique(c, return_inverse=True)
            dw = np.bincount(back, weights=e[r] * x) + DECAY * w[own]
            dv = np.stack([np.bincount(back, weights=e[r] * x * (s[r, f] - vx[:, f])) for f in range(RANK)], axis=1) + DECAY * v[own]
            g0 += e.sum() ** 2
            gw[own] += dw**2
            gv[own] += dv**2
            w0 -= RATE * e.sum() / np.sqrt(g0)
            w[own] -= RATE * dw / np.sqrt(gw[own])
            v[own] -= RATE * dv / np.sqrt(gv[own])
    return Machine(float(w0), w, v, cuts)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries and statistics of each text, where the texts are."""
    for batch in batches:
        for part in slices(batch, most=HEAVY_SLICE_BYTES):
            texts = text_array(part)
            words = Words(texts, lower=False)
            rows, cols, value = word_entries(texts, words)
            starts = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * N_STATS), pa.array(statistics(texts, words).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.ListArray.from_arrays(starts, pa.array(cols)), pa.ListArray.from_arrays(starts, pa.array(value)), stats], ["id", "label", "cols", "value", "stats"])


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Learn from doc_id, text of docs and doc_id, quality of labels; a single class or none gives no model.

    About TRAIN_DOCS documents of each class, chosen by a hash of doc_id, are used; texts become features on the executors.
    Only those come to the driver, thinned by the same hash if they have more than TRAIN_ENTRIES entries together. Null texts
    count as empty, null ids and labels are left out, a document of several labels counts once for each.
    """
    few = labelled_sample(docs, labels, "quality", TRAIN_DOCS)
    kind = few.schema["id"].dataType.simpleString()
    known = materialize(few.mapInArrow(_describe, f"id {kind}, label int, cols array<int>, value array<float>, stats array<double>"), "quality-sample")
    got = thinned(known, F.size("cols"), TRAIN_ENTRIES).toArrow().combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
    wanted = got.column("label").to_numpy().astype(np.int64)
    if len(set(wanted.tolist())) < 2:
        return None
    lists = got.column("cols").combine_chunks()
    flat = lambda name: got.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(wanted), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    return fit(rows, flat("cols"), flat("value"), flat("stats").reshape(-1, N_STATS), wanted)


def predict(docs: DataFrame, model: Machine | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, score and predicted for every row of docs; the last two are always these.

    A null text counts as an empty one; repeated rows are scored each; without a model every score is 0.5. Where a column of
    carry has one of their names, underscores are put before both until none has.
    """
    mark = ""
    while {f"{mark}score", f"{mark}predicted"} & set(carry):
        mark += "_"
    where = "text" if "text" in carry else "__text"
    if model is None:
        return docs.select(*carry, F.lit(0.5).alias(f"{mark}score"), F.lit(1).alias(f"{mark}predicted"))
    rows = docs.select(*carry) if where == "text" else docs.select(*carry, F.col("text").alias(where))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*carry, f"{mark}score", f"{mark}predicted"]
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(names[-2], T.DoubleType()), T.StructField(names[-1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, where, HEAVY_SLICE_BYTES):
                score = score_texts(text_array(part, where), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names)

    return rows.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.where(~out), read(spark, sf_dir, "labels").where(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
