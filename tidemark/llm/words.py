"""Words of Arrow text batches as codes, and hashed character n-grams of the distinct words, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel works on at once, and one that keeps a few dozen bytes for each byte; one longer text goes alone.
SLICE_BYTES, HEAVY_SLICE_BYTES = 8 << 20, 2 << 20


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``most`` bytes of text, or one row."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(column), "")


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of rows with equal keys begins; none of no rows."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        change = change | (k[1:] != k[:-1])
    return np.flatnonzero(np.concatenate([[True], change]))


class Words:
    """Words of a run of texts: ``codes`` into ``distinct``, and ``starts`` (n + 1) of each text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts) if lower else texts)
        flat = pc.list_flatten(lists)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = pc.not_equal(flat, "")
        kept = keep.to_numpy(zero_copy_only=False)
        if not kept.all():  # white space at either end leaves empty strings
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(owner[kept], minlength=len(counts)).astype(np.int64)
            flat = flat.filter(keep)
        coded = flat.dictionary_encode()
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def ngrams(words: pa.Array, sizes: tuple[int, ...], buckets: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each hashed byte n-gram of ``<word>``; ``whole`` adds one bucket for the word itself."""
    ended = pc.binary_join_element_wise("<", words, ">", "")
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    n = len(ended)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = pc.binary_length(ended).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(ended.buffers()[2], np.uint8)
    first = np.frombuffer(ended.buffers()[1], np.int64 if pa.types.is_large_string(ended.type) else np.int32)[ended.offset]
    data = data[first : first + lengths.sum()].astype(np.uint64)
    owner = np.repeat(np.arange(n), lengths)
    mult = np.uint64(0x9E3779B97F4A7C15)
    ids, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(data), np.uint64)
        for k in range(1, max(sizes) + 1):
            m = len(data) - k + 1
            if m <= 0:
                break
            h = (h[:m] + data[k - 1 : k - 1 + m] + np.uint64(1)) * mult
            h ^= h >> np.uint64(29)
            if k in sizes:
                inside = owner[:m] == owner[k - 1 : k - 1 + m]
                ids.append(((h[inside] * mult) >> np.uint64(33)).astype(np.int64) % buckets)
                owners.append(owner[:m][inside])
        if whole:
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.arange(len(data), dtype=np.uint64) - starts.astype(np.uint64)[owner]
            mixed = (data + np.uint64(7)) * mult ^ (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * mult
            ids.append(((np.add.reduceat(mixed, starts) * mult) >> np.uint64(33)).astype(np.int64) % buckets)
            owners.append(np.arange(n))
    return (np.concatenate(owners), np.concatenate(ids)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def by_owner(owners: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs as (ids in order of owner, starts of each owner, n + 1)."""
    order = np.argsort(owners, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))])


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; 0 for an empty run. Each run is added by itself, so equal runs give equal sums."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ended = pc.binary_join_element_wise(words, "\n", "")  # none is empty
    ended = ended.combine_chunks() if isinstance(ended, pa.ChunkedArray) else ended
    lengths = pc.binary_length(ended).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.frombuffer(ended.buffers()[1], np.int64 if pa.types.is_large_string(ended.type) else np.int32)[ended.offset]
    data = np.frombuffer(ended.buffers()[2], np.uint8)[first : first + lengths.sum()].astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (data + np.uint64(257) * place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        total = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB)
    return total ^ (total >> np.uint64(33))
