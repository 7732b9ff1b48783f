"""Substring dedup of words by prefix-partitioned suffix trees.

Only stretches that can repeat take part (see ``repeats``), as distinct pieces. Each word of a piece that begins a window begins
a suffix. Suffixes are split by prefixes of variable length: one word, and for the prefixes that more than GROUP suffixes have
2, 4, 8 words and so on, until a group fits a task's memory. The groups of a part are built into one subtree: suffixes in order,
and the edges that neighbours have in common. Its internal nodes LENGTH words deep are the repeats; a window is lost if a
smaller id is below its node. An edge is EDGE words, labelled by a 64-bit hash of all of them: two windows would have to differ
in one edge alone, and that collide, to be taken for equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read
from tidemark.llm.repeats import LENGTH, Units, gram_hashes, merged, pack, repeated_spans, unpack, with_spans
from tidemark.llm.words import Words, run_starts, slices, text_array, word_hashes

GRAM = 10
#: One stretch in so many begins a piece; the most windows of a piece.
CUT, PIECE_WINDOWS = 16, 1 << 13
#: Bytes of pieces of a block; suffixes of a group that is not split further, and of a part.
BLOCK_BYTES, GROUP, PART = 1 << 20, 1 << 15, 1 << 17
#: Groups of pieces at most, to which the parts' answers go, packed; each holds that share of all spans that are lost.
HOMES = 256
#: Words of an edge.
EDGE = 10
#: Words of the prefixes, one after the other.
DEPTHS = (1, 2, 4, 8, 16, 32, LENGTH)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """A 64-bit hash of each word of all texts, and starts of each text; null has none."""
    words = Words(text_array(pa.RecordBatch.from_arrays([texts], ["text"])), lower=False)
    return word_hashes(words.distinct)[words.codes], words.starts, words


def words_of(words: Words, _: np.ndarray, begin: np.ndarray, n: np.ndarray) -> pa.Array:
    """The pieces' words, joined by single spaces."""
    distinct = words.distinct.cast(pa.binary()).to_pylist()
    return pa.array([b" ".join([distinct[c] for c in words.codes[a : a + k].tolist()]) for a, k in zip(begin.tolist(), n.tolist(), strict=True)], pa.binary())


WORDS = Units(GRAM, 6, split_words, words_of)


def _blocks(most: int):
    """Pieces put together: the words' hashes, and of each piece its end, number and smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "piece", most):
                seq, starts, _ = split_words(part.column("piece").cast(pa.string()))
                ids = [part.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("sid", "least")]
                yield pa.RecordBatch.from_arrays([pa.array([pack(seq)], pa.binary()), pa.array([pack(starts[1:].astype(np.uint64), *ids)], pa.binary()), pa.array([int((np.diff(starts) - LENGTH + 1).sum())])], ["words", "pieces", "suffixes"])

    return run


class Suffixes:
    """The suffixes of a block: where each begins, of which piece it is, and the words of all."""

    def __init__(self, words: bytes, pieces: bytes):
        self.words = unpack(words)[0]
        ends, self.sid, self.least = unpack(pieces)
        ends = ends.astype(np.int64)
        counts = np.diff(ends, prepend=0) - LENGTH + 1
        self.piece = np.repeat(np.arange(len(ends)), counts)
        self.nth = np.arange(len(self.piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = self.nth + np.repeat(ends - np.diff(ends, prepend=0), counts)

    def prefix(self, depth: int) -> np.ndarray:
        """A hash of the first ``depth`` words of each suffix."""
        return gram_hashes(self.words, depth)[self.at] ^ np.uint64(depth)

    def groups(self, crowded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(group of each suffix: its shortest prefix that isn't crowded, whether one of the depths known so far is that)."""
        group, open_ = self.prefix(DEPTHS[0]), np.ones(len(self.at), bool)
        for depth, many in zip(DEPTHS[1:], crowded, strict=False):
            open_[open_] = np.isin(group[open_], many)
            if not open_.any():
                break
            group[open_] = self.prefix(depth)[open_]
        return group, open_


def _prefix_counts(crowded: list[np.ndarray]):
    """How many suffixes have each prefix of the next depth, of those whose prefixes before are all crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, pieces in zip(batch.column("words").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                group, open_ = Suffixes(words, pieces).groups(crowded)
                own, n = np.unique(group[open_], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["prefix", "n"])

    return run


def _send(crowded: list[np.ndarray], n_parts: int):
    """The suffixes to the parts of their groups, as the labels of their edges down to LENGTH words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, pieces in zip(batch.column("words").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                s = Suffixes(words, pieces)
                part = (s.groups(crowded)[0] % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                label = gram_hashes(s.words, EDGE)
                for own in np.split(order, run_starts(part[order])[1:]) if len(order) else []:
                    edges = [label[s.at[own] + k] for k in range(0, LENGTH, EDGE)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[own[0]])]), pa.array([pack(*edges)], pa.binary()), pa.array([pack(s.sid[s.piece[own]], s.least[s.piece[own]], s.nth[own].astype(np.uint64))], pa.binary())], ["part", "edges", "suffixes"])

    return run


def subtree(edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, edges that each has in common with the one before, 0 for the first), from one column for each
    edge."""
    order = np.lexsort(edges[::-1])
    common, alike = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for label in edges:
        alike &= label[order[1:]] == label[order[:-1]]
        common[1:] += alike
    return order, common


def repeated_windows(edges: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Which suffixes have a smaller id below their node of depth LENGTH, all edges down."""
    order, common = subtree(edges)
    node = np.flatnonzero(common < len(edges))  # a node's first suffix parts from the one before above that depth
    smallest = np.minimum.reduceat(least[order], node)
    out = np.empty(len(order), bool)
    out[order] = least[order] > np.repeat(smallest, np.diff(np.append(node, len(order))))
    return out


def _by_key(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple[bytes, ...]]]]:
    """Rows sorted by a key as (key, all its rows' blobs)."""
    at, held = None, []
    for batch in batches:
        for k, *blobs in zip(*(batch.column(c).to_pylist() for c in (key, *columns)), strict=True):
            if k != at and held:
                yield at, held
                held = []
            at = k
            held.append(tuple(blobs))
    if held:
        yield at, held


def _trees(n_homes: int):
    """The windows that are lost, touching ones of a part as one span: of each part a row for each home of pieces, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_key(batches, "part", ("edges", "suffixes")):
            edges, suffixes = ([np.concatenate(x) for x in zip(*map(unpack, column), strict=True)] for column in zip(*held, strict=True))
            sid, least, nth = (x.view(np.int64) for x in suffixes)
            hit = np.flatnonzero(repeated_windows(edges, least))
            if not len(hit):
                continue
            hit = hit[np.lexsort((nth[hit], sid[hit], sid[hit] % n_homes))]
            sid, nth = sid[hit], nth[hit]
            first = np.ones(len(hit), bool)
            first[1:] = (np.diff(nth) > LENGTH) | (np.diff(sid) != 0)
            i = np.flatnonzero(first)
            sid, spans = sid[i], (nth[i] << 32) | (nth[np.append(i[1:], len(hit)) - 1] + LENGTH)
            new = run_starts(sid % n_homes)
            blobs = [pack(sid[a:b].view(np.uint64), spans[a:b].view(np.uint64)) for a, b in zip(new, np.append(new[1:], len(sid)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sid[new] % n_homes), pa.array(blobs, pa.binary())], ["home", "lost"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, spans: what all parts say of a home's pieces, touching spans of a piece as one."""
    for _, held in _by_key(batches, "home", ("lost",)):
        sid, spans = (np.concatenate(x).view(np.int64) for x in zip(*(unpack(blob) for (blob,) in held), strict=True))
        order = np.lexsort((spans, sid))
        sid, spans = sid[order], spans[order]
        begin, end = spans >> 32, spans & 0xFFFFFFFF
        piece = run_starts(sid)
        owner = np.repeat(np.arange(len(piece)), np.diff(np.append(piece, len(sid))))
        reach = np.maximum.accumulate(end + (owner << 32)) & 0xFFFFFFFF
        first = np.ones(len(sid), bool)
        first[1:] = (begin[1:] > reach[:-1]) | (np.diff(sid) != 0)
        i = np.flatnonzero(first)
        whole = (begin[i] << 32) | reach[np.append(i[1:], len(sid)) - 1]
        new = run_starts(sid[i])
        yield pa.RecordBatch.from_arrays([pa.array(sid[i][new]), pa.ListArray.from_arrays(pa.array(np.append(new, len(i)).astype(np.int32)), pa.array(whole))], ["sid", "spans"])


def smaller_windows(pieces: DataFrame) -> DataFrame:
    """sid, spans of the distinct pieces (sid, piece, least) that have a window which a piece of a smaller ``least`` has too.

    The crowded prefixes of a depth come to the driver: there are at most (suffixes / GROUP) of them.
    """
    blocks = materialize(pieces.mapInArrow(_blocks(BLOCK_BYTES), "words binary, pieces binary, suffixes long"), "blocks")
    n = blocks.agg(F.sum("suffixes")).first()[0] or 0
    crowded: list[np.ndarray] = []
    while len(crowded) < len(DEPTHS) - 1:
        counts = blocks.select("words", "pieces").mapInArrow(_prefix_counts(crowded), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP)
        many = np.sort(counts.select("prefix").toArrow().column("prefix").to_numpy().view(np.uint64))
        if not len(many):
            break
        crowded.append(many)
    n_parts = max(1, -(-n // PART))
    sent = blocks.select("words", "pieces").mapInArrow(_send(crowded, n_parts), "part long, edges binary, suffixes binary")
    n_homes = min(n_parts, HOMES)
    lost = sent.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_trees(n_homes), "home long, lost binary")
    return lost.repartition(n_homes, "home").sortWithinPartitions("home").mapInArrow(_gathered, "sid long, spans array<long>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans, whole in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            runs = ([(0, len(words))] if len(words) >= LENGTH else []) if whole else merged(spans)
            kept, at = [], 0
            for a, b in runs:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    A word goes if LENGTH consecutive words that hold it also start in a row with a smaller doc_id. Null and empty texts have
    no words; texts of fewer words lose none; rows that share a doc_id don't touch each other; rows with a null doc_id lose
    nothing and take nothing. doc_id must be an integer or text that spells one. Other columns are not read.
    """
    rows = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), lambda keyed: repeated_spans(keyed, WORDS, smaller_windows, CUT, PIECE_WINDOWS))
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(read(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT s.doc_id, unnest(range(i, i + {LENGTH})) AS p FROM s JOIN f ON s.h = f.h WHERE least < s.doc_id)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM u ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
