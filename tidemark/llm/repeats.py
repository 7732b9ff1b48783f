"""What both removers of repeated passages share: where to look, and how the answer gets back to the texts.

A text is a run of units, bytes or words. Every window of LENGTH units has one anchor, the gram in it with the smallest hash
(the leftmost of equals): that depends on the window's content alone, so equal windows have equal anchors at equal places.
Consecutive windows with the same anchor are a *stretch*. A window can only repeat if its anchor's gram is in another
document. So grams are counted first, in packed form; only stretches with a shared gram are sent on, with their units, and
cut into pieces for the operators to search. Nothing is left to chance here but equality of 64-bit hashes of grams, which only
ever adds candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, release, sweep
from tidemark.llm.words import run_starts, slices

LENGTH = 50
#: Bytes of packed grams that one part holds, about.
GRAM_PART = 12 << 20
#: Windows whose anchors are found at once, so that a core's cache holds their numbers.
CHUNK = 1 << 15
_ZSTD = pa.Codec("zstd", compression_level=1)
#: Keys of copies (8 bytes each) up to which their list is broadcast; beyond it is shuffled.
BROADCAST_KEYS = 1_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Units:
    """gram: units of an anchor; mean: bytes of text of a unit, about; split: texts to (units, starts, what render needs);
    render: (that, units, first unit of each piece, its length) to the pieces' contents."""

    gram: int
    mean: int
    split: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, object]]
    render: Callable[[object, np.ndarray, np.ndarray, np.ndarray], pa.Array]


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` units from each place on, by doubling."""
    mix = lambda a, b, m: (lambda x: (x ^ (x >> np.uint64(29))) * _M1)(a * m + b)
    with np.errstate(over="ignore"):
        h = (units.astype(np.uint64) + np.uint64(1)) * _M1
        h ^= h >> np.uint64(31)
        size = 1
        while size * 2 <= gram:
            h, size = mix(h[: len(h) - size], h[size:], _M2), size * 2
        if size < gram:
            h = mix(h[: len(h) - (gram - size)], h[gram - size :], _M2)
        return h ^ (h >> np.uint64(32))


@dataclass
class Stretches:
    """Of some texts: document number, first window (in all units), number of windows, hash of the anchor; in order."""

    doc: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    h: np.ndarray

    def ordinals(self) -> np.ndarray:
        """Number of each stretch within its document."""
        new = run_starts(self.doc)
        return np.arange(len(self.doc)) - np.repeat(new, np.diff(np.append(new, len(self.doc))))


def stretches(units: np.ndarray, starts: np.ndarray, gram: int) -> Stretches:
    none = np.zeros(0, np.int64)
    n = len(units) - LENGTH + 1
    if n <= 0:
        return Stretches(none, none, none, none.astype(np.uint64))
    anchor, grams = np.empty(n, np.uint32), np.empty(n + LENGTH - gram, np.uint64)  # 32 bits are enough for places in a slice
    for at in range(0, n, CHUNK):
        h = gram_hashes(units[at : at + CHUNK + LENGTH - 1], gram)
        grams[at : at + len(h)] = h
        m = (h & ~_LOW) | np.arange(at, at + len(h), dtype=np.uint64)
        span, size = LENGTH - gram + 1, 1
        while size * 2 <= span:
            m, size = np.minimum(m[: len(m) - size], m[size:]), size * 2
        if size < span:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        anchor[at : at + len(m)] = m & _LOW
    counts = np.maximum(0, np.diff(starts) - LENGTH + 1)
    if not counts.sum():
        return Stretches(none, none, none, none.astype(np.uint64))
    d = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
    at = np.arange(len(d), dtype=np.uint32) + np.repeat((starts[:-1] - (np.cumsum(counts) - counts)).astype(np.uint32), counts)
    a = anchor[at]
    del anchor
    new = run_starts(a, d)
    return Stretches(d[new].astype(np.int64), at[new].astype(np.int64), np.diff(np.append(new, len(at))), grams[a[new]])


def _shared_here(s: Stretches, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches whose gram is in two documents of this slice, stretches to send): of a gram known to be shared one is sent."""
    order = np.lexsort((s.doc, s.h))
    h, doc = s.h[order], keys[s.doc[order]]
    new = run_starts(h)
    count = np.diff(np.append(new, len(h)))
    shared = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
    every = np.repeat(shared, count)
    first = np.zeros(len(h), bool)
    first[new] = True
    return order[every], order[~every | first]


def _pack_grams(h: np.ndarray, doc: np.ndarray, ordinal: np.ndarray, keys: np.ndarray) -> bytes:
    """Documents' keys and counts, then 5 bytes of hash and 4 of ordinal for each gram; in order of document."""
    own, counts = np.unique(doc, return_counts=True)
    body = np.empty((len(h), 5), np.uint8)
    body[:] = np.ascontiguousarray(h >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
    return b"".join((np.array([len(own), len(h)], "<i8").tobytes(), keys[own].astype("<i8").tobytes(), counts.astype("<i8").tobytes(), body.tobytes(), ordinal.astype("<u4").tobytes()))


def _unpack_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, n = np.frombuffer(blob, "<i8", 2)
    keys, counts = np.frombuffer(blob, "<i8", d, 16), np.frombuffer(blob, "<i8", d, 16 + 8 * d)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 16 + 16 * d).reshape(n, 5)
    return wide.view(np.uint64).ravel(), np.repeat(keys, counts), np.frombuffer(blob, "<u4", n, 16 + 16 * d + 5 * n)


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(distinct keys, list of each one's values)."""
    order = np.argsort(keys, kind="stable")
    own, counts = np.unique(keys[order], return_counts=True)
    return own, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values[order]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[pa.RecordBatch]]]:
    """Rows sorted by part as (blobs of a part, batches of rows that already are answers)."""
    part, held = None, []
    for batch in batches:
        blobs, parts = batch.column("blob"), batch.column("part").to_pylist()
        done = batch.filter(blobs.is_null())
        if done.num_rows:
            yield [], [done]
        for k, p in enumerate(parts):
            if blobs[k].is_valid:
                if p != part and held:
                    yield held, []
                    held = []
                part = p
                held.append(blobs[k].as_buffer().to_pybytes())
    if held:
        yield held, []


def _send_grams(units: Units, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                keys = piece.column("key").to_numpy(zero_copy_only=False)
                s = stretches(*units.split(piece.column("text"))[:2], units.gram)
                ordinal = s.ordinals()
                known, send = _shared_here(s, keys)
                if len(known):
                    own = keys[s.doc[known]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.abs(own % n_parts)), pa.nulls(len(own), pa.binary()), pa.array(own), pa.array(ordinal[known], pa.int32())], ["part", "blob", "key", "ordinal"])
                send = np.sort(send)
                part = (s.h[send] % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for ids in np.split(send[order], run_starts(part[order])[1:]) if len(order) else []:
                    blob = _pack_grams(s.h[ids], s.doc[ids], ordinal[ids], keys)
                    yield pa.RecordBatch.from_arrays([pa.array([int(s.h[ids[0]] % np.uint64(n_parts))]), pa.array([blob], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], ["part", "blob", "key", "ordinal"])

    return run


def _match_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blobs, done in _parts(batches):
        for batch in done:
            yield batch.select(["key", "ordinal"])
        if not blobs:
            continue
        h, keys, ordinals = (np.concatenate(x) for x in zip(*map(_unpack_grams, blobs), strict=True))
        order = np.argsort(h, kind="stable")
        h, keys, ordinals = h[order], keys[order], ordinals[order]
        new = run_starts(h)
        shared = np.repeat(np.minimum.reduceat(keys, new) != np.maximum.reduceat(keys, new), np.diff(np.append(new, len(h))))
        at = np.flatnonzero(shared)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at[k : k + (1 << 16)]]), pa.array(ordinals[at[k : k + (1 << 16)]], pa.int32())], ["key", "ordinal"])


def _pieces(units: Units, cut: int, most: int):
    """The shared stretches of each text, next ones joined, cut before a stretch whose gram's hash says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id"))
                seq, starts, held = units.split(part.column("text"))
                s = stretches(seq, starts, units.gram)
                wanted = part.column("ordinals")
                docs = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
                at = np.unique(np.searchsorted(s.doc, np.arange(part.num_rows))[docs] + wanted.flatten().to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                doc, first, h = s.doc[at], s.first[at], s.h[at]
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (doc[1:] != doc[:-1]) | ((h[1:] % np.uint64(cut) == 0) & (h[1:] != h[:-1]))
                new = np.flatnonzero(new)
                begin, ends = first[new], np.append(new[1:], len(at)) - 1
                count = first[ends] + s.windows[at][ends] - begin
                # a piece of a text of few different units may be cut nowhere: it is cut by length
                more = -(-count // most)
                own = np.repeat(np.arange(len(new)), more)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(more) - more, more)
                begin, n = begin[own] + nth * most, np.minimum(count[own] - nth * most, most) + LENGTH - 1
                doc = doc[new][own]
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(keys[doc]), pa.array(begin - starts[doc]), pa.array(n), units.render(held, seq, begin, n)], ["doc_id", "key", "place", "n", "piece"])

    return run


def pack(*columns: np.ndarray) -> bytes:
    """64-bit columns of one length, byte plane by byte plane, compressed."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    return np.array([n, len(columns)], "<u8").tobytes() + _ZSTD.compress(planes, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    planes = np.frombuffer(_ZSTD.decompress(blob[16:], n * k * 8), np.uint8).reshape(k, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def candidates(docs: DataFrame, units: Units) -> tuple[DataFrame, DataFrame]:
    """(copies: doc_id, key; looked: doc_id, key, text, ordinals of the stretches whose gram is in another text too).

    docs has doc_id, text and key, which tells rows of a doc_id apart. Of equal texts those whose id isn't the smallest lose
    all, they are the copies; only the others are searched. Rows with a null doc_id or text take no part.
    """
    rows = materialize(docs.select("doc_id", "key", F.md5("text").alias("h"), F.octet_length("text").cast("long").alias("n")).where("doc_id IS NOT NULL AND n IS NOT NULL"), "rows")
    classes = rows.groupBy("h", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # without an aggregate on top of the join Spark may split a text of very many copies
    copies = materialize(rows.join(classes, ["h", "n"]).where("doc_id > least").select("doc_id", "key"), "copies").distinct()
    skipped = materialize(copies.select("key").distinct(), "skipped")
    total = rows.agg(F.sum("n")).first()[0] or 0
    part = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "key", "text")
    part = part.join(F.broadcast(skipped) if skipped.count() <= BROADCAST_KEYS else skipped, "key", "left_anti")
    # packed grams: 9 bytes for each of about two in (LENGTH - gram + 2) units
    n_grams = max(1, -(-int(total / units.mean * 2 / (LENGTH - units.gram + 2) * 9) // GRAM_PART))
    sent = part.select("key", "text").mapInArrow(_send_grams(units, n_grams), "part long, blob binary, key long, ordinal int")
    met = sent.repartition(n_grams, "part").sortWithinPartitions("part").mapInArrow(_match_grams, "key long, ordinal int")
    shared = materialize(met.groupBy("key").agg(F.array_distinct(F.collect_list("ordinal")).alias("ordinals")), "shared")
    return copies, part.join(shared.hint("merge"), "key")  # of one plan at any size: few ordinals would be broadcast


def with_copies(lost: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, key, spans (start << 32 | end, in units, not merged), whole, from rows of (doc_id, key, spans) and the copies."""
    some = lost.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.lit(False).alias("whole"))
    return some.unionByName(copies.select("doc_id", "key", F.array().cast("array<long>").alias("spans"), F.lit(True).alias("whole")))


def repeated_spans(docs: DataFrame, units: Units, search: Callable[[DataFrame], DataFrame], cut: int, most: int) -> DataFrame:
    """What each row of docs (doc_id, key, text) loses, see ``with_copies``.

    The candidates are cut into pieces at places that their content tells, one stretch in ``cut`` beginning one, of ``most``
    windows at most. Equal pieces are folded into one, kept by the smallest id, as all their suffixes are equal: with a larger
    id a piece is lost whole. ``search`` gets the distinct pieces (sid, piece, least) and gives (sid, spans): windows of a
    piece that pieces of smaller ids hold too; its first owner loses those.
    """
    copies, looked = candidates(docs, units)
    cut_up = looked.select("doc_id", "key", "text", "ordinals").mapInArrow(_pieces(units, cut, most), "doc_id long, key long, place long, n long, piece binary")
    # pieces are folded by their content; owners find the number of theirs by its hash, so contents aren't dealt for that
    owned = materialize(cut_up.withColumn("h", F.unhex(F.md5("piece"))), "pieces")
    sweep(owned)
    distinct = materialize(owned.groupBy("h", "n", "piece").agg(F.min("doc_id").alias("least")).withColumn("sid", F.monotonically_increasing_id()), "distinct")
    placed = owned.drop("piece").join(distinct.drop("piece"), ["h", "n"]).select("doc_id", "key", "place", "sid", "n", (F.col("doc_id") > F.col("least")).alias("gone"))
    placed = materialize(placed, "placed")
    release(owned)
    found = materialize(search(distinct.select("sid", "piece", "least")), "spans")
    release(distinct)
    shift = lambda x: x + F.shiftleft(F.col("place"), 32) + F.col("place")
    whole = placed.where("gone").select("doc_id", "key", F.array(shift(F.col("n"))).alias("spans"))
    some = placed.where("NOT gone").join(found, "sid").select("doc_id", "key", F.transform("spans", shift).alias("spans"))
    return with_copies(whole.unionByName(some), copies)


def with_spans(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs (doc_id and text, no more) with spans and whole, as ``find`` gives them: null where nothing is lost."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    lost = materialize(find(keyed), "lost")
    return keyed.join(lost.hint("merge"), ["doc_id", "key"], "left").select("doc_id", "text", "spans", "whole")


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs from packed spans."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans or ()):
        a, b = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
