"""Media columns: sound held as WAV bytes, and its features as fixed-shape tensors with time spans."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, read, scratch_path
from tidemark.llm.words import slices

UNIT = 192
RATE_IN, RATE_OUT = 16_000, 8_000
FRAME, HOP, MELS = 256, 128, 16
#: Frames of one tensor: MELS x TENSOR_FRAMES, float32.
TENSOR_FRAMES = 64
#: A sound segment begins where a frame's energy is above HIGH dB of the loudest and ends where it falls below LOW.
HIGH_DB, LOW_DB = -3.0, -9.0
#: Frames worked on at once; memory follows this, not the length of the sound.
BLOCK_FRAMES = 128
#: Bytes of media of one group of rows in a stored file, about.
GROUP_BYTES = 8 << 20


def wav_encode(payload: bytes, rate: int = RATE_IN) -> bytes:
    """8-bit mono PCM in a RIFF container; the samples are the payload's bytes."""
    pad = b"\0" if len(payload) % 2 else b""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_decode(stored: bytes) -> tuple[int, bytes]:
    """(rate, sample bytes), by walking the chunks; anything but 8-bit mono PCM is refused."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE stream")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@cache
def _taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc low pass, a row for each of the ``up`` phases; every phase passes a constant unchanged."""
    n = 2 * half * max(up, down) + 1
    t = (np.arange(n) - n // 2) / max(up, down)
    h = np.sinc(t) * np.hamming(n)
    h = np.pad(h, (0, -n % up)).reshape(-1, up).T
    return h / h.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, up: int, down: int, start: int = 0, end: int | None = None, shift: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """Outputs [start, end) of the polyphase filter: output k is the phase (k * down) % up at input (k * down) // up.

    Edges repeat. Only the inputs that these outputs need are looked at, as (x - shift) * scale.
    """
    taps = _taps(up, down)
    width = taps.shape[1]
    k = np.arange(start, -(-len(x) * up // down) if end is None else end)
    if not len(k):
        return np.zeros(0, np.float32)
    place = k * down // up
    lo, hi = place[0] - width // 2, place[-1] + width - width // 2
    held = (x[max(0, lo) : min(len(x), hi)].astype(np.float32) - np.float32(shift)) * np.float32(scale)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(held, (max(0, -lo), max(0, hi - len(x))), mode="edge"), width)
    out = np.empty(len(k), np.float32)
    for phase in range(up):
        own = (k * down) % up == phase
        out[own] = windows[place[own] - place[0]] @ taps[phase, ::-1].astype(np.float32)
    return out


@cache
def _mel_bank(rate: int) -> np.ndarray:
    """Triangles, overlapping by half, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).T


def log_mel(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel rows, log energy) of overlapping Hann frames of 8-bit samples at RATE_OUT; the last frame ends in zeros.

    Samples are resampled block by block, each with the few that its first and last frame need.
    """
    ratio = Fraction(RATE_OUT, rate)
    length = -(-len(samples) * ratio.numerator // ratio.denominator)
    n = max(1, -(-max(0, length - FRAME) // HOP) + 1)
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n)
    shift = float(samples.mean()) if len(samples) else 0.0
    hann, bank = np.hanning(FRAME).astype(np.float32), _mel_bank(RATE_OUT).astype(np.float32)
    for at in range(0, n, BLOCK_FRAMES):
        to = min(n, at + BLOCK_FRAMES)
        need = (to - at - 1) * HOP + FRAME
        y = resample(samples, ratio.numerator, ratio.denominator, at * HOP, min(length, at * HOP + need), shift, 1 / 128)
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(y, (0, need - len(y))), FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2
        mels[at:to] = np.log(power @ bank + 1e-8)
        energy[at:to] = np.log(power.sum(axis=1) + 1e-8)
    return mels, energy


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [a, b) that stay above LOW_DB of the loudest frame and reach HIGH_DB somewhere."""
    db = (energy - energy.max()) * 10 / np.log(10)
    above = np.concatenate([[0], (db >= LOW_DB).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(above))
    loud = np.concatenate([[0], np.cumsum(db >= HIGH_DB)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if loud[b] > loud[a]]


def sound_features(stored: bytes) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """(tensors n x TENSOR_FRAMES x MELS, their spans in ms, segments in ms) of one WAV stream."""
    rate, samples = wav_decode(stored)
    mels, energy = log_mel(np.frombuffer(samples, np.uint8), rate)
    ms = lambda frame: frame * HOP * 1000 // RATE_OUT
    n = -(-len(mels) // TENSOR_FRAMES)
    tensors = np.zeros((n * TENSOR_FRAMES, MELS), np.float32)
    tensors[: len(mels)] = mels
    spans = [(ms(i * TENSOR_FRAMES), ms(min(len(mels), (i + 1) * TENSOR_FRAMES))) for i in range(n)]
    return tensors.reshape(n, TENSOR_FRAMES, MELS), spans, [(ms(a), ms(b)) for a, b in hysteresis(energy)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with spaces to a positive multiple of UNIT, and their number before that."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def tensor_type() -> pa.DataType:
    """Arrow's fixed-shape tensor of one log-mel block."""
    return pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])


def as_tensors(blocks: np.ndarray) -> pa.ExtensionArray:
    """Blocks as an Arrow tensor column."""
    return pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(blocks.ravel()), TENSOR_FRAMES * MELS))


def media_schema(doc_id: pa.DataType) -> pa.Schema:
    """A row for each text: the sound, how many tensors it has in the file beside, and its loud segments."""
    span = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])
    return pa.schema([("doc_id", doc_id), ("n_bytes", pa.int64()), ("media", pa.binary()), ("n_tensors", pa.int64()), ("segments", pa.list_(span))])


#: A row for each tensor, in order of the texts: its span of time and its values.
TENSORS = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("log_mel", tensor_type())])


def store_media(docs: DataFrame, folder: str) -> DataFrame:
    """Store the sound and its features of every text below ``folder``; a row for each pair of files: path, n_rows.

    ``<path>.media.parquet`` has media_schema, ``<path>.tensors.parquet`` the tensors as Arrow's fixed-shape type. A failed
    attempt leaves files under names that are in no list. A null text is an empty one, so it becomes one unit of spaces;
    repeated rows are stored each; doc_id may be of any type; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name, rows, media, tensors = uuid.uuid4().hex, 0, None, None
        for batch in batches:
            kind = media_schema(batch.schema.field("doc_id").type)
            if media is None:
                media = pq.ParquetWriter(f"{root}/{name}.media.parquet", kind, filesystem=where, compression="zstd")
                tensors = pq.ParquetWriter(f"{root}/{name}.tensors.parquet", TENSORS, filesystem=where, compression="zstd")
            for part in slices(batch, most=GROUP_BYTES):
                out, spans, blocks = [], [], []
                for text in part.column("text"):
                    payload, n = payload_of(text.as_py())
                    sound = wav_encode(payload)
                    made, of, segments = sound_features(sound)
                    out.append((n, sound, len(made), [{"start_ms": a, "end_ms": b} for a, b in segments]))
                    spans += of
                    blocks.append(made)
                columns = [pa.array(c, kind.field(k + 1).type) for k, c in enumerate(zip(*out, strict=True))]
                media.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], schema=kind))
                tensors.write_batch(pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*spans, strict=True)), as_tensors(np.concatenate(blocks))], schema=TENSORS))
                rows += part.num_rows
        if media is not None:
            media.close()
            tensors.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([rows])], ["path", "n_rows"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "path string, n_rows long"), "media-files")


def read_media(path: str) -> Iterator[tuple[object, int, bytes, np.ndarray, list[tuple[int, int]], list[dict]]]:
    """(doc_id, n_bytes, media, tensors, their spans, segments) of each row of a stored pair of files, in order."""
    where, at = fs.FileSystem.from_uri(path)
    with where.open_input_file(f"{at}.media.parquet") as one, where.open_input_file(f"{at}.tensors.parquet") as two:
        blocks, held, spans = pq.ParquetFile(two).iter_batches(256), np.zeros((0, TENSOR_FRAMES, MELS), np.float32), []
        for batch in pq.ParquetFile(one).iter_batches(64):
            for k in range(batch.num_rows):
                doc_id, n_bytes, media, n, segments = (c[k].as_py() for c in batch.columns)
                while len(held) < n:
                    more = next(blocks)
                    held = np.concatenate([held, more.column("log_mel").to_numpy_ndarray()])
                    spans += zip(more.column("start_ms").to_pylist(), more.column("end_ms").to_pylist(), strict=True)
                yield doc_id, n_bytes, media, held[:n], spans[:n], segments
                held, spans = held[n:], spans[n:]


_DIGEST = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digest(files: DataFrame, doc_id: str) -> DataFrame:
    """A row of digests for each row stored in ``files``, of what is read back; ``doc_id``: the type of that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            where, at = fs.FileSystem.from_uri(path)
            kind = pq.read_schema(f"{at}.media.parquet", filesystem=where).field("doc_id").type
            out: list[tuple] = []
            for key, n, media, tensors, spans, segments in read_media(path):
                _, back = wav_decode(media)
                feature = f"tensors={len(tensors)}x{TENSOR_FRAMES}x{MELS};span_ms={spans[-1][1]};segments={len(segments)};voiced_ms={sum(s['end_ms'] - s['start_ms'] for s in segments)};sha256={hashlib.sha256(np.ascontiguousarray(tensors)).hexdigest()}"
                out.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", *_DIGEST])

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, f"doc_id {doc_id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text of docs as media with its features and give the digests of what is read back, one row each."""
    folder = scratch_path(docs.sparkSession, "media")
    return media_digest(store_media(docs, folder), docs.schema["doc_id"].dataType.simpleString())


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))
