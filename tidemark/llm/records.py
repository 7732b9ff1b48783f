"""Token ids in files of length-delimited binary records with masked checksums, and an offset index beside each."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, scratch_path
from tidemark.llm.words import slices, text_array

END_ID = 2
#: Distinct words whose ids a worker remembers; beyond that it begins anew.
REMEMBERED = 700_000
#: Documents of one range of doc_ids, about, while there are at most RANGES of them; and of one file at most. Beyond RANGES
#: ranges grow, and are sorted with spilling.
RANGE_DOCS, RANGES, FILE_DOCS = 8192, 1 << 16, 65536
#: Sampled ids for each range, from which its bounds come: 16 MB of them at most.
RANGE_SAMPLE = 32
VOCABULARY = "word_bpe_49k.json"
#: How that vocabulary's file prepares a text: white space ends a word whatever follows, and marks end one after a letter.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
}
#: A word that ends in an ASCII letter and full stops or commas: the tokenizer cuts between them, and no mark composes there.
_ENDED = r"(?s)^(?P<body>.*[A-Za-z])(?P<tail>[.,]+)$"


def masked(data: bytes) -> int:
    """crc32, rotated right by 15 bits plus a constant, so that a checksum of stored checksums stays safe."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """length (8 bytes), its masked crc, payload, its masked crc."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> Iterator[bytes]:
    """The payloads of a stream of frames; a broken length or payload raises ValueError."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("broken record length")
        n = struct.unpack("<Q", head[:8])[0]
        payload, check = stream.read(n), stream.read(4)
        if len(payload) < n or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
            raise ValueError("broken record payload")
        yield payload


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@cache
def _tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or default_vocabulary())


@cache
def _wordwise(path: str | None) -> bool:
    """Whether the file prepares texts as ``_WORDWISE`` says, so that words can be encoded one by one."""
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        about = json.load(file)
    steps = (about.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    return about.get("normalizer") == _WORDWISE["normalizer"] and steps[0] == _WORDWISE["split"]


@cache
def _memory(path: str | None) -> dict[str, bytes]:
    return {}


def _width(path: str | None) -> int:
    """Bytes of an id."""
    return 2 if _tokenizer(path).get_vocab_size() < 1 << 16 else 4


def _gather(pool: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pool's runs of those codes one after the other, the end of each)."""
    per = np.diff(starts)[codes]
    ends = np.cumsum(per)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1][codes] - (ends - per), per)], ends


def _plain(words: pa.Array) -> pa.Array:
    """The words, A-Z in lower case where that changes no id: in words below U+0300 that spell no special token.

    Nothing is composed below U+0300. Other words keep their case, as the vocabulary composes characters before it lowers
    them: J and U+030C stay two, j and U+030C become one.
    """
    import pyarrow.compute as pc

    kept = pc.match_substring_regex(words, r"<\||[^\x{0}-\x{2FF}]")
    return pc.if_else(kept, words, pc.ascii_lower(words))


def _encode_whole(texts: pa.Array, path: str | None) -> tuple[np.ndarray, np.ndarray]:
    found = [[*got.ids, END_ID] for got in _tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int64)


def encode(texts: pa.Array, path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, starts of each, n + 1), END_ID after each text.

    If the tokenizer never joins across white space, the ids of a text are those of its words, and each distinct word is
    encoded once; with any other vocabulary file the texts are encoded whole.
    """
    import pyarrow.compute as pc

    if not _wordwise(path):
        return _encode_whole(texts, path)
    lists = pc.ascii_split_whitespace(texts)
    flat, counts = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    written = flat.dictionary_encode()
    ended = pc.extract_regex(written.dictionary, _ENDED)
    body = _plain(pc.coalesce(pc.struct_field(ended, "body"), written.dictionary)).dictionary_encode()
    tail = pc.fill_null(pc.struct_field(ended, "tail"), "").dictionary_encode()
    known, tokenizer = _memory(path), _tokenizer(path)
    if len(known) > REMEMBERED:
        known.clear()
    pieces = body.dictionary.to_pylist() + tail.dictionary.to_pylist()
    missing = list({p for p in pieces if p not in known})
    for word, got in zip(missing, tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
        known[word] = array("I", got.ids).tobytes()
    blobs = [known[p] for p in pieces]
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)])
    code = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.stack([code(body), code(tail) + len(body.dictionary)], axis=1).ravel()
    pool, ends = _gather(np.frombuffer(b"".join(blobs), np.uint32), starts, pairs)
    # the end id stands as one more word behind each text
    pool_starts = np.concatenate([[0], ends[1::2], [len(pool) + 1]])
    codes = np.insert(code(written), np.cumsum(counts), len(pairs) // 2)
    ids, ends = _gather(np.append(pool, np.uint32(END_ID)), pool_starts, codes)
    word_starts = np.concatenate([[0], np.cumsum(counts + 1)])
    return ids, np.concatenate([[0], ends])[word_starts]


def tokenize(docs: DataFrame, path: str | None, cuts: np.ndarray) -> DataFrame:
    """shard, doc_id and ids (little-endian, 2 bytes an id if the vocabulary allows it) of every text; null is empty.

    shard is the number of cuts below doc_id, 0 for a null one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, starts = encode(text_array(part), path)
                ids = ids.astype(f"<u{_width(path)}")
                data = pa.py_buffer(ids.tobytes())
                offsets = pa.py_buffer((starts * ids.itemsize).astype(np.int32).tobytes())
                there = pa.compute.is_valid(part.column("doc_id")).to_numpy(zero_copy_only=False)
                shard = np.searchsorted(shared.value, pa.compute.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False), "left") * there
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), part.column("doc_id"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, data])], ["shard", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "shard long, doc_id long, ids binary")


def _writer(folder: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes each run of equal shard numbers to one file and its index, under a name of this attempt, then renames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        done: list[tuple] = []
        shard, out, name, n_docs, n_ids, at, index = None, None, "", 0, 0, 0, []

        def close() -> None:
            if out is None:
                return
            out.close()
            with where.open_output_stream(f"{root}/{name}.idx") as to:
                to.write(np.array(index, "<u8").tobytes())
            where.move(f"{root}/{name}.part", f"{root}/{name}.rec")
            done.append((shard, len(done), name, n_docs, n_ids))

        for batch in batches:
            for key, doc_id, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if key != shard or n_docs >= FILE_DOCS:
                    close()
                    shard, name = key, f"ids-{key:08d}-{uuid.uuid4().hex[:12]}"
                    out, n_docs, n_ids, at, index = where.open_output_stream(f"{root}/{name}.part"), 0, 0, 0, []
                payload = struct.pack("<?q", doc_id is not None, doc_id or 0) + ids.as_buffer().to_pybytes()
                record = frame(payload)
                out.write(record)
                index.append(at)
                at, n_docs, n_ids = at + len(record), n_docs + 1, n_ids + (len(payload) - 9) // width
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["shard", "nth", "name", "n_docs", "n_ids"])

    return run


def write_records(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write the token ids of docs to ``folder`` in ascending order of doc_id; returns the list of files.

    Each file holds a run of doc_ids (null first). A record is a presence byte and the doc_id
    (8 bytes), then the ids. Beside it stands an index of the records' byte offsets, for reads in any order. Files of failed
    attempts keep other names and are not in the list. The list has a row for each file: shard, name, n_docs, n_ids, first
    (ids in all files before it). doc_id must be an integer or text that spells one; anything else stops the job.
    """
    width, n = _width(path), docs.count()
    shards = min(RANGES, max(1, -(-n // RANGE_DOCS)))
    cuts = np.zeros(0, np.int64)
    if shards > 1:
        spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
        some = docs.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull() & (spot < RANGE_SAMPLE * shards / n)).toArrow()
        found = np.sort(some.column(0).to_numpy())
        cuts = np.unique(found[np.arange(1, shards) * len(found) // shards]) if len(found) else cuts
    spread = tokenize(docs, path, cuts).repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    files = spread.select("shard", "doc_id", "ids").mapInArrow(_writer(folder, width), "shard long, nth long, name string, n_docs long, n_ids long").toArrow().sort_by([("shard", "ascending"), ("nth", "ascending")])
    firsts = np.concatenate([[0], np.cumsum(files.column("n_ids").to_numpy())])[:-1] if len(files) else np.zeros(0, np.int64)
    rows = [(int(s), f"{folder}/{name}.rec", int(d), int(i), int(f)) for s, name, d, i, f in zip(*(files.column(c).to_pylist() for c in ("shard", "name", "n_docs", "n_ids")), firsts, strict=True)]
    return docs.sparkSession.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, first long")


def read_records(files: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record of the listed files, read back and checked frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                where, at = fs.FileSystem.from_uri(path)
                out: list[tuple] = []
                with where.open_input_stream(at, buffer_size=1 << 20) as stream:
                    for payload in unframe(stream):
                        there, doc_id = struct.unpack_from("<?q", payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=9)
                        out.append((doc_id if there else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.repartition(n).select("path", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_one(path: str, nth: int, width: int = 2) -> tuple[int | None, np.ndarray]:
    """Record ``nth`` of a file through its index: (doc_id, ids)."""
    where, at = fs.FileSystem.from_uri(path)
    with where.open_input_file(at.removesuffix(".rec") + ".idx") as index:
        offset = struct.unpack("<Q", index.read_at(8, 8 * nth))[0]
    with where.open_input_file(at) as stream:
        stream.seek(offset)
        payload = next(unframe(stream))
    there, doc_id = struct.unpack_from("<?q", payload)
    return (doc_id if there else None), np.frombuffer(payload, f"<u{width}", offset=9)


def token_records(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write, then read back: one row for each row of docs. Null text is empty (the end id alone); null ids come first."""
    return read_records(write_records(docs, scratch_path(docs.sparkSession, "records"), path), _width(path))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(read(spark, sf_dir, "documents"))
