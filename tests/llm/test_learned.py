"""Learned operators, media, mixing and the pipeline."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm import brute
from tidemark.llm import langid, media, mixing, quality, stages, toxicity
from tidemark.llm.common import read

HELD = "/root/testdata/sf0.01"


def test_language(spark, docs, empty):
    rows = langid.op10_language_id(spark, HELD).join(read(spark, HELD, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held)
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (14, "und"), (None, "und")} <= got
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(empty, model).count() == 0
    assert langid.train(empty) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


@pytest.mark.parametrize(("module", "query", "label", "mod", "rest"), [(quality, quality.op5_quality, "quality", 3, 1), (toxicity, toxicity.op1_toxicity, "toxic", 4, 2)])
def test_classifiers(spark, docs, empty, module, query, label, mod, rest):
    rows = query(spark, HELD).join(read(spark, HELD, "labels").select("doc_id", label), "doc_id", "left").collect()
    assert len(rows) == read(spark, HELD, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    held = [(r[label], r.score) for r in rows if r.held_out and r[label] is not None]
    pairs = [(a > b) + (a == b) / 2 for y, a in held for z, b in held if y == 1 and z == 0]
    assert sum(pairs) / len(pairs) > 0.8
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (9, 0), (10, None), (None, 1), (77, 1)], f"doc_id long, {label} int")
    model = module.train(docs, labels)
    got = module.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert module.predict(empty, model).count() == 0 and module.train(empty, labels) is None
    assert module.predict(docs, None).count() == docs.count()


def test_unseen_misspelling_shares_subwords():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    clean = [f"{a}{b}" for a in ("re", "no", "ta", "mi", "lo") for b in ("der", "nal", "pos", "ket")]
    texts, labels = [], []
    for k in range(300):
        w = list(rng.choice(clean, 40))
        if k % 3 == 0:
            w[int(rng.integers(40))] = ("wretchoid", "wretchoids", "wretchoidy")[k % 9 // 3]
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(pa.array(texts), np.array(labels))
    bad, good = toxicity.score_texts(pa.array(["reder nonal wretchoidal tapos", "reder nonal minal tapos"]), model)
    assert bad > 0.3 > good


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 3)), np.zeros((1, 1)))
    cols, x = np.array([1, 4, 9, 13]), rng.normal(size=4)
    pairs = sum(model.v[cols[i]] @ model.v[cols[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert np.isclose(quality.margin(model, np.zeros(4, int), cols, x, 1)[0], model.w0 + model.w[cols] @ x + pairs)


def test_media(spark, docs, empty, tmp_path):
    want = docs.select("doc_id", "text").collect()
    rows = {(r.doc_id, r.payload_sha256): r for r in media.media_columns(docs).collect()}
    for doc_id, text in want:
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, math.ceil(len(raw) / 192)) * 192 - len(raw))
        r = rows[doc_id, hashlib.sha256(payload).hexdigest()]
        wav = media.wav_encode(payload)
        blocks, spans, segments = media.sound_features(wav)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest()) and media.wav_decode(wav) == (16000, payload)
        assert r.feature == f"tensors={len(blocks)}x64x16;span_ms={spans[-1][1]};segments={len(segments)};voiced_ms={sum(b - a for a, b in segments)};sha256={hashlib.sha256(blocks.tobytes()).hexdigest()}"
    assert media.media_columns(docs).count() == len(want) and media.media_columns(empty).count() == 0


def test_stored_media(docs, tmp_path):
    """The files hold fixed-shape tensors with their spans."""
    import pyarrow.parquet as pq

    files = media.store_media(docs.coalesce(1), f"file://{tmp_path}/m").collect()
    path = files[0].path.removeprefix("file://")
    table = pq.read_table(f"{path}.tensors.parquet")
    assert table.schema.field("log_mel").type == media.tensor_type() and table.column("log_mel").type.shape == [64, 16]
    read = list(media.read_media(files[0].path))
    assert len(read) == files[0].n_rows == docs.count() and sum(len(r[3]) for r in read) == table.num_rows
    assert all((r[3] == media.sound_features(r[2])[0]).all() and len(r[4]) == len(r[3]) for r in read)


def test_features_of_a_long_sound_in_little_memory():
    import tracemalloc

    sound = media.wav_encode(np.random.default_rng(0).integers(0, 255, 4 << 20, dtype=np.uint8).tobytes())
    tracemalloc.start()
    blocks, spans, _ = media.sound_features(sound)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and len(blocks) == len(spans) == -(-((4 << 20) // 2 - 128) // 128 // 64)


def test_blocks_change_nothing(monkeypatch):
    x = np.random.default_rng(1).integers(0, 255, 9000, dtype=np.uint8)
    whole = media.log_mel(x, 16000)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 3)
    for a, b in zip(whole, media.log_mel(x, 16000), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_resampling_and_segments():
    x = np.sin(np.arange(1600) * 2 * np.pi * 200 / 16000).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        y = media.resample(x, up, down)
        t = np.sin(np.arange(len(y)) * 2 * np.pi * 200 / (16000 * up / down))
        assert np.abs(y - t)[40:-40].max() < 0.05
    energy = np.log(np.array([1e-4, 1, 0.3, 1, 0.05, 0.3, 0.3, 1e-4]))
    assert media.hysteresis(energy) == [(1, 4)]


def test_mixing(docs, empty, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    assert all(r.source_size == sizes[r.source] for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, open_ = {}, set(order)
    while True:
        level = (1.5 * sum(sizes.values()) - sum(goal.values())) / max(1, sum(weights[s] for s in open_))
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            goal |= {s: level * weights[s] for s in open_}
            break
        goal |= {s: 2 * sizes[s] for s in full}
        open_ -= full
    assert all(math.isclose(r.target, goal[r.source], abs_tol=1e-6) for r in rows)
    assert mixing.mix(empty).count() == 0
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert sorted(stages.mixing(spark, docs, DATA).columns) == sorted(docs.columns) and stages.mixing(spark, empty, DATA).count() == 0
    assert {r[0] for r in stages.mixing(spark, docs, DATA).select("size").collect()} == {"x"}


def test_mixture_interleaves(spark):
    """Slots hold whole blocks, sources take turns in proportion from the start, and the rows add up to what is taken."""
    docs = read(spark, DATA, "documents")
    rows = sorted(mixing.mixture(docs).collect(), key=lambda r: (r.slot, r["at"]))
    words = {}
    for r in rows:
        words[r.slot] = words.get(r.slot, 0) + r.end_word - r.first_word
    assert max(words.values()) == 64 and sum(v == 64 for v in words.values()) >= len(words) - 20
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.end_word - r.first_word
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken} == taken
    source = {r.slot: r.source for r in rows}
    of = [source[k] for k in sorted(source)]
    for name in set(of):
        share = of.count(name) / len(of)
        assert all(abs(of[:k].count(name) - share * k) < 6 for k in range(0, len(of), 50))


def test_mixing_comes_near_its_targets(spark):
    rows = mixing.mix(read(spark, HELD, "documents")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.03 * r["max(target)"] for r in rows)


def test_pipeline(spark):
    """Every stage against brute force on what the one before kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tidemark.llm.records import default_vocabulary

    frame = read(spark, DATA, "documents")
    columns = frame.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, DATA)
        assert name == "token_records" or out.columns == columns
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "quality":
            labels = {r.doc_id: r.quality for r in read(spark, DATA, "labels").collect()}
            assert not [i for i in ids if labels.get(i) == 0] and not {i for i, y in labels.items() if y == 1} - set(ids)
        elif name == "near_dedup":
            assert ids == sorted(r[0] for r in brute.near_duplicates(rows) if r[3])
        elif name == "decontamination":
            items = [tuple(r) for r in read(spark, DATA, "benchmark").collect()]
            assert ids == sorted(r[0] for r in brute.contamination(rows, items) if not r[5])
        elif name == "mixing":
            taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(frame).collect()}
            assert ids == sorted(i for i, (t, n) in taken.items() for _ in range(int(t / max(1, n) + 0.5)))
        else:
            assert sorted(map(tuple, out.collect())) == sorted(brute.tokens(rows, Tokenizer.from_file(default_vocabulary())))
        kept.append(len(ids))
        frame = spark.createDataFrame(out.collect(), out.schema)
    assert kept[0] < 200 and kept[1] < kept[0]
    assert len(corpus_pipeline.run(spark, DATA).collect()) == kept[-1]
    nothing = read(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0
