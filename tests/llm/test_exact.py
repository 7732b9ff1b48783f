"""Operators with exact contracts against brute force: on awkward rows, on none, and on the small tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from tidemark.llm import decontamination, minhash, prefix_doubling, records, suffix_trees


def rows_of(frame):
    return [(r[0], r[1]) for r in frame.select("doc_id", "text").collect()]


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def want(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_contamination(docs, benchmark, empty, small, spark):
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert got(decontamination.contamination(docs, benchmark)) == want(brute.contamination(rows_of(docs), items))
    assert decontamination.contamination(empty, benchmark).count() == 0
    assert not decontamination.contamination(docs, benchmark.limit(0)).where("contaminated").count()
    table = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert got(decontamination.contamination(small, table)) == want(brute.contamination(rows_of(small), [tuple(r) for r in table.collect()]))


def test_contamination_without_broadcasts(docs, benchmark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert got(decontamination.contamination(docs, benchmark)) == want(brute.contamination(rows_of(docs), items))


def test_words_are_found_by_a_quick_pattern(spark):
    plain = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    every = [chr(c) for c in (*range(0x3000), *range(0xFFF0, 0x10100), 0x1F600, 0x10FFFF)]
    frame = spark.createDataFrame([("".join(every),), ("a".join(every),), (None,)], "text string")
    quick = F.regexp_extract_all("text", F.lit(decontamination._RAW_WORDS), F.lit(0))
    assert frame.where(~quick.eqNullSafe(F.regexp_extract_all("text", F.lit(plain), F.lit(0)))).count() == 0
    long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("some words of a text, "), 2000).alias("text")).cache()
    long.count()

    def seconds(pattern):
        begin = time.perf_counter()
        long.agg(F.sum(F.regexp_count("text", F.lit(pattern)))).collect()
        return time.perf_counter() - begin

    assert min(seconds(decontamination._RAW_WORDS) for _ in range(3)) < 0.7 * min(seconds(plain) for _ in range(3))


def test_proximity(spark):
    texts = [(1, "red fox runs far over the red hill"), (2, "fox red"), (3, "red " + "x " * 20 + "fox")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    postings = decontamination.build_index(frame, spark.createDataFrame([("red",), ("fox",), ("hill",)], "term string"))
    queries = spark.createDataFrame([("a", ["red", "fox"]), ("b", ["hill"]), ("c", ["red", "absent"])], "query string, terms array<string>")
    found = {(r.query, r.doc_id, r.pos) for r in decontamination.proximity_matches(postings, queries, 3).collect()}
    assert found == {("a", 1, 1), ("a", 2, 0), ("b", 1, 7)}


@pytest.mark.parametrize(("operator", "plain"), [(suffix_trees.remove_repeated_words, brute.repeated_words), (prefix_doubling.remove_repeated_bytes, brute.repeated_bytes)])
def test_repeats(docs, empty, small, operator, plain):
    assert got(operator(docs)) == want(plain(rows_of(docs)))
    assert operator(empty).count() == 0
    assert got(operator(small)) == want(plain(rows_of(small)))


def test_contents_of_pieces_are_neither_dealt_to_their_owners_nor_kept(small, monkeypatch):
    from tidemark.llm import repeats

    made, gone = {}, []
    keep, drop = repeats.materialize, repeats.release
    monkeypatch.setattr(repeats, "materialize", lambda df, name: made.setdefault(name, keep(df, name)))
    monkeypatch.setattr(repeats, "release", lambda *tables: (gone.extend(t.scratch for t in tables), drop(*tables)))
    suffix_trees.remove_repeated_words(small.limit(300)).count()
    assert "piece" not in made["placed"].columns
    assert gone == [made["pieces"].scratch, made["distinct"].scratch]


def test_repeats_in_many_parts(docs, small, monkeypatch):
    from tidemark.llm import repeats, words

    monkeypatch.setattr(repeats, "GRAM_PART", 1 << 14)
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(words, "SLICE_BYTES", 1 << 12)
    for name, value in (("BLOCK_BYTES", 1 << 11), ("PART_PAIRS", 1 << 9), ("PIECE_WINDOWS", 70), ("CUT", 3)):
        monkeypatch.setattr(prefix_doubling, name, value)
    for name, value in (("BLOCK_BYTES", 1 << 11), ("GROUP", 30), ("PART", 200), ("PIECE_WINDOWS", 40), ("CUT", 3)):
        monkeypatch.setattr(suffix_trees, name, value)
    assert got(suffix_trees.remove_repeated_words(small)) == want(brute.repeated_words(rows_of(small)))
    assert got(prefix_doubling.remove_repeated_bytes(docs)) == want(brute.repeated_bytes(rows_of(docs)))
    few = small.where("doc_id < 60")
    assert got(prefix_doubling.remove_repeated_bytes(few)) == want(brute.repeated_bytes(rows_of(few)))


def test_near_duplicates(docs, empty, small):
    assert got(minhash.near_duplicates(docs)) == want(brute.near_duplicates(rows_of(docs)))
    assert minhash.near_duplicates(empty).count() == 0
    assert got(minhash.near_duplicates(small)) == want(brute.near_duplicates(rows_of(small)))


def test_links_that_the_first_round_misses(spark):
    """A chain: neighbours are alike, the ends aren't; and a bucket's smallest member is alike to none of the others."""
    words = [f"t{k}" for k in range(400)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 200])) for k in range(12)]
    rows += [(100 + k, " ".join([f"n{k}_{j}" for j in range(6)] + words[:60])) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(frame)) == want(brute.near_duplicates(rows))


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 150), (150, 175)]
    found = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100, 150: 150, 175: 150, 200: 150}


def test_estimate_is_near_the_similarity(spark):
    import numpy as np
    import pyarrow as pa

    a = " ".join(f"q{k}" for k in range(1000))
    b = " ".join(f"q{k}" for k in range(200, 1200))
    shingles, starts = minhash.shingle_sets(pa.array([a, b]))
    low = minhash.minima(shingles, starts[:-1])
    bits = minhash.pack((low * np.uint32(2654435769)) >> np.uint32(32 - minhash.BITS)).view(np.int64).tolist()
    frame = spark.createDataFrame([tuple(bits)], "x array<long>, y array<long>")
    estimate = frame.select(minhash.estimate(frame.x, frame.y)).first()[0]
    true = len(brute.shingles(a) & brute.shingles(b)) / len(brute.shingles(a) | brute.shingles(b))
    assert abs(estimate - true) < 0.2


def test_token_records(docs, empty, small, spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(records.default_vocabulary())
    for frame in (docs, small):
        assert got(records.token_records(frame)) == want(brute.tokens(rows_of(frame), tokenizer))
    assert records.token_records(empty).count() == 0


def test_random_tokens():
    """Letters that change or compose, marks, special tokens and every kind of space: ids are the tokenizer's own."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    draw = random.Random(3)
    signs = [*"abzHJTWY\u0130\u0131\u015e\u00c9\u00df.,,..'<|>  \t\n\x0b\x1f\u0085\u00a0\u3000\u4e09\u03c2\u03a309!?-_", *"\u0331\u030c\u0307\u0301\u0308\u030a", "<|endoftext|>", "<|startoftext|>", "'s", "AB\u0130, x", "ing"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    ids, starts = records.encode(pa.array(texts), None)
    own = Tokenizer.from_file(records.default_vocabulary())
    for k, e in enumerate(own.encode_batch(texts, add_special_tokens=False)):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*e.ids, 2], texts[k]


def test_a_vocabulary_of_another_kind():
    """Its texts are encoded whole."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["two  spaces, and\nlines", "", "A.B"]
    ids, starts = records.encode(pa.array(texts), path)
    own = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_recall_of_bands():
    """Pairs at exactly the least similarity share a band."""
    import numpy as np

    rng, missed = np.random.default_rng(0), 0
    for size in (4, 16, 40, 100, 400):
        common, apart = 3 * size // 4, size // 4  # 3 / 4 of the union
        for _ in range(200):
            both = rng.integers(0, 1 << 63, common, dtype=np.uint64)
            a, b = both, np.concatenate([both, rng.integers(0, 1 << 63, apart, dtype=np.uint64)])
            low = minhash.minima(np.concatenate([a, b]), np.array([0, len(a)])).reshape(2, minhash.BANDS, minhash.ROWS)
            missed += not (low[0] == low[1]).all(axis=1).any()
    assert missed == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies just under and over the least similarity, in squares of few tests."""
    import random

    monkeypatch.setattr(minhash, "MEETINGS", 50)
    draw = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in draw.sample(range(120), draw.randint(1, 9)):
            w[at] = f"n{k}_{at}"
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(frame)) == want(brute.near_duplicates(rows))


def test_capitals_before_combining_marks(spark):
    """Of these letters only the small one has a composed form, so lower case comes after composing; a special token near by changes nothing."""
    from tokenizers import Tokenizer

    pairs = [a + b for a, b in zip("HJTWY", "\u0331\u030c\u0308\u030a\u030a", strict=True)]
    texts = [f"{p}ab X{p}, {p.lower()}ab PLAIN Plain plain." for p in pairs]
    texts += [texts[0] + " Some<|endoftext|> <|ENDOFTEXT|>", "\u0391\u03a3 \u0130A E\u0301T\u00c9"]
    tokenizer = Tokenizer.from_file(records.default_vocabulary())
    for cut in (len(pairs), len(texts)):
        rows = list(enumerate(texts[:cut]))
        frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert got(records.token_records(frame)) == want(brute.tokens(rows, tokenizer))


def test_token_files(small, spark, tmp_path, monkeypatch):
    """Records by their index, and a broken byte is noticed."""
    monkeypatch.setattr(records, "RANGE_DOCS", 50)
    monkeypatch.setattr(records, "FILE_DOCS", 20)
    files = records.write_records(small, f"file://{tmp_path}/out").orderBy("first").collect()
    assert len(files) > 8
    ids = []
    for f in files:
        ids += [records.read_one(f.path, k)[0] for k in range(f.n_docs)]
    assert ids == sorted(r[0] for r in small.select("doc_id").collect())
    path = files[0].path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    with pytest.raises(ValueError, match="broken"):
        import io

        list(records.unframe(io.BytesIO(bytes(data))))


def test_answers_of_a_part_are_packed_by_home():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.repeats import pack

    rng = np.random.default_rng(4)
    labels = [rng.integers(1, 1 << 60, 40).astype(np.uint64) for _ in range(5)]
    sid, nth = np.repeat(np.arange(40, dtype=np.uint64), 40), np.tile(np.arange(0, 4000, 100, dtype=np.uint64), 40)
    rows = [([1], pack(*(np.tile(x, 40) for x in labels)), pack(sid, sid + np.uint64(7), nth)), ([2], pack(*labels), pack(sid[:40] + np.uint64(5), nth[:40] * 0 + np.uint64(3), nth[:40] + np.uint64(10)))]
    rows += [([2], pack(*labels), pack(sid[:40] + np.uint64(6), nth[:40] * 0 + np.uint64(9), nth[:40] + np.uint64(10)))]
    sent = [pa.RecordBatch.from_arrays([pa.array(p), pa.array([e], pa.binary()), pa.array([s], pa.binary())], ["part", "edges", "suffixes"]) for p, e, s in rows]
    got = list(suffix_trees._trees(3)(iter(sent)))
    assert [b.num_rows for b in got] == [3, 1]  # a row for each home, not one for each of 39 pieces
    by_home = pa.Table.from_batches(got).sort_by("home").to_batches()
    found = dict(zip(*(pa.Table.from_batches(list(suffix_trees._gathered(iter(by_home)))).column(c).to_pylist() for c in ("sid", "spans")), strict=True))
    assert sorted(found) == list(range(1, 40))
    alone = [(a << 32) | (a + 50) for a in range(0, 4000, 100)]
    assert found[1] == alone and found[6] == [(a << 32) | (a + 60) for a in range(0, 4000, 100)]  # spans of two parts meet


def test_pairs_are_sorted_at_once(monkeypatch):
    import numpy as np

    rng, sorts, plain = np.random.default_rng(3), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or plain(*a, **b))
    for tops, most in (((30, 30), 1), ((30, 30, 4), 1), ((1 << 63, 1 << 63, 1 << 63, 1 << 16), 5), ((1 << 40, 1 << 63), 3)):
        columns = [rng.integers(0, top, 5000).astype(np.uint64) for top in tops]
        columns[0] = columns[0] // np.uint64(7) * np.uint64(7)
        sorts.clear()
        order = prefix_doubling.order_of(columns)
        assert len(sorts) <= most
        keys = list(zip(*(c[order].tolist() for c in columns), strict=True))
        assert keys == sorted(keys)


def test_pairs_that_a_block_sends_twice(spark, small, monkeypatch):
    """Windows that differ in their last bytes only, in blocks with few bits left for these."""
    from tests.llm import brute

    texts = [f"{head} lies the way of all that is{k % 40:02d}, and of what was there before it came to be so" for k in range(80) for head in ("here", "there" if k % 3 else "where")]
    docs = spark.createDataFrame([(k, " ".join([t] * (1 + k % 2))) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(prefix_doubling, "bits", lambda n, plain=prefix_doubling.bits: 21 if n > 1000 and plain(n) < 21 else plain(n))
    assert got(prefix_doubling.remove_repeated_bytes(docs)) == want(brute.repeated_bytes(rows_of(docs)))


def test_parts_of_the_order_stay_small(spark, monkeypatch):
    """Neither a very common beginning nor a very common rank makes a part larger than others."""
    rng, most, parts = np.random.default_rng(3), 2000, []
    text = "".join("z" * 40 + "".join(rng.choice(list("abcdefghij"), 10)) for _ in range(500))
    pieces = spark.createDataFrame([(1, bytearray(text.encode()), 1), (2, bytearray(("y" + text).encode()), 2)], "sid long, piece binary, least long").repartition(1)
    for name, value in {"BLOCK_BYTES": 4096, "PART_PAIRS": most}.items():
        monkeypatch.setattr(prefix_doubling, name, value)

    def noted(df, name, plain=prefix_doubling.materialize):
        out = plain(df, name)
        if name == "ranked":
            rows = out.select("part", "got").collect()
            parts.append(np.bincount([r[0] for r in rows], [len(prefix_doubling.unpack(r[1])[0]) for r in rows]))
        return out

    monkeypatch.setattr(prefix_doubling, "materialize", noted)
    spans = {r[0]: r[1] for r in prefix_doubling.smaller_copies(pieces).collect()}
    assert spans == {2: [1 << 32 | len(text) + 1]}
    assert len(parts) == 2 and max(p.max() for p in parts) <= 2 * most
