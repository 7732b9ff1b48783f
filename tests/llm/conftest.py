import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12
PASSAGE = " ".join(f"w{k}x{k * k % 97}" for k in range(70))

#: Nulls, empty and very short texts, white space of all kinds, repeated rows, one id with two texts, copies, shared passages.
ROWS = [
    (1, PASSAGE + " tail one", "en", "a"),
    (2, "head two " + PASSAGE, "en", "b"),
    (3, None, None, None),
    (4, "", "fr", "a"),
    (5, " \t\n ", "fr", "a"),
    (6, "word", "de", None),
    (7, "Word", "de", "c"),
    (8, LONG, "en", "a"),
    (9, LONG, "en", "a"),
    (9, LONG, "en", "a"),
    (10, "one id", "es", "b"),
    (10, PASSAGE, "es", "b"),
    (None, PASSAGE + " no id", "en", "a"),
    (None, None, None, None),
    (11, "Ünïcödé\x0bwörds\x0c here\r\nand <|endoftext|> İstanbul don't stop... 3.14,", "de", "c"),
    (12, "z" * 3000 + " " + "ab" * 900, "en", "c"),
    (13, "the the the the the the the the the the the the the", "en", "a"),
    (14, "123 456 !!", "en", "a"),
    (20, "of two texts, the first is like fifteen", "en", "a"),
    (20, LONG, "en", "a"),
    (15, "of two texts, the first is like fifteen", "en", "c"),
]
CLASHES = ["key", "__key", "size", "taken", "score", "predicted", "rep", "component", "n_shingles", "spans", "whole", "h", "n", "shard", "ids", "item", "start", "w", "hits", "target", "no", "at", "block", "held_out", "kept", "letters"]


@pytest.fixture(scope="session")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return frame.selectExpr("*", *(f"'x' AS {c}" for c in CLASHES))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    words = PASSAGE.split()
    rows = [(1, " ".join(words[20:40])), (2, "the the the"), (3, None), (4, ""), (None, "Word"), (5, " ".join(words[30:45])), (5, "not there at all"), (6, "THE, the; the the the the the the the the the the the the the the")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS item", "1 AS window")
