"""The pipeline's stages on null and repeated ids: every row is judged by itself."""

from collections import Counter

from tests.llm import brute
from tests.llm.test_exact import rows_of
from tidemark.llm import mixing, stages


def judged(spark, stage, docs, tables):
    return Counter(rows_of(stage(spark, docs, tables)))


def test_decontamination(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    more = docs.unionByName(docs.where("doc_id = 6").selectExpr("null AS doc_id", "'clean of no id' AS text", *docs.columns[2:]))
    rows = rows_of(more)
    want = Counter(r for r, got in zip(rows, brute.contamination(rows, items), strict=True) if not got[5])
    assert want[None, "clean of no id"] == want[None, None] == want[10, "one id"] == 1 and not want[6, "word"]
    assert judged(spark, stages.decontamination, more, str(tmp_path)) == want


def test_near_dedup(spark, docs):
    more = docs.unionByName(docs.where("doc_id = 9").limit(1).selectExpr("doc_id", "' ' AS text", *docs.columns[2:]))
    rows = rows_of(more)
    want = Counter(r for r, got in zip(rows, brute.near_duplicates(rows), strict=True) if got[3])
    assert want[9, " "] == 1 and not [r for r in want if r[0] == 9 and r[1] != " "]
    assert judged(spark, stages.near_dedup, more, "") == want


def test_mixing(spark):
    rows = [(None, f"{k} " + "a b c " * 43, "en", "a") for k in range(9)] + [(7, f"{k} " + "d e f " * 43, "en", None) for k in range(9)]
    rows += [(8, "same " * 130, lang, "b") for lang in ("en", "en", "fr", "de", "es", "it", "pt")] + [(None, None, "en", "a"), (7, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    want = Counter()
    key = {r[0]: r[1] for r in docs.selectExpr("xxhash64(text)", "text").collect()}
    for r in mixing.mix(docs).where("size > 0").collect():
        want[r.doc_id, key[r["__key"]]] += int(r.taken / r["size"] + 0.5)
    assert len(set(want.values())) > 2
    got = stages.mixing(spark, docs, "")
    assert got.columns == docs.columns and judged(spark, stages.mixing, docs, "") == +want
    shared = Counter(r.lang for r in got.where("doc_id = 8").collect())
    assert len(shared) == min(6, want[8, "same " * 130]) and judged(spark, stages.mixing, docs.repartition(5), "") == +want


def test_quality(spark, docs, tmp_path):
    """Columns named like the verdict stay as they are; rows of one text are judged alike, null ids and texts included."""
    spark.createDataFrame([(1, 1), (2, 1), (8, 0), (9, 0), (12, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = docs.withColumnRenamed("hits", "_score").unionByName(docs.withColumnRenamed("hits", "_score").where("doc_id = 8"))
    got = stages.quality(spark, more, str(tmp_path))
    assert got.columns == more.columns and {r[0] for r in got.select("score", "predicted", "_score").distinct().collect()} == {"x"}
    kept = Counter(rows_of(got))
    assert not [r for r in kept if r[0] in (8, 9, 12)] and all(kept[r] == n for r, n in Counter(rows_of(more)).items() if r in kept) and kept
    nothing = stages.quality(spark, more, str(tmp_path)).limit(0)
    assert nothing.count() == 0 and stages.quality(spark, more.limit(0), str(tmp_path)).count() == 0
