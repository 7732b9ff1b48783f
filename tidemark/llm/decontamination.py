"""Benchmark decontamination by a distributed positional inverted index.

The index holds a row (term, document, position) for each occurrence of the terms that a search needs. A phrase is found by
its rarest terms: their lists, each shifted by the term's offset in the phrase, must hold the same start. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read

WINDOW = 10
#: Terms of a window whose lists are intersected, rarest first.
RAREST = 2
#: Rows up to which a table of terms, windows or document keys (under 100 bytes a row) is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 200_000
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z is this before it; Java tests each negated range of a class by a
#: call for each character, which takes four times as long as one table for ASCII and one range.
_RAW_WORDS = r"[\p{Alnum}\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none of a null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_RAW_WORDS), F.lit(0)), F.array().cast("array<string>"))


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most BROADCAST_ROWS rows; df is a table on disk, so counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows that agree in both are one document."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("__key"))


def windows_of(items: DataFrame) -> DataFrame:
    """item (the id as text, a null as ``null``), window (its words), one row for each distinct pair."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1))))
    return split.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at"), F.lit(WINDOW)).alias("window")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n, its occurrences in all of docs, for each of the distinct ``terms``; 0 if there is none."""
    found = docs.select(F.explode(words(F.col("text"))).alias("term")).join(_small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (term, doc_id, __key, pos) of the distinct ``terms`` in all of docs, as a table; pos counts from 0."""
    tokens = _keyed(docs).select("doc_id", "__key", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return materialize(tokens.join(_small(terms), "term").select("term", "doc_id", "__key", "pos"), "postings")


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """wid, term, offset (from 0), role (1, 2, 4, ...) of the RAREST rarest distinct terms of each window."""
    each = windows.select("wid", F.posexplode("window").alias("offset", "term"))
    first = each.groupBy("wid", "term").agg(F.min("offset").alias("offset")).join(counts, "term")
    nth = F.row_number().over(Window.partitionBy("wid").orderBy("n", "term"))
    return first.withColumn("nth", nth).where(F.col("nth") <= RAREST).select("wid", "term", "offset", F.pow(F.lit(2), F.col("nth") - 1).cast("int").alias("role"))


def intersect(postings: DataFrame, picked: DataFrame) -> DataFrame:
    """wid, doc_id, __key, start where the offset-adjusted lists of all picked terms of a window meet."""
    whole = picked.groupBy("wid").agg(F.sum("role").alias("all_roles"))
    met = postings.join(picked, "term").select("wid", "doc_id", "__key", (F.col("pos") - F.col("offset")).alias("start"), "role").where("start >= 0")
    return met.groupBy("wid", "doc_id", "__key", "start").agg(F.bit_or("role").alias("roles")).join(whole, "wid").where("roles = all_roles").drop("roles", "all_roles")


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, __key, n_hit, n_items, items_sha256 of the documents in which a window occurs word for word.

    windows has (item, window). Windows with the same words are searched once. The whole corpus is read once to count the
    windows' terms, once to index the rarest, and the documents that the lists point to once more to compare every word.
    """
    listed = windows.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("wid", F.xxhash64(F.array_join("window", " ")))
    listed = materialize(listed, "windows")
    terms = materialize(listed.select(F.explode("window").alias("term")).distinct(), "terms")
    picked = materialize(rarest_terms(listed, term_counts(docs, terms)), "picked")
    postings = build_index(docs, materialize(picked.select("term").distinct(), "picked-terms"))
    met = materialize(intersect(postings, _small(picked)), "met")
    tried = met.join(_small(listed), "wid").groupBy("doc_id", "__key").agg(F.collect_list(F.struct("start", "window", "items")).alias("tried"))
    ids = materialize(met.select("doc_id", "__key").distinct(), "ids")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["__key"] == b["__key"])
    keyed = _keyed(docs)
    few = keyed.join(few_ids := _small(ids), same(keyed, few_ids), "left_semi").dropDuplicates(["doc_id", "__key"]).withColumn("w", words(F.col("text"))).drop("text")
    compared = few.join(tried, same(few, tried)).select(few["doc_id"], few["__key"], F.filter("tried", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["window"])) == c["window"]).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["window"]) - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"]))))
    return compared.where(F.size("hits") > 0).select("doc_id", "__key", covered.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))


def proximity_matches(postings: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """query, doc_id, __key, pos: places of a query's rarest term with every other term at most ``slop`` words away.

    queries has (query, terms); postings must index all of those terms. Positions are cut into stretches of slop words, so
    near pairs are found by an equal join on the stretch and its neighbours. A query of one term matches where that is.
    """
    each = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(counts, "term", "left").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "term")))
    need = ranked.groupBy("query").agg((F.count(F.lit(1)) - 1).alias("others"))
    at = postings.join(ranked.select("query", "term", "nth"), "term").withColumn("stretch", F.floor(F.col("pos") / max(1, slop)))
    first = at.where("nth = 1").select("query", "doc_id", "__key", "pos", "stretch").join(need, "query")
    around = first.select("query", F.col("doc_id").alias("d"), F.col("__key").alias("k"), F.col("pos").alias("p"), "others", F.explode(F.array(*(F.col("stretch") + x for x in (-1, 0, 1)))).alias("stretch"))
    near = around.join(at.where("nth > 1"), ["query", "stretch"]).where(F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("__key")) & (F.abs(F.col("p") - F.col("pos")) <= slop))
    met = near.groupBy("query", "d", "k", "p").agg(F.countDistinct("term").alias("found"), F.first("others").alias("others")).where("found = others")
    return met.select("query", F.col("d").alias("doc_id"), F.col("k").alias("__key"), F.col("p").alias("pos")).unionByName(first.where("others = 0").select("query", "doc_id", "__key", "pos"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A null or empty text has no words and is never hit; items without words are never found; an item of fewer words than
    WINDOW is one window. Repeated rows get the same result each. Other columns of docs and benchmark are not read.
    """
    hits = materialize(phrase_matches(docs, windows_of(benchmark)), "hits")
    few = _small(hits.withColumnRenamed("doc_id", "__id").withColumnRenamed("__key", "__hit"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("__key"), F.coalesce(F.regexp_count("text", F.lit(_RAW_WORDS)), F.lit(0)).cast("long").alias("n_words"))
    met = counted.join(few, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hit")), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return met.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, s)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
