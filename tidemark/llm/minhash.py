"""Near duplicates by b-bit MinHash: bands find candidates, packed low bits estimate them, whole shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read
from tidemark.llm.words import HEAVY_SLICE_BYTES, Words, slices, text_array, word_hashes

SHINGLE = 5
SIMILARITY = 75
#: Bands and minima of each. A link at the least similarity is missed by all bands once in 200,000 times.
BANDS, ROWS = 32, 4
#: Low bits kept of each minimum, packed 16 to a 64-bit word.
BITS = 4
#: A class tries its likeliest lead if the collision-corrected estimate is this much. What is not tried then is left to the
#: second round, which knows no estimate.
LEAST_ESTIMATE = 0.55
#: Ids (8 bytes each) up to which a list of documents is broadcast; beyond it is shuffled.
BROADCAST_IDS = 1_000_000
#: Tests of one shingle that one task makes in the second round, about.
MEETINGS = 4_000_000
_HASHES = BANDS * ROWS
_PACKED = _HASHES * BITS // 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of each text in ascending order, starts of each text, n + 1).

    A-Z are lower-cased; words are runs of anything but white space; a text of fewer words than SHINGLE is one shingle, one
    without words has none.
    """
    words = Words(pc.ascii_lower(texts), lower=False)
    n, counts = len(texts), np.diff(words.starts)
    h = word_hashes(words.distinct)[words.codes]
    per = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    if not per.sum():
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    owner = np.repeat(np.arange(n), per)
    first = words.starts[owner] + np.arange(len(owner)) - np.concatenate([[0], np.cumsum(per)[:-1]])[owner]
    length = np.minimum(counts, SHINGLE)[owner]
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64)
        for k in range(SHINGLE):
            out = np.where(k < length, _mixed(out * _M2 + padded[first + k], _M1), out)
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])])
    return out[new], np.searchsorted(owner[new], np.arange(n + 1))


def minima(shingles: np.ndarray, starts: np.ndarray, seed: int = 7) -> np.ndarray:
    """_HASHES minima of each text with shingles, a row each."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), _HASHES), np.uint32)
    h = np.empty_like(x)
    for k in range(_HASHES):
        np.multiply(x, a[k], out=h)
        np.add(h, b[k], out=h)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Low BITS of each value, packed into _PACKED 64-bit words a row."""
    per = 64 // BITS
    grouped = low.reshape(len(low), _PACKED, per).astype(np.uint64)
    return np.bitwise_or.reduce(grouped << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal low bits, less those that are equal by chance."""
    apart = F.lit(0)
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    for k in range(_PACKED):
        x = F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))
        some = x
        for s in range(1, BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(x, s))
        apart = apart + F.bit_count(some.bitwiseAND(F.lit(ones)))
    chance = 1.0 / (1 << BITS)
    return (1 - apart / float(_HASHES) - chance) / (1 - chance)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in slices(batch, most=HEAVY_SLICE_BYTES):
                shingles, starts = shingle_sets(text_array(part))
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes)
                keys, packed = np.zeros((0, BANDS), np.uint64), np.zeros((0, _PACKED), np.uint64)
                both = np.zeros((part.num_rows, 2), np.uint64)
                if len(full):
                    low = minima(shingles, starts[full])
                    wide = low.astype(np.uint64).reshape(len(full), BANDS, ROWS)
                    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), BANDS))
                    for r in range(ROWS):
                        keys = _mixed(keys * _M2 + wide[:, :, r], _M1)
                    packed = pack(((low * np.uint32(2654435769)) >> np.uint32(32 - BITS)))
                    both[full, 0] = np.add.reduceat(_mixed(shingles, _M2), starts[full])
                    both[full, 1] = np.add.reduceat(_mixed(shingles + np.uint64(1), _M1), starts[full])
                lists = lambda flat, width: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, width, 0))]), pa.int32()), pa.array(flat.ravel().view(np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64)), lists(np.ascontiguousarray(keys), BANDS), lists(packed, _PACKED)], ["doc_id", "n_shingles", "h1", "h2", "bands", "bits"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a hash of the set), bands (band keys) and bits (packed signature) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_sketch, f"doc_id {kind}, n_shingles long, h1 long, h2 long, bands array<long>, bits array<long>")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=HEAVY_SLICE_BYTES):
            shingles, starts = shingle_sets(text_array(part))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(shingles.view(np.int64)))], ["id", "shingles"])


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles (hashes of the whole set), n (their number), of (a hash of the set) of the documents of the distinct ``ids``,
    equal rows once, as a table."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(few, "id", "left_semi").distinct()
    sets = texts.mapInArrow(_shingles, f"id {docs.schema['doc_id'].dataType.simpleString()}, shingles array<long>").where(F.size("shingles") > 0)
    return materialize(sets.select("*", F.size("shingles").cast("long").alias("n"), F.xxhash64("shingles").alias("of")), "shingles")


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose whole shingle sets have 100 x intersection >= SIMILARITY x union.

    Nothing is aggregated on top of the joins, so that Spark may split a lead that is in many pairs.
    """
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    met = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * met >= SIMILARITY * (F.size("sa") + F.size("sb") - met)).select("a", "b")


def least_common(union: Column) -> Column:
    """Shingles that two linked sets with that sum of sizes have in common at least: SIMILARITY / (100 + SIMILARITY) of it."""
    return F.ceil(SIMILARITY * union / (100 + SIMILARITY))


def prefix_pairs(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """The distinct pairs a < b of sets in different components (placed: id, component) that may be linked; none is left out.

    All shingles are put in one order, the rarest among these sets first. A link needs so many common shingles that the first
    common one stands early in both: each set is listed under the shingles that stand so early in it, and a pair meets only
    where enough shingles are left behind both places. Shingles that only one component has early are dropped at once, and of
    each of the others only sets outside its commonest component look for partners, so a group that is joined already is not
    spelt out in pairs. The sets of a shingle that very many have early meet in a square of tasks of about MEETINGS tests each.
    """
    one = materialize(sets.select("id", "of", "n", F.explode("shingles").alias("token")), "tokens")
    df = one.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rare = one.join(df, "token", "left").withColumn("at", F.row_number().over(Window.partitionBy("id", "of", "n").orderBy(F.coalesce("df", F.lit(1)), "token")) - 1)
    early = rare.where((F.col("df") > 1) & (F.col("n") - F.col("at") >= F.ceil(SIMILARITY * F.col("n") / 100)))
    early = materialize(early.select("token", "id", "n", "at").join(placed, "id"), "early")
    each = early.groupBy("token", "component").agg(F.count(F.lit(1)).alias("of"))
    main = each.groupBy("token").agg(F.max_by("component", F.struct("of", "component")).alias("main"), F.sum("of").alias("all"), F.max("of").alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    side = F.ceil(F.sqrt(F.col("all") * (F.col("all") - F.col("most")) / float(MEETINGS))).cast("int")
    known = materialize(early.join(main.select("token", "main", side.alias("side")), "token"), "early-mixed")
    outside = F.col("component") != F.col("main")
    own, other = F.pmod(F.xxhash64("id"), F.col("side")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    x = known.where(outside).select("token", own.alias("i"), other.alias("j"), F.col("id").alias("xi"), F.col("component").alias("xc"), F.col("n").alias("xn"), F.col("at").alias("xa"))
    y = known.select("token", other.alias("i"), own.alias("j"), F.col("id").alias("yi"), F.col("component").alias("yc"), F.col("n").alias("yn"), F.col("at").alias("ya"), outside.alias("yo"))
    enough = F.least(F.col("xn") - F.col("xa"), F.col("yn") - F.col("ya")) >= least_common(F.col("xn") + F.col("yn"))
    same = (x["token"] == y["token"]) & (x["i"] == y["i"]) & (x["j"] == y["j"])
    met = x.join(y, same & (F.col("xc") != F.col("yc")) & (~F.col("yo") | (F.col("xi") < F.col("yi"))) & enough)
    return met.select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of edges (a, b), by alternating large and small stars.

    Each pass writes its edges to the shared folder. Minima are aggregated before they meet the edges, so a hub is no group.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialize(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
        seen = mark
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = materialize(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts with equal shingle sets are one class from the start. In each bucket of a band every class is paired with the
    smallest, and of these pairs each class tries its likeliest by packed bits. The classes of buckets that are still in
    different components then meet by their rarest shingles (``prefix_pairs``, exact), and every such pair is confirmed. So no
    link among candidates is left out, and no group is spelt out in pairs that are joined already. Texts without words, null
    ones among them, are linked with nothing; rows that share a doc_id count as one document; a null doc_id is linked with
    nothing, its component is null and it is kept. doc_id may be of any type that can be ordered. Other columns are not read.
    """
    whole = materialize(sketches(docs), "sketches")
    some = whole.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["h1", "h2", "n_shingles"]
    classes = materialize(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    many = classes.where("rows > 1").drop("rows")
    owned = materialize(whole.select("doc_id", *key).join(many, key, "left").withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))), "owned")
    # a document of several texts joins the classes that these are in
    texts = owned.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id", "low")
    twins = owned.select("doc_id", "rep").join(texts, "doc_id").where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    single = some.join(many.select(*key), key, "left_anti").select(F.col("doc_id").alias("rep"), "bands", "bits")
    shared = some.join(many, key).where("doc_id = rep").select("rep", "bands", "bits").dropDuplicates(["rep", "bands"])
    reps = materialize(single.union(shared), "reps")
    rows = reps.select("rep", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead")
    buckets = materialize(rows.join(full, "key"), "buckets")
    bits = reps.select("rep", "bits")
    stars = buckets.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    known = stars.join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("xa")), "a").join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("xb")), "b")
    likely = known.select("a", "b", estimate(F.col("xa"), F.col("xb")).alias("near")).where(F.col("near") >= LEAST_ESTIMATE)
    best = materialize(likely.groupBy("b").agg(F.min_by("a", F.struct(-F.col("near"), F.col("a"))).alias("a")).select("a", "b"), "best")
    ids = lambda pairs: materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    links = confirmed(whole_sets(docs, ids(best)), best).union(twins)
    joined = materialize(components(materialize(links, "links")), "components")
    placed = buckets.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = materialize(placed.join(mixed, "key").select(F.col("rep").alias("id"), "component").distinct(), "open")
    sets = whole_sets(docs, open_.select("id"))
    more = materialize(prefix_pairs(sets, open_), "more")
    if more.count():
        joined = materialize(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(confirmed(sets, more))), "components")
    found = owned.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("rep").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= {SIMILARITY} * (x.n + y.n - met)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON r.reach = sym.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
