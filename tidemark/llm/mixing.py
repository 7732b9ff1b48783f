"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_WORDS, materialize, read

#: Weights of the sources in order, repeating; all targets together, and the most of one, as shares of the sizes.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
#: Words of a block.
BLOCK = 64
#: Rows whose order is found in one task: documents of a shuffled bucket, and slots of a run.
BUCKET_DOCS, RUN = 4096, 1 << 16
#: Equal cells of [0, 1) by which a slot's point finds its source.
CELLS = 4096
#: The golden ratio's fraction of 2^32, odd: multiples of it modulo 2^32 are the schedule's points.
GOLDEN = 2654435769


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    """docs and ``size``: words of the whole text, null 0."""
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(SPACE_WORDS)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, docs, source_size, target from rows of (source, size): one row a source.

    Sources are taken by code point, null last. A target is the smaller of MOST times the source's size and level x weight;
    the level is the one at which all targets add up, so whatever a full source leaves goes to the others by weight.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").cast("long").alias("source_size"))
    one = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(one) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    weighed = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST).withColumn("ratio", F.col("most") / F.col("weight"))
    everyone = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(everyone) * TOTAL - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("rest"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("share"),
    )
    # in order of ratio the full sources come first; what is left for the others by weight grows until the last full one is
    # taken out and falls from there on, so its largest value is the level
    level = F.max(F.col("rest") / F.col("share")).over(everyone)
    return left.withColumn("target", F.least("most", level * F.col("weight"))).select("source", "docs", "source_size", "target")


def _offsets(rows: DataFrame, keys: list[str], bucket: str, amount: Column, name: str) -> DataFrame:
    """Sum of amount over the earlier buckets of the same keys: a row for each key and bucket."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(amount).alias("__n"))
    return sums.select(*keys, bucket, F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(name))


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """slot, number of the source (``no``) and rank among the source's slots.

    Slot i has the point (i x GOLDEN mod 2^32) / 2^32; the source is the one whose stretch of the cumulative targets holds it.
    The stretches are laid over CELLS equal cells, so finding one is an equal join. Ranks are counted run by run.
    """
    stretches = plan.select("no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32)) / float(1 << 32)
    slots = plan.sparkSession.range(n_slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    owned = slots.join(stretches, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "no", F.floor(F.col("slot") / RUN).alias("run"))
    base = _offsets(owned, ["no"], "run", F.lit(1), "base")
    nth = F.row_number().over(Window.partitionBy("no", "run").orderBy("slot"))
    return owned.withColumn("nth", nth).join(base, ["no", "run"]).select("slot", "no", (F.col("base") + F.col("nth") - 1).alias("rank"))


def shuffled(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document with ``no`` and ``at``, the words before it in its source's shuffled stream.

    The order is that of md5 of the id, of the text's hash for a null one; ties are settled by id, size and text, equal rows may
    change places. A source is cut by the hash into buckets of about BUCKET_DOCS documents, which are ordered apart from each
    other.
    """
    keyed = sized.join(plan.select(F.col("source").alias("__source"), "no", "docs"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keyed = keyed.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("__key").cast("string"))).cast("binary")))
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / float(1 << 32)
    keyed = keyed.withColumn("bucket", F.floor(place * F.ceil(F.col("docs") / BUCKET_DOCS)))
    base = _offsets(keyed, ["no"], "bucket", F.col("size"), "base")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("no", "bucket").orderBy("h", "doc_id", "size", "__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumn("inside", inside).join(base, ["no", "bucket"]).withColumn("at", F.col("base") + F.col("inside")).drop("h", "bucket", "docs", "base", "inside")


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(each row of docs laid in its source's stream, the mixture, the plan of the sources)."""
    sized = materialize(with_size(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", F.xxhash64("text").alias("__key")), "sizes")
    goal = targets(sized)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").isNull(), "source")
    total = F.greatest(F.sum("target").over(whole), F.lit(1e-9))
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(order) == F.count(F.lit(1)).over(whole)
    plan = goal.select("*", F.row_number().over(order).alias("no"), (F.sum("target").over(whole) / BLOCK).alias("slots"), ((upto - F.col("target")) / total).alias("lo"), F.when(last, F.lit(1.0)).otherwise(upto / total).alias("hi"))
    plan = materialize(plan.withColumn("lo", F.round("lo", 12)).withColumn("hi", F.round("hi", 12)), "targets")
    first = plan.select("slots").first()
    slots = schedule(plan, int(round(first[0])) if first else 0)
    # the source's slot of rank r takes block r, again from the first on when all are taken, and never beyond two rounds
    blocks = plan.select("no", F.ceil(F.col("source_size") / BLOCK).alias("blocks"))
    taking = slots.join(blocks, "no").where((F.col("blocks") > 0) & (F.col("rank") < 2 * F.col("blocks"))).select("no", "slot", F.pmod("rank", "blocks").alias("block"))
    laid = shuffled(sized, plan)
    end = F.col("at") + F.col("size")
    pieces = laid.where(F.col("size") > 0).select("no", "source", "doc_id", "__key", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    lo, hi = F.greatest("at", F.col("block") * BLOCK) - F.col("at"), F.least(end, (F.col("block") + 1) * BLOCK) - F.col("at")
    mixture = pieces.join(taking, ["no", "block"]).select("slot", "no", "source", "block", "doc_id", "__key", "at", lo.alias("first_word"), hi.alias("end_word"))
    return laid, mixture, plan


def mixture(docs: DataFrame) -> DataFrame:
    """slot, source, block, doc_id, __key (a hash of the text), first_word, end_word: the mix itself, not yet in order.

    In order of slot and, within a slot, of the row's place in the stream (``at``), the rows are the interleaved stream: each
    stands for the words [first_word, end_word) of a document. A slot is one block of BLOCK words of its source.
    """
    return _planned(docs)[1].drop("no")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and source and __key (a hash of the text), for every row of docs.

    taken counts the words of a document in ``mixture``. Blocks are BLOCK words of a source's stream of shuffled documents; the
    number of slots is the sum of targets in blocks. Empty and null texts have size 0 and taken 0, a source without words
    target 0; no rows give no rows; repeated rows are mixed each. Other columns of docs are not read.
    """
    laid, mixed, plan = _planned(docs)
    # words before a document never repeat in its source unless its size is 0
    taken = mixed.groupBy("no", "at").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("taken"))
    found = laid.join(taken, ["no", "at"], "left").withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return found.join(plan.select("no", "source_size", "target"), "no").select("doc_id", "size", "source_size", "target", "taken", "source", "__key")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix for DuckDB: slots by the same points, then closed form, as ranks of a source are 0, 1, 2, ...
OP6_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source),
w AS (SELECT *, (CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size * {MOST}::DOUBLE AS most FROM per),
r AS (SELECT *, (sum(source_size) OVER () * {TOTAL}::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(most, weight * max(level) OVER ()) AS target FROM r),
p AS (SELECT *, round((sum(target) OVER o - target) / sum(target) OVER (), 12) AS lo, CASE WHEN no = max(no) OVER () THEN 1.0 ELSE round((sum(target) OVER o) / sum(target) OVER (), 12) END AS hi
      FROM t WINDOW o AS (ORDER BY no ROWS UNBOUNDED PRECEDING)),
slots AS (SELECT ((i % 2147483648) * {GOLDEN}) % 4294967296 / 4294967296.0::DOUBLE AS u FROM range((SELECT round(sum(target) / {BLOCK})::BIGINT FROM t)) s(i)),
n AS (SELECT no, count(*) AS k FROM slots JOIN p ON u >= lo AND u < hi GROUP BY no),
q AS (SELECT p.*, coalesce(k, 0) AS k, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM p LEFT JOIN n USING (no)),
laid AS (SELECT doc_id, size, no, source_size, target, k, blocks, coalesce(sum(size) OVER (PARTITION BY no ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
         FROM sized JOIN q ON sized.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE CASE WHEN k >= 2 * blocks THEN 2 * size ELSE (k // blocks) * size + greatest(0, least(pos + size, (k % blocks) * {BLOCK}) - pos) END END::BIGINT AS taken
FROM laid
"""
