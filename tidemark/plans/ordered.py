"""Ordered windows without one task for all rows: blocks of rows with a bounded halo.

A value that looks ``before`` rows back and ``after`` rows ahead needs, in a block of rows, only so many rows of its
neighbours. Those rows are copied into the blocks, windows run by block, and the copies are dropped again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.expression import Compiled

BLOCK_ROWS = 1_000_000


def with_halo(df: DataFrame, before: int, after: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(df with ``__blk`` and the halo's copies, rows of a block); a block has ten halos at least."""
    rows = max(block_rows, 10 * (before + after), 1)
    blk = lambda shift: F.floor((F.col("_row") + shift) / rows).cast("long")
    blocks = F.array_distinct(F.array(blk(0), blk(before), blk(-after)))
    return df.withColumn("__blk", F.explode(blocks)).where("__blk >= 0"), rows


def add_columns(df: DataFrame, wanted: dict[str, Compiled], n_rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df (with ``_row``) and the compiled columns, in the order given."""
    before, after = (max((c.margin[k] for c in wanted.values()), default=0) for k in (0, 1))
    steps = [s for c in wanted.values() for s in c.steps]
    columns = df.columns
    ordered = any(s.ordered for s in steps)
    window = None
    if ordered:
        df, rows = with_halo(df, before, after, block_rows)
        window = Window.partitionBy("__blk").orderBy("_row")
    for step in steps:
        df = df.withColumn(step.name, step.make(window, n_rows))
    if ordered:
        df = df.where(F.col("__blk") == F.floor(F.col("_row") / rows))
    kept = [F.col(f"`{c}`") for c in columns if c not in wanted]
    return df.select(*kept, *(c.value.col().cast("double").alias(name) for name, c in wanted.items()))
