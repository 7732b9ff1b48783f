"""XY and XYZ clouds: bounds, thinning, density."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import NAN, finite
from tidemark.sources.series import Series

SCATTER_LIMIT, XYZ_LIMIT, DENSITY_BINS = 200_000, 500_000, 256
INDEX_BLOCK = 1 << 20


def _valid(*names: str) -> Column:
    met = F.lit(True)
    for n in names:
        met = met & finite(F.col(f"`{n}`"))
    return met


def indexed(df: DataFrame, block: int = INDEX_BLOCK) -> DataFrame:
    """df with ``_i``, its rows' numbers in order of ``_row``: counted by block, so no task sees all rows."""
    blocked = df.withColumn("__blk", F.floor(F.col("_row") / block))
    sizes = blocked.groupBy("__blk").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__blk", F.coalesce(F.sum("__n").over(Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("__blk").orderBy("_row"))
    return blocked.withColumn("__nth", nth).join(base, "__blk").withColumn("_i", F.col("__base") + F.col("__nth") - 1).drop("__blk", "__nth", "__base")


def effective_color(color: str, n_ys: int, z: str | None) -> str:
    """z needs one y and a z, time needs one y; else each y has its own colour."""
    return color if (color == "z" and n_ys == 1 and z) or (color == "time" and n_ys == 1) else "series"


def xy_bounds(series: Series, x: str, ys: Sequence[str], z: str | None = None) -> DataFrame:
    """variable, n_valid, n_excluded, x_min, x_max, y_min, y_max of each y: rows in which x, y (and z) are finite."""
    parts = []
    for k, y in enumerate(ys):
        met = _valid(x, y, *([z] if z else []))
        xv, yv = F.when(met, F.col(f"`{x}`")), F.when(met, F.col(f"`{y}`"))
        parts.append(F.struct(F.lit(y).alias("variable"), F.count_if(met).alias("n_valid"), F.count_if(~met).alias("n_excluded"), F.min(xv).alias("x_min"), F.max(xv).alias("x_max"), F.min(yv).alias("y_min"), F.max(yv).alias("y_max")).alias(f"p{k}"))
    one = series.df.agg(*parts)
    return one.select(F.inline(F.array(*(F.col(f"p{k}") for k in range(len(ys))))))


def xy_scatter(series: Series, x: str, ys: Sequence[str], z: str | None = None, limit: int = SCATTER_LIMIT) -> DataFrame:
    """variable, _row, _t, x, y, z: every stride-th valid row of each y, so that about ``limit`` points are shared by share."""
    extra = [z] if z else []
    counts = series.df.agg(*(F.count_if(_valid(x, y, *extra)).alias(f"n{k}") for k, y in enumerate(ys))).first()
    total = sum(counts)
    out = None
    for k, y in enumerate(ys):
        n = counts[k]
        stride = -(-n // max(1, limit * n // max(1, total))) if n else 1
        rows = series.df.where(_valid(x, y, *extra)).select(F.lit(y).alias("variable"), "_row", "_t", F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"), (F.col(f"`{z}`") if z else F.lit(None).cast("double")).alias("z"))
        part = indexed(rows).where(F.col("_i") % stride == 0).drop("_i") if stride > 1 else rows
        out = part if out is None else out.unionByName(part)
    return out


def is_density(n_valid: int, limit: int = SCATTER_LIMIT) -> bool:
    """Whether a cloud of so many points is shown by its density."""
    return n_valid > limit


def even_bin(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal bins of [lo, hi]; the last is closed."""
    width = hi - lo
    return F.floor(F.greatest(F.lit(0.0), F.least((v - lo) * bins / width, F.lit(bins - 1.0)))).cast("int")


def xy_density(series: Series, x: str, ys: Sequence[str], z: str | None = None, bins: int = DENSITY_BINS) -> DataFrame:
    """ix, iy, n and z_mean of each cell that holds a point, over the common range of all ys; all ys are added up."""
    one = xy_bounds(series, x, ys, z).agg(F.min("x_min"), F.max("x_max"), F.min("y_min"), F.max("y_max")).first()
    if one[0] is None:
        return series.df.sparkSession.createDataFrame([], "ix int, iy int, n long, z_mean double")
    widen = lambda a, b: (a - 0.5, b + 0.5) if a == b else (a, b)
    (xa, xb), (ya, yb) = widen(one[0], one[1]), widen(one[2], one[3])
    extra = [z] if z else []
    points = series.df.select(F.explode(F.array(*(F.when(_valid(x, y, *extra), F.struct(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"), (F.col(f"`{z}`") if z else F.lit(NAN)).alias("z"))) for y in ys))).alias("p")).where("p IS NOT NULL").select("p.*")
    return points.groupBy(even_bin(F.col("x"), xa, xb, bins).alias("ix"), even_bin(F.col("y"), ya, yb, bins).alias("iy")).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z_mean"))


def xyz_points(series: Series, x: str, y: str, z: str, limit: int = XYZ_LIMIT) -> DataFrame:
    """_row, _t, x, y, z of jointly finite rows, every ceil(n / limit)-th of them."""
    rows = series.df.where(_valid(x, y, z)).select("_row", "_t", *(F.col(f"`{n}`").alias(a) for n, a in ((x, "x"), (y, "y"), (z, "z"))))
    n = rows.count()
    stride = -(-n // limit) if n > limit else 1
    return indexed(rows).where(F.col("_i") % stride == 0).drop("_i") if stride > 1 else rows


def nearest_point(points: DataFrame, x: float, y: float, pixel: tuple[float, float], radius: float = 6.0) -> DataFrame:
    """The point of (x, y, ...) nearest to a place on the screen, within ``radius`` pixels of pixel = (width, height) units."""
    d2 = F.pow((F.col("x") - x) / pixel[0], F.lit(2)) + F.pow((F.col("y") - y) / pixel[1], F.lit(2))
    return points.withColumn("d2", d2).where(F.col("d2") <= radius**2).orderBy("d2", "_row").limit(1).drop("d2")


def value_range(values: np.ndarray) -> tuple[float, float] | None:
    """Least and greatest finite number of a lookup table, None if it has none."""
    known = np.asarray(values, float)
    known = known[np.isfinite(known)]
    return (float(known.min()), float(known.max())) if len(known) else None
