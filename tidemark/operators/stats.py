"""Statistics and diagnostics of signals and axes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import NAN, finite
from tidemark.sources.series import Series

#: Bins of one refinement step, and rows that may come to the driver at its end.
FINE_BINS, LAST_ROWS = 1 << 12, 200_000
#: Rows over which medians of intervals are taken, before the median of those (see time_order and auto_gap).
ORDER_CHUNK, GAP_CHUNK = 2_000_000, 1_000_000


def fine_bin(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Number of the equal bin of [lo, hi]; half the scale keeps huge ranges finite."""
    scale = bins / (hi / 2 - lo / 2)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(bins - 1.0), (v / 2 - lo / 2) * scale))).cast("int")


def order_statistics(df: DataFrame, v: Column, ranks: Sequence[int], lo: float, hi: float) -> dict[int, float]:
    """Exact values at 0-based ranks of the finite v of df, all in [lo, hi].

    Each pass counts FINE_BINS bins and goes on with the one that holds a rank, until few rows are left or all are equal.
    """
    open_, found = [(df.select(v.alias("v")).where(finite(F.col("v"))), lo, hi, {r: r for r in ranks})], {}
    while open_:
        rows, a, b, wanted = open_.pop()
        if a == b:
            found |= dict.fromkeys(wanted, a)
            continue
        bins = rows.groupBy(fine_bin(F.col("v"), a, b, FINE_BINS).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k").collect()
        ends = np.cumsum([r["n"] for r in bins])
        inside: dict[int, dict[int, int]] = {}
        for original, rank in wanted.items():
            k = int(np.searchsorted(ends, rank, "right"))
            inside.setdefault(k, {})[original] = rank - (int(ends[k - 1]) if k else 0)
        for k, own in inside.items():
            cell = rows.where(F.col("v").between(bins[k]["a"], bins[k]["b"]))
            if bins[k]["n"] <= LAST_ROWS and bins[k]["a"] < bins[k]["b"]:
                values = np.sort(cell.toArrow().column("v").to_numpy())
                found |= {o: float(values[r]) for o, r in own.items()}
            else:
                open_.append((cell, bins[k]["a"], bins[k]["b"], own))
    return found


def exact_median(df: DataFrame, v: Column, n: int, lo: float, hi: float) -> float:
    """Mean of the two middle values of the n finite v; NaN for none."""
    if not n:
        return NAN
    got = order_statistics(df, v, sorted({(n - 1) // 2, n // 2}), lo, hi)
    return got[(n - 1) // 2] / 2 + got[n // 2] / 2 if (n % 2 == 0) else got[n // 2]


def grouped_medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value (the exact median of v), n of rows with finite v; keys must be few (cells of a grid).

    Values are counted in FINE_BINS bins of each group's own range; only the bins that hold the middle ranks are looked into,
    and equal values there are counted together, so no task ever holds the values of a group.
    """
    spans = rows.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.count(F.lit(1)).alias("n"))
    share = (F.col("v") / 2 - F.col("__lo") / 2) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") / 2 - F.col("__lo") / 2).otherwise(F.lit(1.0))
    binned = rows.join(F.broadcast(spans), keys).withColumn("__bin", F.floor(F.least(F.lit(FINE_BINS - 1.0), share * FINE_BINS)).cast("int"))
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__in"), F.first("n").alias("n"))
    up = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ranks = lambda c: [F.floor((F.col(c) - 1) / 2), F.floor(F.col(c) / 2)]
    before = F.col("__upto") - F.col("__in")
    holds = [(before <= r) & (F.col("__upto") > r) for r in ranks("n")]
    middle = counts.withColumn("__upto", F.sum("__in").over(up)).where(holds[0] | holds[1]).select(*keys, "__bin", before.alias("__before"))
    tied = binned.join(F.broadcast(middle), [*keys, "__bin"]).groupBy(*keys, "__bin", "v").agg(F.count(F.lit(1)).alias("__in"), F.first("__before").alias("__before"), F.first("n").alias("n"))
    inner = Window.partitionBy(*keys, "__bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = tied.withColumn("__upto", F.col("__before") + F.sum("__in").over(inner))
    low, high = [F.max(F.when((before <= r) & (F.col("__upto") > r), F.col("v"))) for r in ranks("n")]
    return placed.groupBy(*keys).agg((low / 2 + high / 2).alias("value"), F.first("n").alias("n"))


def _moments(name: str) -> list[Column]:
    c = F.col(f"`{name}`")
    v = F.when(finite(c), c)
    return [F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]


STATS_SCHEMA = "variable string, count long, nan_count long, min double, max double, mean double, std double, median double"


def basic_stats(series: Series, names: Iterable[str] | None = None) -> DataFrame:
    """variable, count (all rows), nan_count (not finite), min, max, mean, std (population) and exact median of the finite."""
    names = list(names or series.signals)
    spark = series.df.sparkSession
    got = series.df.agg(F.count(F.lit(1)).alias("rows"), *(F.struct(*_moments(n)).alias(f"s{k}") for k, n in enumerate(names))).first()
    out = []
    for k, name in enumerate(names):
        s = got[f"s{k}"]
        median = exact_median(series.df, F.col(f"`{name}`"), s["n"], s["lo"], s["hi"])
        out.append((name, got["rows"], got["rows"] - s["n"], *(NAN if s[c] is None else s[c] for c in ("lo", "hi", "mean", "std")), median))
    return spark.createDataFrame(out, STATS_SCHEMA)


def bounds(series: Series, names: Iterable[str], empty: tuple[float, float] = (NAN, NAN)) -> DataFrame:
    """lo, hi over all finite values of the named signals."""
    names = list(names)
    values = [F.when(finite(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in names]
    lows, highs = ([f(v) for v in values] for f in (F.min, F.max))
    one = lambda f, xs: xs[0] if len(xs) == 1 else f(*xs)
    return series.df.agg(F.coalesce(one(F.least, lows), F.lit(empty[0])).alias("lo"), F.coalesce(one(F.greatest, highs), F.lit(empty[1])).alias("hi"))


def joint_bounds(series: Series, names: Iterable[str]) -> DataFrame:
    """n_valid, n_excluded and <name>_min, <name>_max over the rows in which all named signals are finite."""
    names = list(names)
    valid = F.lit(True)
    for n in names:
        valid = valid & finite(F.col(f"`{n}`"))
    each = [f(F.when(valid, F.col(f"`{n}`"))).alias(f"{n}_{s}") for n in names for f, s in ((F.min, "min"), (F.max, "max"))]
    return series.df.agg(F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_excluded"), *each)


def effective_rate(series: Series, name: str) -> DataFrame:
    """rate_hz: finite values over the time from the first to the last row; null for no time at all."""
    v = F.col(f"`{name}`")
    one = series.df.agg(F.count_if(finite(v)).alias("n"), F.min_by("_t", "_row").alias("a"), F.max_by("_t", "_row").alias("b"))
    width = F.col("b") - F.col("a")
    return one.select(F.when(width > 0, F.col("n") / F.when(width > 0, width).otherwise(F.lit(1.0))).alias("rate_hz"))


def _blocked_previous(df: DataFrame, valid: Column, rows: int = 1_000_000) -> DataFrame:
    """Rows with ``__prev``, the last valid (t, row) before each, without a window over all rows.

    Within blocks of row numbers by a window; the first valid row of a block takes the last one of the blocks before it, which
    are one row a block.
    """
    t = F.when(valid, F.struct("_t", "_row"))
    blocked = df.withColumn("__blk", F.floor(F.col("_row") / rows))
    inside = Window.partitionBy("__blk").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    tails = blocked.groupBy("__blk").agg(F.max_by(t, F.when(valid, F.col("_row"))).alias("__tail"))
    tails = tails.select("__blk", F.last("__tail", ignorenulls=True).over(Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    return blocked.withColumn("__in", F.last(t, ignorenulls=True).over(inside)).join(tails, "__blk", "left").withColumn("__prev", F.coalesce("__in", "__carry")).drop("__in", "__carry")


def time_order(series: Series, chunk: int = ORDER_CHUNK) -> DataFrame:
    """One row on the axis: n_rows, n_nonfinite, n_decreases, n_duplicates, first_bad_row, dt_median, dt_min, dt_max, ok,
    rate_hz, irregular.

    Steps are between consecutive finite stamps; dt_median is the median over chunks of row numbers of their median positive
    step (a step belongs to the later row's chunk); irregular: a step is over 1 % off the median.
    """
    valid = finite(F.col("_t"))
    rows = _blocked_previous(series.df.select("_row", "_t"), valid)
    d = F.when(valid & F.col("__prev").isNotNull(), F.col("_t") - F.col("__prev._t"))
    steps = rows.select("_row", valid.alias("valid"), d.alias("d"))
    bad = ~F.col("valid") | (F.col("d") <= 0)
    counts = steps.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("valid")).alias("n_nonfinite"), F.count_if(F.col("d") < 0).alias("n_decreases"), F.count_if(F.col("d") == 0).alias("n_duplicates"), F.min(F.when(bad, F.col("_row"))).alias("first_bad_row"), F.min(F.when(F.col("d") > 0, F.col("d"))).alias("dt_min"), F.max(F.when(F.col("d") > 0, F.col("d"))).alias("dt_max"))
    medians = steps.where("d > 0").groupBy(F.floor(F.col("_row") / chunk).alias("c")).agg(F.percentile("d", F.lit(0.5)).alias("m")).agg(F.percentile("m", F.lit(0.5)).alias("dt_median"))
    both = counts.join(medians, F.lit(True))
    off = F.greatest(F.col("dt_max") - F.col("dt_median"), F.col("dt_median") - F.col("dt_min")) > 0.01 * F.col("dt_median")
    return both.select("n_rows", "n_nonfinite", "n_decreases", "n_duplicates", "first_bad_row", "dt_median", "dt_min", "dt_max", ((F.col("n_nonfinite") + F.col("n_decreases") + F.col("n_duplicates")) == 0).alias("ok"), (1 / F.col("dt_median")).alias("rate_hz"), F.coalesce(off, F.lit(False)).alias("irregular"))


def sampling_report(series: Series) -> DataFrame:
    """One row: n_rows, dt_median, dt_min, dt_max, max_deviation (relative to the median), n_gaps, reason.

    reason: too_few (under 3 rows), not_finite, not_ascending, non_uniform (over 1 % off, or a step over 1.5 medians), else ok.
    """
    rows = _blocked_previous(series.df.select("_row", "_t"), F.lit(True))
    d = rows.select((F.col("_t") - F.col("__prev._t")).alias("d"), finite(F.col("_t")).alias("valid"))
    ok = finite(F.col("d"))
    known = d.agg(F.count_if(ok).alias("n"), F.min(F.when(ok, F.col("d"))).alias("lo"), F.max(F.when(ok, F.col("d"))).alias("hi")).first()
    middle = exact_median(d, F.col("d"), known["n"], known["lo"], known["hi"]) if known["n"] else None
    total = d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("valid")).alias("bad"), F.min("d").alias("dt_min"), F.max("d").alias("dt_max"), F.count_if(F.col("d") > F.lit(1.5) * F.lit(middle)).alias("n_gaps")).withColumn("dt_median", F.lit(middle).cast("double"))
    deviation = F.greatest(F.col("dt_max") - F.col("dt_median"), F.col("dt_median") - F.col("dt_min")) / F.when(F.col("dt_median") != 0, F.col("dt_median"))
    reason = F.when(F.col("n_rows") < 3, "too_few").when(F.col("bad") > 0, "not_finite").when(F.col("dt_min") <= 0, "not_ascending").when((deviation > 0.01) | (F.col("n_gaps") > 0), "non_uniform").otherwise("ok")
    return total.select("n_rows", "dt_median", "dt_min", "dt_max", deviation.alias("max_deviation"), "n_gaps", reason.alias("reason"))


def envelope(series: Series, name: str, bucket_rows: int = 8192) -> DataFrame:
    """bucket, t (of its first row), lo, hi: finite bounds of every bucket of rows; NaN for a bucket without finite values."""
    c = F.col(f"`{name}`")
    v = F.when(finite(c), c)
    return series.df.groupBy(F.floor(F.col("_row") / bucket_rows).cast("long").alias("bucket")).agg(F.min_by("_t", "_row").alias("t"), F.coalesce(F.min(v), F.lit(NAN)).alias("lo"), F.coalesce(F.max(v), F.lit(NAN)).alias("hi"))


def spectrum(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, amplitude |F| / n) of evenly sampled values; the interval is the median step, which must be positive."""
    n = len(y)
    if not n:
        return np.zeros(0), np.zeros(0)
    step = float(np.median(np.diff(x))) if n > 1 else 0.0
    if step <= 0:
        raise ValueError("the time axis doesn't ascend")
    return np.fft.rfftfreq(n, step), np.abs(np.fft.rfft(y)) / n


SPECTRUM_ROWS = 8_000_000


def spectrum_of(series: Series, name: str) -> DataFrame:
    """frequency, amplitude of a signal; refused for uneven sampling or over SPECTRUM_ROWS rows, as one task does it all."""
    report = sampling_report(series).first()
    if report["reason"] != "ok":
        raise ValueError(f"no spectrum: {report['reason']}")
    if report["n_rows"] > SPECTRUM_ROWS:
        raise ValueError(f"no spectrum of more than {SPECTRUM_ROWS} rows")

    def run(pdf):
        pdf = pdf.sort_values("_row")
        f, a = spectrum(pdf["_t"].to_numpy(), pdf["v"].to_numpy())
        return type(pdf)({"frequency": f, "amplitude": a})

    return series.df.select("_row", "_t", F.col(f"`{name}`").alias("v"), F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "frequency double, amplitude double")
