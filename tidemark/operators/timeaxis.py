"""Durations, gaps, bucket edges and time filters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from itertools import count, islice
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import finite
from tidemark.operators.stats import GAP_CHUNK
from tidemark.sources.series import Series

DAY = 86_400
MAX_BUCKETS = 1_000_000
EPOCH_DAY = date(1970, 1, 1)
#: The weekday of day 0, Monday 0.
EPOCH_WEEKDAY = EPOCH_DAY.weekday()
#: Rows of a block in which neighbours are found by a window; what crosses a block's end is one row for each block.
HALO_ROWS = 1 << 18


class HistogramError(ValueError):
    """A refusal with a code."""

    def __init__(self, code: str, **info: float):
        super().__init__(code)
        self.code, self.info = code, info


def validate_bucket(length: float) -> None:
    """At most a day and a divisor of it, or whole days."""
    if not (math.isfinite(length) and length > 0):
        raise HistogramError("bad_bucket")
    if length <= DAY:
        if abs(DAY / length - round(DAY / length)) > 1e-9:
            raise HistogramError("bucket_not_divisor")
    elif abs(length / DAY - round(length / DAY)) > 1e-9:
        raise HistogramError("bucket_not_days")


def validate_two_stage(stage1: float, bucket: float) -> None:
    validate_bucket(bucket)
    if not (math.isfinite(stage1) and 0 < stage1 <= DAY) or abs(DAY / stage1 - round(DAY / stage1)) > 1e-9:
        raise HistogramError("stage1_not_divisor")
    if stage1 > bucket or abs(bucket / stage1 - round(bucket / stage1)) > 1e-9:
        raise HistogramError("stage1_not_in_bucket")


@dataclass(frozen=True)
class Zone:
    """Where local days begin. None: a numeric axis, whose day 0 begins at 0 and which has no weekdays."""

    name: str | None = "UTC"

    @property
    def uniform(self) -> bool:
        return self.name in (None, "UTC")

    def stamp(self, day: date, seconds: float) -> float:
        """Epoch seconds of a local wall time; ``seconds`` may be beyond a day."""
        if self.uniform:
            return (day - EPOCH_DAY).days * DAY + seconds
        wall = datetime(day.year, day.month, day.day) + timedelta(seconds=seconds)
        return wall.replace(tzinfo=ZoneInfo(self.name)).timestamp()

    def wall(self, t: float) -> tuple[date, float]:
        """(local day, seconds after its midnight)."""
        if self.uniform:
            n = math.floor(t / DAY)
            return EPOCH_DAY + timedelta(days=n), t - n * DAY
        local = datetime.fromtimestamp(t, ZoneInfo(self.name))
        return local.date(), local.hour * 3600 + local.minute * 60 + local.second + local.microsecond / 1e6

    def spells(self, t0: float, t1: float) -> list[tuple[float, float, float]]:
        """(start, end, seconds ahead of UTC) of the stretches of [t0, t1] between the zone's own changes of offset."""
        if self.uniform:
            return [(t0, t1, 0.0)]
        instant = SparkSession.active()._jvm.java.time.Instant
        rules = SparkSession.active()._jvm.java.time.ZoneId.of(self.name).getRules()
        out, at = [], t0
        ahead = rules.getOffset(instant.ofEpochSecond(math.floor(t0))).getTotalSeconds()
        change = rules.nextTransition(instant.ofEpochSecond(math.floor(t0)))
        while change is not None and (when := change.getInstant().getEpochSecond()) < t1:
            out.append((at, float(when), float(ahead)))
            at, ahead = float(when), change.getOffsetAfter().getTotalSeconds()
            change = rules.nextTransition(change.getInstant())
        return [*out, (at, t1, float(ahead))]

    def days(self, t: float, second: float) -> Iterator[float]:
        """Beginnings, at ``second`` of the wall clock, of the local day that holds t and of every day after it."""
        around = (self.wall(t)[0] + timedelta(days=k) for k in (1, 0, -1, -2))
        day = next(d for d in around if self.stamp(d, second) <= t)
        return (self.stamp(day + timedelta(days=k), second) for k in count())


def bucket_edges(t0: float, t1: float, length: float, origin: float, zone: Zone) -> list[float]:
    """Ascending edges from the local day (begun at ``origin``) that holds t0 until past t1.

    Buckets of up to a day tile each local day from its start, the last one short on a day of 23 hours; longer ones count
    calendar days.
    """
    validate_bucket(length)
    expected = (max(0.0, t1 - t0) + 2 * DAY) / length
    if expected > MAX_BUCKETS:
        raise HistogramError("too_many_buckets", estimate=expected)
    every = islice(zone.days(t0, origin), 0, None, max(1, round(length / DAY)))
    edges = [next(every)]
    for end in every:
        if length < DAY:
            begun = edges[-1]
            tiles = begun + length * np.arange(1, math.ceil(DAY / length) * 2)
            edges += tiles[tiles < end - 1e-9 * length].tolist()
        edges.append(end)
        if end > t1:
            return edges


@dataclass(frozen=True)
class TimeFilter:
    """Seconds of the local day [start, end); beyond midnight if start > end, a whole day if equal; weekdays (Monday 0) of the
    day on which the window starts, None for all."""

    start: float = 0.0
    end: float = 0.0
    weekdays: frozenset[int] | None = None


def target_intervals(wanted: TimeFilter, t0: float, t1: float, zone: Zone) -> list[tuple[float, float]]:
    """Merged half-open intervals of [t0, t1] in which the wall clock is inside the filter."""
    if wanted.weekdays is not None and not wanted.weekdays:
        raise HistogramError("no_weekdays")
    length = (wanted.end - wanted.start) % DAY or DAY
    found = []
    for begun, ended, ahead in zone.spells(t0, t1):
        # inside a spell the wall clock is the real one plus a constant, so windows are plain arithmetic on day numbers; hours
        # that a change leaves out are in no spell, hours that it repeats are in two
        day = np.arange(math.floor((begun + ahead - wanted.start - length) / DAY), math.floor((ended + ahead) / DAY) + 1)
        if zone.name is not None and wanted.weekdays is not None:
            day = day[np.isin((day + EPOCH_WEEKDAY) % 7, list(wanted.weekdays))]
        start = np.maximum(begun, day * float(DAY) + wanted.start - ahead)
        end = np.minimum(ended, day * float(DAY) + wanted.start + length - ahead)
        found.append(np.stack([start, end])[:, start < end])
    start, end = np.concatenate(found, axis=1)
    reach = np.concatenate([[-math.inf], np.maximum.accumulate(end)])[:-1]
    first = np.flatnonzero(start > reach)
    return list(zip(start[first].tolist(), np.maximum.reduceat(end, first).tolist() if len(first) else [], strict=True))


def interval_frame(spark: SparkSession, intervals: Sequence[tuple[float, float]], cell: float, names: tuple[str, str, str]) -> DataFrame:
    """One row for each interval and cell of ``cell`` seconds that it touches: id, start, end, ``__first``, ``__cell``."""
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(intervals)]
    df = spark.createDataFrame(rows, f"{names[0]} long, {names[1]} double, {names[2]} double")
    first = F.floor(F.col(names[1]) / cell)
    return df.withColumn("__first", first).withColumn("__cell", F.explode(F.sequence(first, F.floor(F.col(names[2]) / cell))))


def join_intervals(rows: DataFrame, start: Column, end: Column, intervals: DataFrame, cell: float, names: tuple[str, str, str]) -> DataFrame:
    """rows x the intervals that [start, end) touches or that hold start, by an equal join on cells of time."""
    first = F.floor(start / cell)
    spread = rows.withColumn("__a", start).withColumn("__b", end).withColumn("__f", first).withColumn("__cell", F.explode(F.sequence(first, F.floor(end / cell))))
    met = spread.join(intervals, "__cell").where(F.col("__cell") == F.greatest("__f", "__first"))
    touch = ((F.col("__a") < F.col(names[2])) & (F.col("__b") > F.col(names[1]))) | ((F.col("__a") >= F.col(names[1])) & (F.col("__a") < F.col(names[2])))
    return met.where(touch).drop("__a", "__b", "__f", "__first", "__cell")


def neighbours(df: DataFrame, rows: int = HALO_ROWS) -> DataFrame:
    """df with ``__next``, the following row's time (null for the last), and ``__past``, the largest finite time before.

    Found by one window inside blocks of row numbers; what comes from other blocks is one row for each block.
    """
    blocked = df.withColumn("__blk", F.floor(F.col("_row") / rows))
    known = F.when(finite(F.col("_t")), F.col("_t"))
    order = Window.orderBy("__blk")
    ends = blocked.groupBy("__blk").agg(F.min_by(F.struct("_t"), "_row").alias("head"), F.max(known).alias("top"))
    ends = ends.select("__blk", F.lead("head").over(order).alias("__head"), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__top"))
    inside = Window.partitionBy("__blk").orderBy("_row")
    near = blocked.withColumns({"__lead": F.lead(F.struct("_t")).over(inside), "__seen": F.max(known).over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    met = near.join(ends, "__blk", "left")
    return met.withColumns({"__next": F.coalesce("__lead", "__head")["_t"], "__past": F.greatest("__seen", "__top")}).drop("__lead", "__head", "__seen", "__top", "__blk")


def durations(df: DataFrame) -> DataFrame:
    """df (a range of rows) with ``_w``: seconds to the next row, 0 for the last row and where that isn't positive and finite;
    and ``__past``."""
    d = F.col("__next") - F.col("_t")
    return neighbours(df).withColumn("_w", F.when(d.isNotNull() & finite(d) & (d > 0), d).otherwise(F.lit(0.0))).drop("__next")


@dataclass(frozen=True)
class Weights:
    """df: the rows with ``_w``, 0 beyond the gap, and ``_gap`` for those; gap in seconds; lo, hi: finite times, None for none."""

    df: DataFrame
    gap: float
    lo: float | None
    hi: float | None


def time_weights(series: Series, gap: float | str | None = "auto") -> Weights:
    """Row durations under a gap rule.

    One pass over the axis finds what has to be known before: whether it ever falls below an earlier finite time (refused),
    and for "auto" 5 times the median over chunks of GAP_CHUNK rows of their median positive step, infinite if there is none.
    A step belongs to the earlier row's chunk; chunks count from the first row of the range.
    """
    t = F.col("_t")
    ok = finite(t)
    lo, hi, first = series.df.agg(F.min(F.when(ok, t)), F.max(F.when(ok, t)), F.min("_row")).first()
    axis = durations(series.df.select("_row", "_t"))
    chunk = F.floor((F.col("_row") - F.lit(first or 0)) / GAP_CHUNK)
    each = axis.groupBy(chunk.alias("c")).agg(F.bool_or(ok & (t < F.col("__past"))).alias("back"), F.percentile(F.when(F.col("_w") > 0, F.col("_w")), F.lit(0.5)).alias("m"))
    seen = each.agg(F.bool_or("back").alias("back"), F.percentile("m", F.lit(0.5)).alias("m")).first()
    if seen["back"]:
        raise HistogramError("time_not_ascending")
    limit = math.inf if gap is None or gap == "auto" and seen["m"] is None else 5 * seen["m"] if gap == "auto" else float(gap)
    long_ = F.col("_w") > limit
    held = durations(series.df).drop("__past")
    return Weights(held.withColumns({"_gap": long_ & ok, "_w": F.when(long_, F.lit(0.0)).otherwise(F.col("_w"))}), limit, lo, hi)
