"""Drawing few points of many: largest triangles, envelopes, strides, and small helpers of presentation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import envelope
from tidemark.sources.series import Series

#: Visible rows up to which values are fetched as they are; above, the envelope stands for them.
ENVELOPE_ROWS = 5_000_000


def lttb(x: np.ndarray, y: np.ndarray, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest-triangle-three-buckets: first, last and one point of each of n_out - 2 even buckets.

    A bucket's point makes the largest triangle with the one before and the mean of the next bucket; values that aren't finite
    never win over finite ones; a next bucket without any stands at the point before. Fewer than three points are never kept.
    """
    n, n_out = len(x), max(3, n_out)
    if n <= n_out:
        return x, y
    cuts = np.linspace(1, n - 1, n_out - 1).astype(np.int64)
    ok = np.isfinite(x) & np.isfinite(y)
    cx, cy, cn = (np.concatenate([[0.0], np.cumsum(np.where(ok, v, 0.0))]) for v in (x, y, np.ones(n)))
    picked = [0]
    for k in range(n_out - 2):
        a, b = cuts[k], cuts[k + 1]
        c, d = (b, cuts[k + 2]) if k < n_out - 3 else (n - 1, n)
        held = cn[d] - cn[c]
        px, py = x[picked[-1]], y[picked[-1]]
        if not (math.isfinite(px) and math.isfinite(py)):
            px, py = x[a], 0.0
        mx, my = ((cx[d] - cx[c]) / held, (cy[d] - cy[c]) / held) if held else (px, py)
        area = np.abs((px - mx) * (y[a:b] - py) - (px - x[a:b]) * (my - py))
        area[~np.isfinite(area)] = -1.0
        picked.append(a + int(area.argmax()))
    at = np.array([*picked, n - 1])
    return x[at], y[at]


def envelope_points(series: Series, name: str, bucket_rows: int = 8192) -> DataFrame:
    """t, v: the least and greatest value of each bucket at its first time, in order; buckets without values are left out."""
    cells = envelope(series, name, bucket_rows)
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("lo").alias("v")), F.struct(F.lit(1).alias("k"), F.col("hi").alias("v"))))
    return cells.select("bucket", "t", both.alias("p")).select("bucket", "t", "p.*").where(~F.isnan("v")).select("bucket", "t", "k", "v")


def drawn(series: Series, name: str, n_out: int, limit: int = ENVELOPE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """At most n_out points of a signal: its rows if few, their LTTB up to ``limit`` rows, LTTB of the envelope beyond.

    What comes to the driver is bounded by ``limit``: the envelope's buckets grow with the rows.
    """
    n = series.df.count()
    if n <= limit:
        got = series.df.select("_row", "_t", F.col(f"`{name}`").alias("v")).toPandas().sort_values("_row")
    else:
        got = envelope_points(series, name, max(8192, -(-2 * n // limit))).toPandas().sort_values(["bucket", "k"]).rename(columns={"t": "_t"})
    return lttb(got["_t"].to_numpy(), got["v"].to_numpy(), n_out)


def _hull(pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points can make the largest triangle on some base: the corners of their convex hull, and the first in order."""
    order = np.lexsort((pos, y, x))
    order = order[np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))]
    px, py = (x[order] - x[order[0]]).tolist(), (y[order] - y[order[0]]).tolist()
    keep = {int(pos.argmin())}
    for walk in (range(len(order)), range(len(order) - 1, -1, -1)):
        side: list[int] = []
        for k in walk:
            while len(side) > 1 and (px[side[-1]] - px[side[-2]]) * (py[k] - py[side[-2]]) <= (py[side[-1]] - py[side[-2]]) * (px[k] - px[side[-2]]):
                side.pop()
            side.append(k)
        keep.update(order[side].tolist())
    return np.array(sorted(keep))


def _corners(cuts: np.ndarray):
    """Of each bucket of positions that a partition has: its first point, the corners of its finite ones, their sums and number."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, ...]] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            pos, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "t", "v"))
            of = np.searchsorted(cuts, pos, "right") - 1
            for k in np.unique(of).tolist():
                p, a, b = pos[of == k], x[of == k], y[of == k]
                ok = np.isfinite(a) & np.isfinite(b)
                sums[k] = sums.get(k, np.zeros(3)) + np.array([a[ok].sum(), b[ok].sum(), ok.sum()])
                p, a, b = (np.concatenate(c) for c in zip(held[k], (p, a, b), strict=True)) if k in held else (p, a, b)
                ok = np.flatnonzero(np.isfinite(a) & np.isfinite(b))
                at = np.union1d([p.argmin()], ok[_hull(p[ok], a[ok], b[ok])] if len(ok) else ok).astype(np.int64)
                held[k] = (p[at], a[at], b[at])
        for k, (p, a, b) in held.items():
            total = np.zeros((3, len(p)))
            total[:, 0] = sums[k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), k)), *map(pa.array, (p, a, b, *total))], ["bucket", "pos", "t", "v", "st", "sv", "n"])

    return run


def lttb_of(series: Series, name: str, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """LTTB over all rows of a signal, however many, see ``lttb``.

    A triangle's area is linear in its third point, so a corner of its bucket's convex hull makes the largest one: only corners
    and sums come to the driver, a few dozen for each bucket and partition. Of points on one side of a hull only the ends count.
    """
    n_out = max(3, n_out)
    rows = series.df.select("_row", F.col("_t").alias("t"), F.col(f"`{name}`").alias("v"))
    lo, hi, n = rows.agg(F.min("_row"), F.max("_row"), F.count(F.lit(1))).first()
    if n <= n_out:
        got = rows.toPandas().sort_values("_row")
        return got["t"].to_numpy(), got["v"].to_numpy()
    if hi - lo + 1 == n:
        placed = rows.withColumn("pos", F.col("_row") - lo)
    else:  # rows are missing: places are counted by blocks
        block = F.floor(F.col("_row") / (1 << 20))
        blocks = rows.groupBy(block.alias("b")).count()
        before = F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        inside = F.row_number().over(Window.partitionBy("b").orderBy("_row"))
        placed = rows.withColumn("b", block).join(F.broadcast(blocks.select("b", F.coalesce(before, F.lit(0)).alias("base"))), "b").withColumn("pos", F.col("base") + inside - 1)
    cuts = np.concatenate([[0], np.linspace(1, n - 1, n_out - 1).astype(np.int64)])
    got = placed.select(F.col("pos").cast("long").alias("pos"), "t", "v").mapInArrow(_corners(cuts), "bucket long, pos long, t double, v double, st double, sv double, n double").toPandas().sort_values("pos")
    held = {k: g for k, g in got.groupby("bucket")}
    picked = [(held[0]["t"].iloc[0], held[0]["v"].iloc[0])]
    for k in range(1, n_out - 1):
        x, y = held[k]["t"].to_numpy(), held[k]["v"].to_numpy()
        st, sv, m = (math.fsum(held[k + 1][c]) for c in ("st", "sv", "n"))
        px, py = picked[-1]
        if not (math.isfinite(px) and math.isfinite(py)):
            px, py = x[0], 0.0
        mx, my = (st / m, sv / m) if m else (px, py)
        area = np.abs((px - mx) * (y - py) - (px - x) * (my - py))
        area[~np.isfinite(area)] = -1.0
        picked.append((x[area.argmax()], y[area.argmax()]))
    picked.append((held[n_out - 1]["t"].iloc[0], held[n_out - 1]["v"].iloc[0]))
    at = np.array(picked)
    return at[:, 0], at[:, 1]


def overview(series: Series, name: str, n_out: int, bucket_rows: int = 8192) -> DataFrame:
    """t, v of the navigator: the envelope, and the first and last row."""
    ends = series.df.agg(F.min_by(F.struct("_t", F.col(f"`{name}`").alias("v")), "_row").alias("a"), F.max_by(F.struct("_t", F.col(f"`{name}`").alias("v")), "_row").alias("b"))
    rows = series.df.count()
    points = envelope_points(series, name, max(bucket_rows, -(-2 * rows // max(1, n_out)))).select("t", "v")
    return points.unionByName(ends.select(F.explode(F.array("a", "b")).alias("e")).select(F.col("e._t").alias("t"), F.col("e.v").alias("v"))).distinct().orderBy("t", "v")


def normalize(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """[lo, hi] to [0, 1]; 0.5 for no width."""
    return (v - lo) / (hi - lo) if math.isfinite(hi - lo) and hi > lo else np.full(len(v), 0.5)


def nice_ticks(lo: float, hi: float, target: int = 5) -> list[float]:
    from tidemark.operators.grid import nice_step

    if not (math.isfinite(lo) and math.isfinite(hi) and hi > lo):
        return [lo]
    step = nice_step(hi - lo, target)
    inner = np.arange(np.ceil(lo / step - 1e-9), np.floor(hi / step + 1e-9) + 1)
    return (inner * step).tolist()


def project(points: np.ndarray, azimuth: float, elevation: float) -> np.ndarray:
    """Screen places (n x 2) of points in the unit cube, turned by azimuth and elevation in degrees."""
    a, e = np.radians([azimuth, elevation])
    c = points - 0.5
    right = c[:, 0] * np.cos(a) + c[:, 1] * np.sin(a)
    deep = -c[:, 0] * np.sin(a) + c[:, 1] * np.cos(a)
    return np.stack([right, c[:, 2] * np.cos(e) - deep * np.sin(e)], axis=1)


def pick_nearest(screen: np.ndarray, at: tuple[float, float], radius: float) -> int | None:
    d = ((screen - np.array(at)) ** 2).sum(axis=1) if len(screen) else np.zeros(0)
    return int(d.argmin()) if len(d) and d.min() <= radius**2 else None


#: Units of steps and rates with their sizes.
_STEPS = {"ns": 1e-9, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0}
_RATES = {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6}


def scaled(value: float, units: dict[str, float]) -> str:
    """Three significant digits in the largest unit that the value, once rounded so, fills; a dash for none or nothing."""
    if not (math.isfinite(value) and value > 0):
        return "\u2014"
    whole = float(f"{value:.3g}")
    unit = max((u for u in units if units[u] <= whole * (1 + 1e-12)), key=units.get, default=min(units, key=units.get))
    return f"{float(f'{value / units[unit]:.3g}'):g} {unit}"


def format_rate(hz: float) -> str:
    return scaled(hz, _RATES)


def format_interval(seconds: float) -> str:
    return scaled(seconds, _STEPS)
