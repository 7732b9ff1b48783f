"""A Parquet log as an ordered series: row numbers in file order, a time axis in seconds, signals as doubles."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime
from itertools import pairwise
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import NAN
from tidemark.plans.derived import dependency_order
from tidemark.plans.expression import Compiler, ExpressionError, Registry
from tidemark.plans.ordered import BLOCK_ROWS, add_columns


class NonNumericColumnError(TypeError):
    """The column holds no numbers, booleans or instants."""


_STAMPS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, _STAMPS)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, *_STAMPS))


def numeric(name: str, kind: T.DataType) -> Column:
    """A column as double, a null as NaN; stamps become epoch seconds, naive ones read as UTC (the session's zone)."""
    c = F.col(f"`{name}`")
    if is_datetime(kind):
        c = F.unix_micros(c.cast("timestamp")) / 1e6
    elif not is_numeric(kind):
        raise NonNumericColumnError(f"{name} is {kind.simpleString()}")
    return F.coalesce(c.cast("double"), F.lit(NAN))


def time_axis_candidates(schema: T.StructType) -> list[str]:
    """Columns that can be an axis: numbers, dates and instants, no booleans, texts or nested ones."""
    return [f.name for f in schema if is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)]


def resolve_aliases(columns: Iterable[str], aliases: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Alias to the first of its candidate columns that is there; a real column of that name wins; aliases don't chain."""
    there = set(columns)
    found = {}
    for alias, candidates in aliases.items():
        source = next((c for c in candidates if c in there), None)
        if source is not None and alias not in there:
            found[alias] = source
    return found


@dataclass(frozen=True)
class Series:
    """df has ``_row``, ``_t`` and one double column for each signal; raw columns stay behind until they are asked for."""

    df: DataFrame
    signals: tuple[str, ...]
    time_column: str
    source: DataFrame
    datetime_axis: bool

    def row_count(self) -> int:
        return self.df.count()

    def rows(self, start: int, end: int) -> Series:
        """Rows [start, end) in file order; a reversed or negative range is clamped."""
        return replace(self, df=self.df.where((F.col("_row") >= max(0, start)) & (F.col("_row") < max(0, start, end))))

    def between(self, lo: float, hi: float) -> Series:
        """Rows whose time lies in [lo, hi].

        The same bounds, widened to what the column's own type can hold, are put on the column as it is stored, where the scan
        can skip row groups by them.
        """
        kind = self.source.schema[self.time_column].dataType
        df = self.df
        if "__raw_t" in df.columns and lo <= hi:
            raw = F.col("__raw_t")
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                slack = 86_400 if isinstance(kind, T.DateType) else 1
                bound = lambda x: F.timestamp_micros(F.lit(int(max(-6e10, min(2.5e11, x)) * 1e6))).cast(kind)
                df = df.where((raw >= bound(lo - slack)) & (raw <= bound(hi + slack)))
            elif isinstance(kind, T.IntegralType):
                most = {"tinyint": 7, "smallint": 15, "int": 31}.get(kind.simpleString(), 63)
                bound = lambda x: F.lit(int(max(-(2**most), min(2**most - 1, x)))).cast(kind)
                df = df.where((raw >= bound(math.floor(lo) if math.isfinite(lo) else lo)) & (raw <= bound(math.ceil(hi) if math.isfinite(hi) else hi)))
            elif isinstance(kind, T.DoubleType):
                df = df.where((raw >= lo) & (raw <= hi))
        return replace(self, df=df.where(F.col("_t").between(lo, hi)))

    def select(self, *names: str) -> Series:
        return replace(self, df=self.df.select("_row", "_t", *(f"`{n}`" for n in names)), signals=tuple(names))

    def renamed(self, aliases: Mapping[str, Iterable[str]]) -> Series:
        """Adds a column for each alias that resolves."""
        found = resolve_aliases(self.signals, aliases)
        return replace(self, df=self.df.withColumns({a: F.col(f"`{s}`") for a, s in found.items()}), signals=(*self.signals, *found)) if found else self

    def derive(self, derived: Mapping[str, str], registry: Registry | None = None, block_rows: int = BLOCK_ROWS) -> Series:
        """With derived variables, each over the whole file; cut to a range afterwards. Later ones may read earlier ones."""
        taken = [n for n in derived if n in self.signals or n in ("_row", "_t")]
        if taken:
            raise ExpressionError(f"{taken[0]} is a column already")
        out, n_rows = self, None
        for k, name in enumerate(dependency_order(derived)):
            variables = {s: F.col(f"`{s}`") for s in out.signals} | {self.time_column: F.col("_t")}
            compiled = Compiler(variables, registry, f"__e{k}_").compile(derived[name])
            if n_rows is None and any(s.ordered for s in compiled.steps):
                n_rows = self.source.count()
            df = add_columns(out.df, {name: compiled}, n_rows or 0, block_rows)
            out = replace(out, df=df, signals=(*out.signals, name))
        return out


def _with_rows(df: DataFrame) -> DataFrame:
    """``_row``: position in file order; several files follow one another by path."""
    numbered = df.withColumns({"__file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    if len(df.inputFiles()) <= 1:
        return numbered.drop("__file")
    sizes = numbered.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__file", F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return numbered.join(F.broadcast(offsets), "__file").withColumn("_row", F.col("_row") + F.col("__base")).drop("__file", "__base")


def load_series(spark: SparkSession, path: str, time_column: str | None = None, signals: Iterable[str] | None = None, carry: Iterable[str] = ()) -> Series:
    """The log at path; the axis is the first column unless named, the signals all other numeric columns unless named.

    ``carry``: columns that go along as they are stored, named ``__raw0``, ``__raw1`` and so on.
    """
    source = spark.read.parquet(path)
    if len(source.columns) < 2:
        raise ValueError("a log needs two columns")
    axis = time_column or source.columns[0]
    kind = source.schema[axis].dataType
    wanted = list(signals) if signals is not None else [f.name for f in source.schema if f.name != axis and is_numeric(f.dataType)]
    df = _with_rows(source).select(
        "_row",
        numeric(axis, kind).alias("_t"),
        F.col(f"`{axis}`").alias("__raw_t"),
        *(numeric(n, source.schema[n].dataType).alias(n) for n in wanted),
        *(F.col(f"`{n}`").alias(f"__raw{k}") for k, n in enumerate(carry)),
    )
    return Series(df, tuple(wanted), axis, source, is_datetime(kind))


def schema_listing(df: DataFrame) -> list[tuple[str, str, bool, bool]]:
    """(name, type, is a stamp, can be computed with) of each column."""
    return [(f.name, f.dataType.simpleString(), is_datetime(f.dataType), is_numeric(f.dataType)) for f in df.schema]


def row_groups(path: str) -> list[dict]:
    """Footer of one local file: offset and rows of each row group, and bounds of each numeric column."""
    import pyarrow.parquet as pq

    meta, offset, out = pq.ParquetFile(path).metadata, 0, []
    for k in range(meta.num_row_groups):
        group = meta.row_group(k)
        stats = {}
        for c in range(group.num_columns):
            column = group.column(c)
            s = column.statistics
            if s is not None and s.has_min_max:
                stats[column.path_in_schema] = (s.min, s.max, s.null_count)
        out.append({"offset": offset, "rows": group.num_rows, "stats": stats})
        offset += group.num_rows
    return out


def zone_map(spark: SparkSession, path: str, name: str) -> DataFrame:
    """offset, rows, lo, hi, nulls of each row group of a local log, files following one another by path.

    Bounds are on the numeric scale of ``numeric``; where the footer has none, or one that isn't a number, they are null, which
    means unknown and not empty.
    """
    kind = spark.read.parquet(path).schema[name].dataType
    if not is_numeric(kind):
        raise NonNumericColumnError(f"{name} is {kind.simpleString()}")
    local = Path(path.removeprefix("file://"))
    files, out, base = sorted(local.glob("*.parquet")) if local.is_dir() else [local], [], 0
    for file in files:
        groups = row_groups(str(file))
        for g in groups:
            lo, hi, nulls = g["stats"].get(name, (None, None, None))
            known = [_on_scale(v) for v in (lo, hi)]
            usable = all(v is not None and not math.isnan(v) for v in known)
            out.append((base + g["offset"], g["rows"], *(known if usable else (None, None)), nulls))
        base += sum(g["rows"] for g in groups)
    return spark.createDataFrame(out, "offset long, rows long, lo double, hi double, nulls long")


def _on_scale(v: object) -> float | None:
    """A footer's bound as ``numeric`` reads the column."""
    if isinstance(v, datetime):
        return (v if v.tzinfo else v.replace(tzinfo=UTC)).timestamp()
    if isinstance(v, date):
        return (v - date(1970, 1, 1)).days * 86_400.0
    return None if v is None or isinstance(v, (str, bytes)) else float(v)


def ascending_by_groups(zones: DataFrame) -> bool:
    """Whether bounds never fall from one row group to the next, those unknown left out; order inside a group isn't seen."""
    known = [(r["lo"], r["hi"]) for r in zones.where("lo IS NOT NULL").orderBy("offset").collect()]
    return all(a[1] <= b[0] for a, b in pairwise(known))


class WindowReader:
    """Rows of a series by range, for one who looks at neighbouring ranges again and again.

    Blocks of ``block_rows`` rows are read at once, the ``most`` latest used are kept, so what is held is bounded.
    """

    def __init__(self, series: Series, names: Iterable[str], block_rows: int = 65_536, most: int = 32):
        self.series, self.names, self.block_rows, self.most = series.select(*names), list(names), block_rows, most
        self.n_rows = series.source.count()
        self.blocks: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()

    def _fetch(self, wanted: list[int]) -> None:
        """Blocks that aren't held, by one job."""
        lo, hi = wanted[0] * self.block_rows, (wanted[-1] + 1) * self.block_rows
        got = self.series.rows(lo, hi).df.toPandas().sort_values("_row")
        of = got["_row"].to_numpy() // self.block_rows
        for k in wanted:
            own = got[of == k]
            self.blocks[k] = {n: own[n].to_numpy() for n in self.names}

    def read(self, start: int, end: int) -> dict[str, np.ndarray]:
        """Values of rows [start, end), clamped to the log."""
        start, end = max(0, start), min(self.n_rows, end)
        if end <= start:
            return {n: np.zeros(0) for n in self.names}
        needed = list(range(start // self.block_rows, (end - 1) // self.block_rows + 1))
        if missing := [k for k in needed if k not in self.blocks]:
            self._fetch(missing)
        for k in needed:
            self.blocks.move_to_end(k)
        base = needed[0] * self.block_rows
        out = {n: np.concatenate([self.blocks[k][n] for k in needed])[start - base : end - base] for n in self.names}
        while len(self.blocks) > self.most:
            self.blocks.popitem(last=False)
        return out


def find_row_range(series: Series, lo: float, hi: float) -> tuple[int, int]:
    """[first row at or after lo, last row at or before hi + 1); rows without a finite time between them are inside."""
    got = series.df.agg(F.min(F.when(F.col("_t") >= lo, F.when(~F.isnan("_t"), F.col("_row")))).alias("a"), F.max(F.when(F.col("_t") <= hi, F.col("_row"))).alias("b")).first()
    return (got["a"], got["b"] + 1) if got["a"] is not None and got["b"] is not None and got["a"] <= got["b"] else (0, 0)


def drawing_range(series: Series, lo: float, hi: float) -> DataFrame:
    """Rows in [lo, hi] and one row on each side."""
    a, b = find_row_range(series, lo, hi)
    return series.rows(a - 1, b + 1).df


def strided(series: Series, target: int, start: int, end: int) -> DataFrame:
    """Every stride-th row of [start, end), counted from start; stride = max(1, rows // target)."""
    step = max(1, (end - start) // max(1, target))
    return series.rows(start, end).df.where((F.col("_row") - start) % step == 0)


def nearest_rows(series: Series, at: Iterable[float]) -> DataFrame:
    """x, _row, _t of the row nearest to each x on an ascending axis; the earlier of two as near.

    One pass: for each x the last row below and the first at or above, by max and min over the axis.
    """
    xs = sorted({float(x) for x in at})
    t = F.col("_t")
    aggs = []
    for k, x in enumerate(xs):
        aggs += [F.max(F.when(t < x, F.struct("_t", "_row"))).alias(f"b{k}"), F.min(F.when((t >= x) & ~F.isnan(t), F.struct("_t", "_row"))).alias(f"a{k}")]
    one = series.df.agg(*aggs) if aggs else series.df.limit(0)
    rows = []
    for k, x in enumerate(xs):
        below, above = F.col(f"b{k}"), F.col(f"a{k}")
        lower = above.isNull() | (below.isNotNull() & (F.lit(x) - below["_t"] <= above["_t"] - x))
        rows.append(F.struct(F.lit(x).alias("x"), F.when(lower, below).otherwise(above).alias("hit")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.x", F.col("r.hit._row").alias("_row"), F.col("r.hit._t").alias("_t")).where("_row IS NOT NULL")


def in_rectangle(series: Series, x: str, ys: Iterable[str], x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """_row of the rows inside closed ranges of x and any of ys; NaN is never inside."""
    inside = F.lit(False)
    for y in ys:
        inside = inside | F.col(f"`{y}`").between(*y_range)
    return series.df.where(F.col(f"`{x}`").between(*x_range) & inside).select("_row")


def without_rows(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """df but for the listed row numbers."""
    return df.join(excluded.select("_row"), "_row", "left_anti")
