"""Writing signals and bucket tables, one file's worth or many views' worth."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import finite
from tidemark.plans.derived import classify, needed
from tidemark.plans.expression import ExpressionError, Registry, referenced_names
from tidemark.sources.series import Series, find_row_range, load_series
from tidemark.sources.stores import View


#: Before a derived column's name: whether its finite value is lost as float32.
LOST = "__lost_"


class ExportError(ValueError):
    """An export that can't be done as asked."""


@dataclass(frozen=True)
class Plan:
    """Columns to write of one log: the axis, raw signals in their own types, derived ones as doubles or floats."""

    path: str
    time_column: str
    raw: tuple[str, ...]
    derived: Mapping[str, str]
    output: tuple[str, ...]
    x_range: tuple[float, float] | None = None
    range_axis: str | None = None
    registry: Registry = field(default_factory=Registry)
    float32: bool = False


def build_plan(spark: SparkSession, path: str, wanted: Iterable[str], derived: Mapping[str, str], time_column: str | None = None, registry: Registry | None = None, **more) -> Plan:
    """Each name once; of the derived variables only those wanted and what they need, in order; unknown names are an error."""
    columns = spark.read.parquet(path).columns
    axis = time_column or columns[0]
    output = tuple(dict.fromkeys(n for n in wanted if n != axis))
    unknown = [n for n in output if n not in columns and n not in derived]
    if unknown:
        raise ExportError(f"unknown: {', '.join(unknown)}")
    used = needed(derived, output)
    loose = {n for d in used for n in referenced_names(derived[d])} - set(columns) - set(derived)
    if loose:
        raise ExportError(f"unknown: {', '.join(sorted(loose))}")
    return Plan(path, axis, tuple(n for n in output if n in columns), {n: derived[n] for n in used}, output, registry=registry or Registry(), **more)


def view_problems(spark: SparkSession, view: View, registry: Registry | None = None) -> dict[str, str | None]:
    """Why each plotted or derived variable of a view can't be exported, or None."""
    columns = spark.read.parquet(view.parquet_path).columns
    out: dict[str, str | None] = {}
    for n in dict.fromkeys(n for p in view.plots for n in p):
        out[n] = None if n in columns or n in view.derived else "missing_column"
    return out | classify(view.derived, columns, view.time_column or columns[0], registry=registry)


def plan_from_view(spark: SparkSession, view: View, registry: Registry | None = None, time_column: str | None = None) -> tuple[Plan, dict[str, str]]:
    """(plan of all usable plotted and derived variables, the others and why). The range is on the view's own axis."""
    problems = view_problems(spark, view, registry)
    usable = [n for n, why in problems.items() if why is None]
    if not usable:
        raise ExportError("nothing in the view can be exported")
    axis = view.time_column or spark.read.parquet(view.parquet_path).columns[0]
    derived = {n: e for n, e in view.derived.items() if problems.get(n) is None}
    plan = build_plan(spark, view.parquet_path, usable, derived, time_column or axis, registry, x_range=view.x_range, range_axis=axis)
    return plan, {n: why for n, why in problems.items() if why}


def plan_frame(spark: SparkSession, plan: Plan) -> DataFrame:
    """The frame that a plan writes, with ``_row`` and, for each derived column as float32, whether a finite value is lost.

    Raw columns go along with those that are computed, so the log is read once and joined with nothing.
    """
    inputs = {n for e in plan.derived.values() for n in referenced_names(e)} - set(plan.derived) - {plan.time_column}
    kept = [plan.time_column, *plan.raw]
    series = load_series(spark, plan.path, plan.time_column, sorted(inputs), carry=kept)
    span = None
    if plan.x_range is not None:
        axis = series if plan.range_axis in (None, plan.time_column) else load_series(spark, plan.path, plan.range_axis, [])
        span = find_row_range(axis, *plan.x_range)
        if span[0] >= span[1]:
            raise ExportError("no row lies in the range")
    made = series.derive(plan.derived, plan.registry) if plan.derived else series
    frame = made.df.where((F.col("_row") >= span[0]) & (F.col("_row") < span[1])) if span else made.df
    of = {n: F.col(f"__raw{k}") for k, n in enumerate(kept)}
    lost = {}
    for n in plan.output:
        if n in plan.derived:
            wide = F.col(f"`{n}`")
            of[n] = wide.cast("float") if plan.float32 else wide
            if plan.float32:
                lost[f"{LOST}{n}"] = finite(wide) & ~finite(wide.cast("float").cast("double"))
    return frame.select("_row", of[plan.time_column].alias(plan.time_column), *(of[n].alias(n) for n in plan.output), *(c.alias(n) for n, c in lost.items()))


#: Bytes of a written part, about, and bounds of its rows.
PART_BYTES, PART_ROWS = 256 << 20, (65_536, 1_000_000)


def row_bytes(spark: SparkSession, plan: Plan) -> int:
    """Bytes of one row of a plan's output before compression: fixed widths, 32 for texts and nested values."""
    kinds = {f.name: f.dataType for f in spark.read.parquet(plan.path).schema}
    width = lambda kind: 32 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(kind.simpleString(), 8)
    raw = sum(width(kinds[n]) for n in (plan.time_column, *plan.raw))
    return raw + sum(n in plan.derived for n in plan.output) * (4 if plan.float32 else 8)


def estimate(spark: SparkSession, plan: Plan) -> dict[str, int]:
    """rows, bytes (uncompressed, so an upper bound) and part_rows of what a plan writes; rows in a range are counted."""
    one = row_bytes(spark, plan)
    axis = load_series(spark, plan.path, plan.range_axis or plan.time_column, [])
    span = find_row_range(axis, *plan.x_range) if plan.x_range is not None else (0, axis.source.count())
    return {"rows": span[1] - span[0], "bytes": (span[1] - span[0]) * one, "part_rows": min(max(PART_BYTES // one, PART_ROWS[0]), PART_ROWS[1])}


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def export_parquet(spark: SparkSession, plan: Plan, path: str, overwrite: bool = False) -> dict:
    """Write a plan in order of rows; returns rows and, for float32, how many finite values became infinite.

    Written beside and renamed, so a reader never sees half; with a sidecar ``_about.json``. The log itself is never written
    over, another path only if told.
    """
    files, there = _fs(spark, path)
    if there.toUri().getPath().rstrip("/") == _fs(spark, plan.path)[1].toUri().getPath().rstrip("/"):
        raise ExportError("the target is the log itself")
    if files.exists(there) and not overwrite:
        raise ExportError("the target exists")
    frame = plan_frame(spark, plan)
    part, aside = f"{path.rstrip('/')}.part", f"{path.rstrip('/')}.old"
    floats = [c for c in frame.columns if c.startswith(LOST)]
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`")).alias(c) for c in floats)]
    ordered = frame.repartitionByRange("_row").sortWithinPartitions("_row").observe(seen, *counts)
    ordered.drop("_row", *floats).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", PART_ROWS[1]).parquet(part)
    got = seen.get
    rows = got["rows"]
    old = _fs(spark, aside)[1]
    if files.exists(there):
        files.delete(old, True)
        files.rename(there, old)
    files.rename(_fs(spark, part)[1], there)
    files.delete(old, True)
    about = {"source": plan.path, "range": plan.x_range, "derived": dict(plan.derived), "functions": {n: f.body for n, f in plan.registry.functions.items()}, "tables": sorted(plan.registry.tables), "created": datetime.now(UTC).isoformat()}
    write_text(spark, f"{path.rstrip('/')}/_about.json", json.dumps(about))
    return {"rows": rows, "infinite": {c.removeprefix(LOST): got[c] for c in floats if got[c]}}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, there = _fs(spark, path)
    out = files.create(there, True)
    out.write(bytearray(text.encode()))
    out.close()


def export_many(spark: SparkSession, view: View, paths: Sequence[str], folder: str, registry: Registry | None = None, parallel: int = 2, stamp: str | None = None) -> list[dict]:
    """The view over each log, to <folder>/<log>_<view>_<stamp>[_n].parquet; a log that fails, fails alone.

    Never writes over anything; ``parallel`` logs at a time.
    """
    stamp = stamp or datetime.now().strftime("%Y%m%d_%H%M%S")
    taken: set[str] = set()
    jobs = []
    for path in paths:
        stem = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
        k, target = 1, f"{folder}/{stem}_{view.name}_{stamp}.parquet"
        while target in taken or _fs(spark, target)[0].exists(_fs(spark, target)[1]):
            k += 1
            target = f"{folder}/{stem}_{view.name}_{stamp}_{k}.parquet"
        taken.add(target)
        jobs.append((path, target))

    def one(job: tuple[str, str]) -> dict:
        path, target = job
        try:
            own = View(view.name, path, view.time_column, view.derived, view.plots, view.x_range)
            plan, skipped = plan_from_view(spark, own, registry)
            return {"source": path, "path": target, "skipped": skipped} | export_parquet(spark, plan, target)
        except (ExportError, ExpressionError, ValueError) as error:
            return {"source": path, "path": None, "error": str(error)}

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(one, jobs))


def wide_buckets(table: DataFrame, zone: str = "UTC") -> DataFrame:
    """window_start, window_end (wall clock), and value, _complete, _at of each variable; names that clash get _2, _3, ..."""
    names = sorted(r[0] for r in table.select("variable").distinct().collect())
    wall = lambda c: F.from_utc_timestamp(F.timestamp_micros((F.col(c) * 1e6).cast("long")), zone).cast("timestamp_ntz")
    labels = iter(bucket_labels(names))
    aggs = [F.first(F.when(F.col("variable") == n, F.col(c)), ignorenulls=True).alias(next(labels)) for n in names for c in ("value", "complete", "at")]
    kept = table.groupBy("bucket_start", "bucket_end").agg(*aggs) if aggs else table.select("bucket_start", "bucket_end").distinct()
    return kept.select(wall("bucket_start").alias("window_start"), wall("bucket_end").alias("window_end"), *(F.col(f"`{c}`") for c in bucket_labels(names)))


def bucket_labels(names: Sequence[str]) -> list[str]:
    """Labels of wide_buckets, in its order."""
    taken, out = {"window_start", "window_end"}, []
    for n in names:
        for suffix in ("", "_complete", "_at"):
            label, k = f"{n}{suffix}", 1
            while label in taken:
                k += 1
                label = f"{n}{suffix}_{k}"
            taken.add(label)
            out.append(label)
    return out


def write_buckets(spark: SparkSession, table: DataFrame, path: str, form: str = "parquet", about: Mapping | None = None) -> None:
    """A bucket or slot table as Parquet or CSV, with a sidecar."""
    to = table.coalesce(1).write.mode("errorifexists")
    if form == "csv":
        to.option("header", True).csv(path)
    else:
        to.parquet(path)
    write_text(spark, f"{path.rstrip('/')}/_about.json", json.dumps(about or {}))

