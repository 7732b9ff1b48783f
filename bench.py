"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and a few over a log of LONG_ROWS rows of its own; prints
one line of JSON. ``value`` adds up the headline queries alone."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HEADLINE = ["stats_range", "stats_derived", "expr_arith", "expr_cond", "map_bilinear", "rolling_mean", "time_order", "envelope", "hist_rows", "hist_time", "bucket_integral", "bucket_max", "two_stage", "time_of_day", "xy_density", "grid_mean", "grid_time", "export_view"]
ON_LINES = {"expr_arith", "expr_cond", "map_bilinear", "xy_density", "grid_mean"}
#: Runs of each query; the best counts, so that compiling and file caches don't.
RUNS = 2
LONG_ROWS = 10_000_000


def best_of(make) -> float:
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def long_log(spark, folder: str) -> str:
    """An evenly sampled log: time and four signals."""
    from pyspark.sql import functions as F

    r = F.col("id").cast("double")
    signals = {"a": F.sin(r / 1000), "b": F.cos(r / 1000) + 10, "c": r % 977, "d": F.rand(1)}
    rows = spark.range(0, LONG_ROWS, 1, 8).select(F.timestamp_micros(F.col("id") * 10_000).alias("time"), *(v.alias(n) for n, v in signals.items()))
    rows.write.mode("overwrite").parquet(path := f"{folder}/long")
    return path


def long_queries(spark, path: str) -> dict:
    from tidemark.operators import histogram as H
    from tidemark.operators import stats as A
    from tidemark.operators import timeaxis as X
    from tidemark.sources.series import load_series

    log = lambda *names: load_series(spark, path, "time", names)
    return {
        "stats_full": lambda: A.basic_stats(log("a")),
        "derived_full": lambda: log("a", "b").derive({"x": "a * 0.5 + b"}).df,
        "time_order": lambda: A.time_order(log("a")),
        "envelope": lambda: A.envelope(log("a"), "a"),
        "hist_full": lambda: H.plain_histogram(log("a"), ["a"])[0],
        "bucket_mean": lambda: H.bucket_table(log("a"), ["a"], H.BucketSettings(X.DAY / 24)),
    }


def main() -> None:
    from tidemark import queries as engine
    from tidemark.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem")}
    took = {name: best_of(lambda name=name: engine.QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    rows = {name: counts["lineitem" if name in ON_LINES else "events"] for name in HEADLINE}
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        path = long_log(spark, folder)
        more = {name: best_of(make) for name, make in long_queries(spark, path).items()}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, best of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows": rows, f"over_{LONG_ROWS}_rows": more, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
