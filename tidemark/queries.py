"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Sums of doubles depend on their order, so both sides round them.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lookup import Table
from tidemark.operators import grid as G
from tidemark.operators import histogram as H
from tidemark.operators import stats as A
from tidemark.operators import timeaxis as X
from tidemark.operators import xy as C
from tidemark.operators.downsample import envelope_points, format_interval, format_rate, lttb_of, overview
from tidemark.plans.derived import classify, dependency_order, effective_available
from tidemark.plans.expression import Compiler, Registry, UserFunction, check_calls, expression_margin
from tidemark.sources import series as R
from tidemark.sources.export import build_plan, estimate, export_many, export_parquet, plan_from_view, write_buckets
from tidemark.sources.stores import Alias, View, active_aliases, load_aliases, load_functions, load_settings, load_view, log_operation, save_aliases, save_functions, save_settings, save_view, timeline, validate_alias
from tidemark.sources.tables import TableStore, parse_table
from tidemark.streaming.buckets import stream_buckets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str, *signals: str) -> R.Series:
    return R.load_series(spark, f"{sf_dir}/events.parquet", "ts", signals or ("value",))


def lines(spark: SparkSession, sf_dir: str, *signals: str) -> R.Series:
    return R.load_series(spark, f"{sf_dir}/lineitem.parquet", "l_shipdate", signals)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: Events in order with their times in seconds; t0 is the first.
EV = "ev AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS r, epoch_us(ts) / 1e6 AS t, value, user_id::DOUBLE AS user_id FROM events)"
RANGE = (5.0, 15.0)  # days after the first event


def ranged(s: R.Series) -> R.Series:
    t0 = s.df.agg(F.min("_t")).first()[0]
    return s.between(t0 + RANGE[0] * X.DAY, t0 + RANGE[1] * X.DAY)


IN_RANGE = f"{EV}, rg AS (SELECT * FROM ev WHERE t BETWEEN (SELECT min(t) FROM ev) + {RANGE[0]} * 86400 AND (SELECT min(t) FROM ev) + {RANGE[1]} * 86400)"


def _stats_sql(table: str, value: str, name: str) -> str:
    ok = f"FILTER (isfinite({value}))"
    return f"SELECT '{name}' AS variable, count(*) AS count, count(*) - count(*) {ok} AS nan_count, min({value}) {ok} AS min, max({value}) {ok} AS max, round(avg({value}) {ok}, 6) AS mean, round(stddev_pop({value}) {ok}, 6) AS std, round(median({value}) {ok}, 6) AS median FROM {table}"


@query(f"WITH {IN_RANGE} {_stats_sql('rg', 'value', 'value')}")
def stats_range(spark, sf_dir):
    return rounded(A.basic_stats(ranged(events(spark, sf_dir))), "mean", "std", "median")


@query(f"WITH {EV} {_stats_sql('(SELECT CASE WHEN value > 10 THEN value * 3.6 ELSE 0 END AS power FROM ev)', 'power', 'power')}")
def stats_derived(spark, sf_dir):
    s = events(spark, sf_dir).derive({"power": "where(value > 10, value * 3.6, 0)"})
    return rounded(A.basic_stats(s, ["power"]), "mean", "std", "median")


@query(f"WITH {EV} SELECT round(count(*) FILTER (isfinite(value)) / (max(t) - min(t)), 9) AS rate_hz FROM ev")
def effective_rate(spark, sf_dir):
    return rounded(A.effective_rate(events(spark, sf_dir), "value"), "rate_hz", digits=9)


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _expressions(name: str, texts: dict[str, str], sql: dict[str, str], registry: Registry | None = None, digits: int = 6) -> None:
    """A query of derived columns by line, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = lines(spark, sf_dir, *LINE, "l_orderkey").derive(texts, registry)
        return s.df.select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("n"), *(F.round(c, digits).alias(c) for c in texts))

    columns = ", ".join(f"round(({e})::DOUBLE, {digits}) AS {c}" for c, e in sql.items())
    query(f"SELECT l_orderkey AS k, l_linenumber AS n, {columns} FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS x, l_linenumber::DOUBLE AS l FROM lineitem)", name)(run)


_expressions("expr_arith", {"a": "l_quantity + l_extendedprice * l_tax - -l_discount", "b": "+l_quantity ** 2 - 3"}, {"a": "q + p * x + d", "b": "pow(q, 2) - 3"})
_expressions(
    "expr_div_mod",
    {"a": "l_extendedprice / (l_linenumber - 3)", "b": "(l_quantity - 25) % (l_linenumber - 3)", "c": "(l_quantity - 25) // (l_linenumber - 3)"},
    {"a": "CASE WHEN l = 3 THEN CASE WHEN p = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE p / (l - 3) END", "b": "CASE WHEN l = 3 THEN 'nan'::DOUBLE ELSE (q - 25) - (l - 3) * floor((q - 25) / (l - 3)) END", "c": "CASE WHEN l = 3 THEN CASE WHEN q = 25 THEN 'nan'::DOUBLE WHEN q > 25 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE floor((q - 25) / (l - 3)) END"},
)
_expressions("expr_math", {"a": "sqrt(l_quantity)", "b": "sin(l_quantity) + cos(l_quantity)", "c": "exp(l_discount)", "d": "log(l_linenumber - 1)", "e": "log10(l_quantity)", "f": "abs(l_linenumber - 4) * sign(l_linenumber - 4)"}, {"a": "sqrt(q)", "b": "sin(q) + cos(q)", "c": "exp(d)", "d": "CASE WHEN l = 1 THEN '-inf'::DOUBLE ELSE ln(l - 1) END", "e": "log10(q)", "f": "abs(l - 4) * sign(l - 4)"})
_expressions("expr_round_clip", {"a": "round(l_quantity / 2)", "b": "floor(-l_quantity / 4) + ceil(l_tax * 10)", "c": "clip(l_quantity, 10, 40)", "d": "min(l_quantity, l_linenumber) + max(l_tax, l_discount)"}, {"a": "round_even(q / 2, 0)", "b": "floor(-q / 4) + ceil(x * 10)", "c": "least(greatest(q, 10), 40)", "d": "least(q, l) + greatest(x, d)"})
_expressions("expr_cond", {"a": "1 < l_linenumber <= 3", "b": "l_quantity if l_discount > 0.05 else -1", "c": "where(isnan(0 / (l_linenumber - 3)), 7, l_linenumber)", "d": "0 / (l_linenumber - 3) > 1"}, {"a": "CASE WHEN 1 < l AND l <= 3 THEN 1 ELSE 0 END", "b": "CASE WHEN d > 0.05 THEN q ELSE -1 END", "c": "CASE WHEN l = 3 THEN 7 ELSE l END", "d": "CASE WHEN l = 3 THEN 'nan'::DOUBLE ELSE 0 END"})
_expressions("expr_kleene", {"a": "(0 / (l_linenumber - 3)) or l_quantity > 25", "b": "(0 / (l_linenumber - 3)) and l_quantity > 25", "c": "not (l_tax > 0.04 and l_discount > 0.04)"}, {"a": "CASE WHEN q > 25 THEN 1 WHEN l = 3 THEN 'nan'::DOUBLE ELSE 0 END", "b": "CASE WHEN l <> 3 THEN 0 WHEN q > 25 THEN 'nan'::DOUBLE ELSE 0 END", "c": "CASE WHEN x > 0.04 AND d > 0.04 THEN 0 ELSE 1 END"})
_DISCOUNTED = Registry().add(UserFunction("net", ("price", "off"), "price * (1 - off) * factor", {"factor": 1.0})).add(UserFunction("twice", ("v",), "net(v, 0, factor=2)", {}))
_expressions("user_function", {"a": "net(l_extendedprice, l_discount)", "b": "twice(l_quantity) + net(l_quantity, l_tax, factor=3)"}, {"a": "p * (1 - d)", "b": "q * 2 + q * (1 - x) * 3"}, _DISCOUNTED)

_X, _Y = (0.0, 10.0, 20.0, 50.0), (1.0, 4.0, 2.0, 8.0)
_XS, _YS = f"[{', '.join(map(str, _X))}]", f"[{', '.join(map(str, _Y))}]"
_CELL = "(CASE WHEN q >= 20 THEN 3 WHEN q >= 10 THEN 2 ELSE 1 END)"
_tables = Registry(tables={m: Table("curve", _X, _Y, None, m) for m in ("linear", "nearest", "previous", "spline")} | {"surface": Table("map", (0.0, 25.0, 50.0), ((1.0, 2.0, 4.0), (3.0, 5.0, 9.0)), (0.0, 0.1))})
_share = f"((q - ({_XS})[{_CELL}]) / (({_XS})[{_CELL} + 1] - ({_XS})[{_CELL}]))"
_expressions("curve_linear", {"a": "linear(l_quantity)"}, {"a": f"({_YS})[{_CELL}] * (1 - {_share}) + ({_YS})[{_CELL} + 1] * {_share}"}, _tables)
_expressions("curve_nearest", {"a": "nearest(l_quantity)"}, {"a": f"CASE WHEN {_share} >= 0.5 THEN ({_YS})[{_CELL} + 1] ELSE ({_YS})[{_CELL}] END"}, _tables)
_expressions("curve_previous", {"a": "previous(l_quantity)"}, {"a": f"CASE WHEN {_share} >= 1 THEN ({_YS})[{_CELL} + 1] ELSE ({_YS})[{_CELL}] END"}, _tables)
_i, _s, _t = "(CASE WHEN q >= 25 THEN 2 ELSE 1 END)", "((q - (CASE WHEN q >= 25 THEN 25 ELSE 0 END)) / 25.0)", "(least(d, 0.1) / 0.1)"
_expressions("map_bilinear", {"a": "surface(l_quantity, l_discount)"}, {"a": f"(([1.0, 2.0, 4.0])[{_i}] * (1 - {_s}) + ([1.0, 2.0, 4.0])[{_i} + 1] * {_s}) * (1 - {_t}) + (([3.0, 5.0, 9.0])[{_i}] * (1 - {_s}) + ([3.0, 5.0, 9.0])[{_i} + 1] * {_s}) * {_t}"}, _tables)


def _spline_sql(v: str, x: tuple[float, ...], y: tuple[float, ...]) -> str:
    """Natural cubic pieces in powers, their coefficients from one linear system."""
    n = len(x) - 1
    rows, right = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    power = lambda t, d: [(0 if k < d else math.prod(range(k - d + 1, k + 1)) * t ** (k - d)) for k in range(4)]
    at = 0
    for k in range(n):
        h = x[k + 1] - x[k]
        for t, value in ((0.0, y[k]), (h, y[k + 1])):
            rows[at, 4 * k : 4 * k + 4], right[at] = power(t, 0), value
            at += 1
        for d in (1, 2) if k < n - 1 else ():
            rows[at, 4 * k : 4 * k + 4], rows[at, 4 * k + 4 : 4 * k + 8] = power(h, d), [-p for p in power(0.0, d)]
            at += 1
    rows[at, :4], rows[at + 1, -4:] = power(0.0, 2), power(x[-1] - x[-2], 2)
    c = np.linalg.solve(rows, right).reshape(n, 4)
    piece = lambda k: " + ".join(f"{float(c[k][p])!r}::DOUBLE * ({v} - {x[k]}) ** {p}" for p in range(4))
    return "CASE " + " ".join(f"WHEN {v} >= {x[k]} THEN {piece(k)}" for k in reversed(range(n))) + " END"


@query(f"SELECT l_orderkey AS k, l_linenumber AS n, round({_spline_sql('l_quantity', _X, _Y)}, 6) AS a FROM lineitem")
def curve_spline(spark, sf_dir):
    s = lines(spark, sf_dir, "l_quantity", "l_orderkey", "l_linenumber").derive({"a": "spline(l_quantity)"}, _tables)
    return s.df.select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("n"), F.round("a", 6).alias("a"))


#: Every third user's value is missing, so that windows meet NaN.
_HOLES = {"v": "where(user_id % 3 == 0, 0 / 0, value)"}
HOLES = f"{EV}, h AS (SELECT r, value, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v FROM ev)"


def _windowed(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = events(spark, sf_dir, "value", "user_id").derive(_HOLES | {"w": text})
        return s.df.select(F.col("_row").alias("r"), F.round(F.nanvl("w", F.lit(None)), 6).alias("w"))

    query(f"WITH {HOLES} SELECT r, round({sql}, 6) AS w FROM h", name)(run)


_windowed("delta", "delta(value)", "coalesce(value - lag(value) OVER (ORDER BY r), 0)")
_windowed("rolling_mean", "rolling_mean(value, 10)", "avg(value) OVER (ORDER BY r ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)")
_windowed("rolling_nanmean", "rolling_nanmean(v, 5)", "avg(v) OVER (ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
_windowed("trailing_mean", "trailing_mean(value, 7)", "avg(value) OVER (ORDER BY r ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
_windowed("trailing_nanmean", "trailing_nanmean(v, 4)", "avg(v) OVER (ORDER BY r ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
_windowed("rolling_mean_holes", "rolling_mean(v, 3)", "CASE WHEN count(v) OVER (ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = count(*) OVER (ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) THEN avg(v) OVER (ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END")


def _order_sql(rows: str) -> str:
    return f"""WITH {rows}, d AS (SELECT r, t, t - lag(t) OVER (ORDER BY r) AS d FROM ax),
m AS (SELECT median(m) AS dt_median FROM (SELECT median(d) AS m FROM d WHERE d > 0 GROUP BY r // 2000000))
SELECT count(*) AS n_rows, 0::BIGINT AS n_nonfinite, count(*) FILTER (d < 0) AS n_decreases, count(*) FILTER (d = 0) AS n_duplicates, min(r) FILTER (d <= 0) AS first_bad_row,
round(any_value(dt_median), 6) AS dt_median, round(min(d) FILTER (d > 0), 6) AS dt_min, round(max(d) FILTER (d > 0), 6) AS dt_max, count(*) FILTER (d <= 0) = 0 AS ok, round(1 / any_value(dt_median), 9) AS rate_hz,
greatest(max(d) FILTER (d > 0) - any_value(dt_median), any_value(dt_median) - min(d) FILTER (d > 0)) > 0.01 * any_value(dt_median) AS irregular FROM d, m"""


@query(_order_sql(f"{EV}, ax AS (SELECT r, t FROM ev)"))
def time_order(spark, sf_dir):
    return rounded(rounded(A.time_order(events(spark, sf_dir)), "dt_median", "dt_min", "dt_max"), "rate_hz", digits=9)


@query(_order_sql("ax AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, epoch_us(o_orderdate) / 1e6 AS t FROM orders)"))
def time_order_orders(spark, sf_dir):
    s = R.load_series(spark, f"{sf_dir}/orders.parquet", "o_orderdate", ["o_totalprice"])
    return rounded(rounded(A.time_order(s), "dt_median", "dt_min", "dt_max"), "rate_hz", digits=9)


@query(f"""WITH {EV}, d AS (SELECT t - lag(t) OVER (ORDER BY r) AS d FROM ev), m AS (SELECT median(d) AS m FROM d)
SELECT count(*) AS n_rows, round(any_value(m), 6) AS dt_median, round(min(d), 6) AS dt_min, round(max(d), 6) AS dt_max, round(greatest(max(d) - any_value(m), any_value(m) - min(d)) / any_value(m), 6) AS max_deviation, count(*) FILTER (d > 1.5 * m) AS n_gaps, 'non_uniform' AS reason FROM d, m""")
def sampling_report(spark, sf_dir):
    return rounded(A.sampling_report(events(spark, sf_dir)), "dt_median", "dt_min", "dt_max", "max_deviation")


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def bounds(spark, sf_dir):
    return A.bounds(R.load_series(spark, f"{sf_dir}/orders.parquet", "o_orderdate", ["o_totalprice"]), ["o_totalprice"])


@query("SELECT count(*) AS n_valid, 0::BIGINT AS n_excluded, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max FROM lineitem")
def joint_bounds(spark, sf_dir):
    return A.joint_bounds(lines(spark, sf_dir, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query(f"WITH {EV} SELECT r // 512 AS bucket, min(t) AS t, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1")
def envelope(spark, sf_dir):
    return A.envelope(events(spark, sf_dir), "value", 512)


@query(f"WITH {EV}, b AS (SELECT r // 512 AS bucket, min(t) AS t, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1) SELECT bucket, t, 0 AS k, lo AS v FROM b UNION ALL SELECT bucket, t, 1, hi FROM b")
def envelope_draw(spark, sf_dir):
    return envelope_points(events(spark, sf_dir), "value", 512)


@query(f"WITH {EV}, n AS (SELECT greatest(1, (count(*) - 100) // 500) AS s FROM ev) SELECT r AS _row, value FROM ev, n WHERE r >= 100 AND (r - 100) % s = 0")
def thin_rows(spark, sf_dir):
    s = events(spark, sf_dir)
    return R.strided(s, 500, 100, s.row_count()).select("_row", "value")


@query(f"WITH {IN_RANGE} SELECT min(r) AS row_start, max(r) + 1 AS row_end FROM rg")
def row_range(spark, sf_dir):
    s = events(spark, sf_dir)
    t0 = s.df.agg(F.min("_t")).first()[0]
    a, b = R.find_row_range(s, t0 + RANGE[0] * X.DAY, t0 + RANGE[1] * X.DAY)
    return spark.createDataFrame([(a, b)], "row_start long, row_end long")


@query(f"WITH {IN_RANGE} SELECT r AS _row, value FROM ev WHERE r BETWEEN (SELECT min(r) FROM rg) - 1 AND (SELECT max(r) FROM rg) + 1")
def drawing_range(spark, sf_dir):
    s = events(spark, sf_dir)
    t0 = s.df.agg(F.min("_t")).first()[0]
    return R.drawing_range(s, t0 + RANGE[0] * X.DAY, t0 + RANGE[1] * X.DAY).select("_row", "value")


@query(f"""WITH {EV}, q AS (SELECT (SELECT min(t) FROM ev) + k * 86400.0 + 1234 AS x FROM range(-1, 12) s(k)), c AS (SELECT x, r, t, row_number() OVER (PARTITION BY x ORDER BY abs(t - x), r) AS n FROM ev, q)
SELECT x, r AS _row, t AS _t FROM c WHERE n = 1""")
def nearest_time(spark, sf_dir):
    s = events(spark, sf_dir)
    t0 = s.df.agg(F.min("_t")).first()[0]
    return R.nearest_rows(s, [t0 + k * X.DAY + 1234 for k in range(-1, 12)])


def _fine_sql(source: str, bins: int) -> str:
    """Display bins of x weighed by w from ``source`` (columns x, w)."""
    return f"""b AS (SELECT min(x) AS lo, max(x) AS hi FROM {source}),
f AS (SELECT greatest(0, least(65535, floor((x / 2 - lo / 2) * (65536 / (hi / 2 - lo / 2)))))::BIGINT AS fine, w, lo, hi FROM {source}, b),
c AS (SELECT k AS bin, round_even(k * (65536 / {bins}.0), 0)::BIGINT AS a, round_even((k + 1) * (65536 / {bins}.0), 0)::BIGINT AS z FROM range({bins}) s(k))
SELECT 'value' AS variable, bin::INT AS bin, round(any_value(b.lo) * (1 - any_value(a) / 65536.0::DOUBLE) + any_value(b.hi) * (any_value(a) / 65536.0::DOUBLE), 6) AS lo, round(any_value(b.lo) * (1 - any_value(z) / 65536.0::DOUBLE) + any_value(b.hi) * (any_value(z) / 65536.0::DOUBLE), 6) AS hi, round(coalesce(sum(w), 0), 3) AS amount
FROM c CROSS JOIN b LEFT JOIN f ON fine >= a AND fine < z GROUP BY bin"""


#: Durations under the gap rule, as x-w pairs.
HELD = f"""{EV}, w0 AS (SELECT r, t, value, coalesce(lead(t) OVER (ORDER BY r) - t, 0) AS w FROM ev),
g AS (SELECT 5 * median(m) AS gap FROM (SELECT median(w) AS m FROM w0 WHERE w > 0 GROUP BY r // 1000000)),
held AS (SELECT r, t AS x, value AS v, CASE WHEN w > gap THEN 0 ELSE w END AS w FROM w0, g)"""


@query(f"WITH {EV}, s AS (SELECT value AS x, 1.0::DOUBLE AS w FROM ev), {_fine_sql('s', 40)}")
def hist_rows(spark, sf_dir):
    return rounded(rounded(H.plain_histogram(events(spark, sf_dir), ["value"], bins=40)[0], "lo", "hi"), "amount", digits=3)


@query(f"WITH {HELD}, s AS (SELECT v AS x, w FROM held), {_fine_sql('s', 25)}")
def hist_time(spark, sf_dir):
    return rounded(rounded(H.plain_histogram(events(spark, sf_dir), ["value"], "time", 25)[0], "lo", "hi"), "amount", digits=3)


@query(f"WITH {EV} SELECT 'value' AS variable, count(*) AS n, 0::BIGINT AS excluded, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median, min(value) AS vmin, max(value) AS vmax FROM ev")
def hist_summary(spark, sf_dir):
    return rounded(H.plain_histogram(events(spark, sf_dir), ["value"])[1], "mean", "std", "median")


@query(f"""WITH {EV}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM ev),
f AS (SELECT greatest(0, least(65535, floor((value / 2 - lo / 2) * (65536 / (hi / 2 - lo / 2)))))::BIGINT AS fine, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM ev, b GROUP BY 1)
SELECT sum(n) OVER (ORDER BY fine DESC)::DOUBLE AS x, round(lo * (1 - fine / 65536.0::DOUBLE) + hi * (fine / 65536.0::DOUBLE), 6) AS v FROM f""")
def duration_curve(spark, sf_dir):
    return rounded(H.duration_curve(events(spark, sf_dir), "value"), "v")


def _bucket_sql(agg: str, length: float, origin: float, unit: float, head: str = HELD, only: str = "") -> str:
    value = {"sum": "CASE WHEN n > 0 THEN total END", "integral": f"CASE WHEN valid > 0 THEN integral / {unit} END", "mean": "CASE WHEN valid > 0 THEN integral / valid END", "max": "hi", "min": "lo"}[agg]
    at = {"max": "hi_at", "min": "lo_at"}.get(agg, "NULL::DOUBLE")
    return f"""WITH {head}, o AS (SELECT floor((min(t) - {origin}) / 86400) * 86400 + {origin} AS e0, max(t) AS t1 FROM ev),
k AS (SELECT e0 + k * {length}::DOUBLE AS s, e0 + (k + 1) * {length}::DOUBLE AS e FROM o, range((SELECT ceil((t1 - e0 + 86400) / {length})::BIGINT FROM o)) r(k) WHERE e0 + k * {length}::DOUBLE <= t1 AND e0 + (k + 1) * {length}::DOUBLE > (SELECT min(t) FROM ev)),
p AS (SELECT s, e, x, v, greatest(x, s) AS pt, least(x + w, e) AS en FROM held JOIN k ON (x < e AND x + w > s) OR (x >= s AND x < e)),
a AS (SELECT s, sum(v * greatest(en - pt, 0)) AS integral, sum(greatest(en - pt, 0)) AS valid, sum(v) FILTER (pt = x) AS total, count(*) FILTER (pt = x) AS n, max(v) AS hi, min(v) AS lo FROM p GROUP BY s),
z AS (SELECT p.s, min(pt) FILTER (v = hi) AS hi_at, min(pt) FILTER (v = lo) AS lo_at FROM p JOIN a ON p.s = a.s GROUP BY p.s),
res AS (SELECT 'value' AS variable, k.s AS bucket_start, k.e AS bucket_end, {value} AS value, {value} IS NOT NULL AND valid / {length} >= 0.9 AS complete, {at} AS ext FROM k LEFT JOIN a ON k.s = a.s LEFT JOIN z ON k.s = z.s)
{only or "SELECT variable, bucket_start, bucket_end, round(value, 5) AS value, coalesce(complete, false) AS complete, round(ext, 5) AS \"at\" FROM res"}"""


def _buckets(agg: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(X.DAY, 6 * 3600, agg)), "value", "at", digits=5)

    query(_bucket_sql(agg, X.DAY, 6 * 3600, 3600.0), f"bucket_{agg}")(run)


for _agg in H.AGGREGATIONS:
    _buckets(_agg)


@query(_bucket_sql("mean", 21600, 0, 3600.0))
def bucket_six_hours(spark, sf_dir):
    return rounded(H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(X.DAY / 4)), "value", "at", digits=5)


@query(_bucket_sql("mean", X.DAY, 6 * 3600, 3600.0, only="SELECT variable, row_number() OVER (ORDER BY value DESC)::DOUBLE AS x, round(value, 5) AS v FROM res WHERE value IS NOT NULL AND complete"))
def bucket_trend(spark, sf_dir):
    return rounded(H.bucket_duration_curve(H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(X.DAY, 6 * 3600))), "v", digits=5)


@query(_bucket_sql("mean", 3600, 0, 3600.0, only="""SELECT 'value' AS variable, d.s AS bucket_start, d.s + 86400 AS bucket_end, round(max(value) FILTER (complete), 5) AS value, coalesce(count(*) FILTER (complete) / 24.0 >= 0.9 AND count(*) FILTER (complete) > 0, false) AS complete,
round(min(bucket_start) FILTER (complete AND value = m), 5) AS "at" FROM (SELECT DISTINCT floor(s / 86400) * 86400 AS s FROM k) d LEFT JOIN (SELECT *, max(value) FILTER (complete) OVER (PARTITION BY floor(bucket_start / 86400)) AS m FROM res) r ON floor(r.bucket_start / 86400) * 86400 = d.s GROUP BY d.s"""))
def two_stage(spark, sf_dir):
    return rounded(H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(X.DAY, 0, "max", stage1=3600.0)), "value", "at", digits=5)


@query(_bucket_sql("integral", 7200, 0, 1.0, only="""SELECT 'value' AS variable, j::INT AS slot, j * 7200.0::DOUBLE AS slot_start, round(sum(integral) / sum(valid), 5) AS value, round(coalesce(sum(valid), 0), 5) AS valid_s, count(s) AS days, count(*) FILTER (valid < 7200 * (1 - 1e-9)) AS partial_days
FROM range(12) q(j) LEFT JOIN (SELECT * FROM a WHERE valid > 0) a ON ((s % 86400) / 7200)::BIGINT = j GROUP BY j"""))
def time_of_day(spark, sf_dir):
    return rounded(H.time_of_day(events(spark, sf_dir), ["value"], 7200), "value", "valid_s", digits=5)


@query(f"""WITH {HELD}, o AS (SELECT floor(min(t) / 86400) * 86400 AS e0, min(t) AS t0, max(t) AS t1 FROM ev),
k AS (SELECT e0 + k * 86400.0::DOUBLE AS s FROM o, range((SELECT floor((t1 - e0) / 86400)::BIGINT + 1 FROM o)) r(k)),
q AS (SELECT s, s + 28800 AS a, s + 64800 AS z FROM k WHERE ((s / 86400)::BIGINT + 3) % 7 < 5),
p AS (SELECT s, x, v, greatest(x, a) AS pt, least(x + w, z) AS en FROM held JOIN q ON (x < z AND x + w > a) OR (x >= a AND x < z)),
m AS (SELECT s, sum(v * (en - pt)) / nullif(sum(en - pt), 0) AS value, sum(en - pt) AS valid FROM p GROUP BY s)
SELECT 'value' AS variable, q.s AS bucket_start, q.s + 86400 AS bucket_end, round(value, 5) AS value, coalesce(value IS NOT NULL AND valid / 36000 >= 0.9, false) AS complete, NULL::DOUBLE AS "at" FROM q LEFT JOIN m USING (s)""")
def filter_workhours(spark, sf_dir):
    wanted = X.TimeFilter(8 * 3600, 18 * 3600, frozenset(range(5)))
    return rounded(H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(time_filter=wanted)), "value", "at", digits=5)


@query("SELECT y AS variable, count(*) AS n_valid, 0::BIGINT AS n_excluded, min(l_quantity) AS x_min, max(l_quantity) AS x_max, min(v) AS y_min, max(v) AS y_max FROM (SELECT l_quantity, unnest(['l_extendedprice', 'l_tax']) AS y, unnest([l_extendedprice, l_tax]) AS v FROM lineitem) GROUP BY y")
def xy_bounds(spark, sf_dir):
    return C.xy_bounds(lines(spark, sf_dir, "l_quantity", "l_extendedprice", "l_tax"), "l_quantity", ["l_extendedprice", "l_tax"])


@query(f"WITH {EV}, n AS (SELECT ceil(count(*) / 1500.0)::BIGINT AS s FROM ev) SELECT 'value' AS variable, r AS _row, user_id AS x, value AS y FROM ev, n WHERE r % s = 0")
def xy_scatter(spark, sf_dir):
    return C.xy_scatter(events(spark, sf_dir, "value", "user_id"), "user_id", ["value"], limit=1500).select("variable", "_row", "x", "y")


@query("""WITH b AS (SELECT min(l_quantity) AS xa, max(l_quantity) AS xb, min(l_extendedprice) AS ya, max(l_extendedprice) AS yb FROM lineitem)
SELECT greatest(0, least(floor((l_quantity - xa) * 256 / (xb - xa)), 255))::INT AS ix, greatest(0, least(floor((l_extendedprice - ya) * 256 / (yb - ya)), 255))::INT AS iy, count(*) AS n, round(avg(l_tax), 6) AS z_mean FROM lineitem, b GROUP BY 1, 2""")
def xy_density(spark, sf_dir):
    return rounded(C.xy_density(lines(spark, sf_dir, "l_quantity", "l_extendedprice", "l_tax"), "l_quantity", ["l_extendedprice"], "l_tax"), "z_mean")


@query(f"WITH {EV}, n AS (SELECT ceil(count(*) / 900.0)::BIGINT AS s FROM ev) SELECT r AS _row, t AS x, user_id AS y, value AS z FROM ev, n WHERE r % s = 0")
def xyz_points(spark, sf_dir):
    s = events(spark, sf_dir, "value", "user_id").derive({"clock": "ts + 0"})
    return C.xyz_points(s, "clock", "user_id", "value", 900).select("_row", "x", "y", "z")


XA, YA = [5.0, 15.0, 25.0, 35.0, 45.0], [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]
_placed = f"""p AS (SELECT floor((l_quantity - 0) / 10)::INT AS ix, (SELECT max(k) FROM (SELECT unnest({[float(e) for e in G.cell_edges(YA)[:-1]]}) AS e, unnest(range({len(YA)})) AS k) WHERE e <= l_discount)::INT AS iy, l_extendedprice AS v FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 AND l_discount < {float(G.cell_edges(YA)[-1])}),
c AS (SELECT i::INT AS ix, j::INT AS iy, ({XA})[i + 1]::DOUBLE AS x, ({YA})[j + 1]::DOUBLE AS y FROM range({len(XA)}) a(i), range({len(YA)}) b(j))"""


def _grid(agg: str, made: str, min_count: int = 1, name: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = G.grid_map(lines(spark, sf_dir, "l_quantity", "l_discount", "l_extendedprice"), "l_quantity", "l_discount", "l_extendedprice", XA, YA, agg, min_count)
        return rounded(g.cells, "value", digits=4)

    value = f"CASE WHEN count(v) >= {min_count} THEN round({made}, 4) END" if agg != "count" else "count(v)::DOUBLE"
    query(f"WITH {_placed} SELECT ix, iy, x, y, {value} AS value, count(v) AS n FROM c LEFT JOIN p USING (ix, iy) GROUP BY ix, iy, x, y", name or f"grid_{agg}")(run)


for _agg, _made in (("mean", "avg(v)"), ("median", "median(v)"), ("max", "max(v)"), ("min", "min(v)"), ("count", "")):
    _grid(_agg, _made)
_grid("mean", "avg(v)", 900, "grid_min_count")


@query(f"""WITH {HELD}, p AS (SELECT floor(user_id / 50)::INT AS ix, floor(value / 20)::INT AS iy, w FROM held JOIN ev USING (r) WHERE user_id >= 0 AND user_id < 500 AND value >= 0 AND value < 100)
SELECT i::INT AS ix, j::INT AS iy, i * 50.0::DOUBLE + 25 AS x, j * 20.0::DOUBLE + 10 AS y, round(coalesce(sum(w), 0) / 3600, 5) AS value, count(w) AS n FROM range(10) a(i), range(5) b(j) LEFT JOIN p ON ix = i AND iy = j GROUP BY i, j""")
def grid_time(spark, sf_dir):
    g = G.grid_map(events(spark, sf_dir, "value", "user_id"), "user_id", "value", None, [25.0 + 50 * k for k in range(10)], [10.0 + 20 * k for k in range(5)], "time", unit=3600.0)
    return rounded(g.cells, "value", digits=5)


@query(f"WITH {EV}, p AS (SELECT floor(user_id / 100)::INT AS ix, value FROM ev WHERE r % 7 <> 0 AND user_id >= 0 AND user_id < 500) SELECT i::INT AS ix, 0 AS iy, i * 100.0::DOUBLE + 50 AS x, -1e9::DOUBLE AS y, NULL::DOUBLE AS value, 0::BIGINT AS n FROM range(5) a(i) UNION ALL SELECT i::INT, 1, i * 100.0::DOUBLE + 50, 1e9::DOUBLE, round(avg(value), 5), count(value) FROM range(5) a(i) LEFT JOIN p ON ix = i GROUP BY i")
def grid_excluded(spark, sf_dir):
    s = events(spark, sf_dir, "value", "user_id").derive({"one": "0 * value + 1"})
    out = s.df.where("_row % 7 = 0").select("_row")
    g = G.grid_map(s, "user_id", "one", "value", [50.0 + 100 * k for k in range(5)], [-1e9, 1e9], "mean", excluded=out)
    return rounded(g.cells, "value", digits=5)


@query("SELECT 'l_tax' AS variable, i::INT AS ix, (i * 10 + 5)::DOUBLE AS x, round(avg(l_tax), 6) AS value, count(l_tax) AS n FROM range(5) a(i) LEFT JOIN lineitem ON floor(l_quantity / 10) = i GROUP BY i")
def grid_curve(spark, sf_dir):
    return rounded(G.grid_curve(lines(spark, sf_dir, "l_quantity", "l_tax"), "l_quantity", ["l_tax"], XA), "value")


def _sparse(spark: SparkSession, sf_dir: str) -> G.Grid:
    return G.grid_map(lines(spark, sf_dir, "l_quantity", "l_discount", "l_extendedprice"), "l_quantity", "l_discount", "l_extendedprice", XA, YA, "mean", 900)


@query()
def grid_fill_nearest(spark, sf_dir):
    return rounded(G.filled_grid(_sparse(spark, sf_dir), "nearest"), "value", digits=4)


@query()
def grid_fill_smooth(spark, sf_dir):
    return rounded(G.filled_grid(_sparse(spark, sf_dir), "smooth"), "value", digits=4)


@query()
def grid_contours(spark, sf_dir):
    g = G.grid_map(lines(spark, sf_dir, "l_quantity", "l_discount", "l_extendedprice"), "l_quantity", "l_discount", "l_extendedprice", XA, YA)
    z = G.grid_array(g)
    rows = [(float(v), *map(float, s)) for v in G.plan_levels(float(z.min()), float(z.max())) for s in G.contour_segments(g.x, g.y, z, v)]
    return spark.createDataFrame(rows, "level double, x0 double, y0 double, x1 double, y1 double")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row, value FROM events QUALIFY user_id BETWEEN 10 AND 60 AND value BETWEEN 20 AND 40")
def rect_rows(spark, sf_dir):
    s = events(spark, sf_dir, "value", "user_id")
    return R.in_rectangle(s, "user_id", ["value"], (10, 60), (20, 40)).join(s.df.select("_row", "value"), "_row").select("_row", "value")


@query(f"WITH {EV} SELECT r AS _row, user_id AS x, value AS y FROM ev WHERE ((user_id - 100) / 5) ** 2 + ((value - 30) / 1) ** 2 <= 36 ORDER BY ((user_id - 100) / 5) ** 2 + ((value - 30) / 1) ** 2, r LIMIT 1")
def nearest_point(spark, sf_dir):
    s = events(spark, sf_dir, "value", "user_id")
    points = s.df.select("_row", F.col("user_id").alias("x"), F.col("value").alias("y"))
    return C.nearest_point(points, 100, 30, (5, 1))


@query("SELECT event_id AS k, value AS level FROM events")
def alias_select(spark, sf_dir):
    s = events(spark, sf_dir, "value", "event_id").renamed({"level": ["height", "value"], "value": ["event_id"]})
    return s.df.select(F.col("event_id").cast("long").alias("k"), "level")


_KINDS = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, column_name AS name, {_KINDS} AS type, column_type = 'TIMESTAMP' AS stamp, column_type NOT IN ('VARCHAR', 'FLOAT[]') AS computable FROM (DESCRIBE {t})" for t in ("events", "lineitem", "orders", "part")))
def schema_numeric(spark, sf_dir):
    rows = [(t, *r) for t in ("events", "lineitem", "orders", "part") for r in R.schema_listing(spark.read.parquet(f"{sf_dir}/{t}.parquet"))]
    return spark.createDataFrame(rows, "source string, name string, type string, stamp boolean, computable boolean")


@query()
def navigator(spark, sf_dir):
    return overview(events(spark, sf_dir), "value", 400)

# tables as functions: other interpolations, empty cells and what lies beyond the axes


def _cells(v: str, axis: list[float]) -> tuple[str, str]:
    """(number from 1 of the cell of v, its share) in SQL, v clamped."""
    inner = axis[1:-1]
    k = "CASE " + " ".join(f"WHEN {v} >= {e} THEN {j + 2}" for j, e in reversed(list(enumerate(inner)))) + " ELSE 1 END" if inner else "1"
    at = f"({axis})[{k}]"
    return f"({k})", f"((least(greatest({v}, {axis[0]}), {axis[-1]}) - {at}) / (({axis})[({k}) + 1] - {at}))"


_GX, _GY, _GZ = [0.0, 20.0, 30.0, 50.0], [0.0, 0.04, 0.1], [[1.0, 2.0, 4.0, 8.0], [3.0, 5.0, 9.0, 7.0], [2.0, 6.0, 1.0, 0.0]]
_FX, _FY = [10.0, 20.0, 30.0, 40.0], [1.0, 3.0, -2.0, 5.0]
_more = Registry(
    tables={f"map_{m}": Table("map", tuple(_GX), tuple(map(tuple, _GZ)), tuple(_GY), m) for m in ("nearest", "previous")}
    | {f"out_{o}": Table("curve", tuple(_FX), tuple(_FY), None, "linear", (o, o)) for o in ("clamp", "zero", "nan", "linear")}
    | {"holes": Table("curve", tuple(_FX), (1.0, float("nan"), -2.0, 5.0)), "even": Table("curve", tuple(10.0 * k for k in range(6)), (0.0, 1.0, 4.0, 9.0, 16.0, 25.0))}
)
_gi, _gs = _cells("q", _GX)
_gj, _gt = _cells("d", _GY)
for _how, _from in (("nearest", 0.5), ("previous", 1.0)):
    _expressions(f"map_{_how}", {"a": f"map_{_how}(l_quantity, l_discount)"}, {"a": f"({_GZ})[{_gj} + CASE WHEN {_gt} >= {_from} THEN 1 ELSE 0 END][{_gi} + CASE WHEN {_gs} >= {_from} THEN 1 ELSE 0 END]"}, _more)
_fk, _fs_ = _cells("q", _FX)
_lin = f"(({_FY})[{_fk}] * (1 - {_fs_}) + ({_FY})[{_fk} + 1] * {_fs_})"
_expressions(
    "curve_outside",
    {"a": "out_clamp(l_quantity)", "b": "out_zero(l_quantity)", "c": "out_nan(l_quantity)", "d": "out_linear(l_quantity)"},
    {"a": _lin, "b": f"CASE WHEN q < 10 OR q > 40 THEN 0 ELSE {_lin} END", "c": f"CASE WHEN q < 10 OR q > 40 THEN 'nan'::DOUBLE ELSE {_lin} END", "d": f"CASE WHEN q < 10 THEN 1 + (q - 10) * 0.2 WHEN q > 40 THEN 5 + (q - 40) * 0.7 ELSE {_lin} END"},
    _more,
)
_expressions("curve_empty_cell", {"a": "holes(l_quantity)"}, {"a": "CASE WHEN q <= 10 THEN 1 WHEN q < 30 THEN 'nan'::DOUBLE WHEN q >= 40 THEN 5 ELSE -2 + (q - 30) * 0.7 END"}, _more)
_expressions("curve_even_axis", {"a": "even(l_quantity)"}, {"a": "floor(least(q, 49.999999) / 10) ** 2 + (q / 10 - floor(least(q, 49.999999) / 10)) * (2 * floor(least(q, 49.999999) / 10) + 1)"}, _more)


@query("SELECT l_orderkey AS k, l_linenumber AS n, round(least(greatest(CASE WHEN l_quantity < 20 THEN 1 + (l_quantity - 5) / 15.0 ELSE 2 + (l_quantity - 20) / 15.0 * 2 END, 1), 4), 6) AS a FROM lineitem")
def table_store(spark, sf_dir):
    """A curve from CSV text into a store, out of it again, and used."""
    with tempfile.TemporaryDirectory() as folder:
        store = TableStore(folder)
        store.put("gain", parse_table("x,y\n5,1\n20,2\n35,4\n"))
        gain = TableStore(folder).load_all()[0]["gain"]
    s = lines(spark, sf_dir, "l_quantity", "l_orderkey", "l_linenumber").derive({"a": "gain(l_quantity)"}, Registry(tables={"gain": gain}))
    return s.df.select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("n"), F.round("a", 6).alias("a"))


_CSV = {"fine": "x,y\n1,2\n2,3", "width": "x,y\n1,2\n2,3,4", "descending": "1,2\n1,3", "word": "1,2\n3,x", "hole": "1,2\n,3", "map": ",1,2\n5,1,2\n6,3,", "none": ""}


@query("SELECT * FROM (VALUES ('fine', true, 'curve'), ('width', false, NULL), ('descending', false, NULL), ('word', false, NULL), ('hole', false, NULL), ('map', true, 'map'), ('none', false, NULL)) v(name, ok, kind)")
def table_checks(spark, sf_dir):
    """Which texts are tables, and of what kind."""
    rows = []
    for name, text in _CSV.items():
        try:
            rows.append((name, True, parse_table(text).kind))
        except ValueError:
            rows.append((name, False, None))
    return spark.createDataFrame(rows, "name string, ok boolean, kind string")


# expressions that are refused, margins, and the order of derived variables

_TEXTS = {"v + 1": "", "v +": "ExpressionError", "import os": "ExpressionError", "v.real": "ExpressionError", "missing(v)": "UnknownFunctionError", "clip(v)": "ExpressionError", "rolling_mean(v, 0)": "ExpressionError", "rolling_mean(v, v)": "ExpressionError", "[v]": "ExpressionError", "v if v > 1 else -v": ""}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{w}')" for t, w in _TEXTS.items()) + ") v(text, refusal)")
def expression_checks(spark, sf_dir):
    rows = []
    for text in _TEXTS:
        try:
            check_calls(text, Registry())
            Compiler({"v": F.lit(1.0)}).compile(text)
            rows.append((text, ""))
        except ValueError as error:
            rows.append((text, type(error).__name__))
    return spark.createDataFrame(rows, "text string, refusal string")


@query("SELECT * FROM (VALUES ('v', 0, 0), ('delta(v)', 1, 0), ('rolling_mean(v, 5)', 2, 2), ('trailing_mean(v, 4)', 3, 0), ('trailing_mean(rolling_mean(v, 5), 4)', 5, 2)) v(text, before, after)")
def expression_margins(spark, sf_dir):
    texts = ["v", "delta(v)", "rolling_mean(v, 5)", "trailing_mean(v, 4)", "trailing_mean(rolling_mean(v, 5), 4)"]
    return spark.createDataFrame([(t, *map(int, expression_margin(t, ["v"]))) for t in texts], "text string, before int, after int")


_DERIVED = {"c": "a + b", "a": "value * 2", "b": "a + 1", "d": "nothing + 1", "e": "f", "f": "e", "g": "value +"}


@query("SELECT * FROM (VALUES ('a', true), ('b', true), ('c', true), ('d', false), ('e', false), ('f', false), ('g', false)) v(variable, usable)")
def view_usability(spark, sf_dir):
    """Which derived variables of a view can be used with the log's columns."""
    found = classify(_DERIVED, spark.read.parquet(f"{sf_dir}/events.parquet").columns, "ts")
    return spark.createDataFrame([(n, why is None) for n, why in found.items()], "variable string, usable boolean")


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(place, variable)")
def derived_order(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(dependency_order({n: _DERIVED[n] for n in "cab"}))), "place int, variable string")


# distributions that choose their bins, of buckets, by time, as shares


@query(f"""WITH {EV}, b AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM ev),
f AS (SELECT greatest(0, least(65535, floor((value / 2 - lo / 2) * (65536 / (hi / 2 - lo / 2)))))::BIGINT AS fine, count(*) AS c FROM ev, b GROUP BY 1),
cum AS (SELECT fine, c, sum(c) OVER (ORDER BY fine) AS upto, n FROM f, b),
q AS (SELECT min((fine + 1 - (upto - 0.25 * n) / c) / 65536) FILTER (upto >= 0.25 * n) AS q1, min((fine + 1 - (upto - 0.75 * n) / c) / 65536) FILTER (upto >= 0.75 * n) AS q3 FROM cum)
SELECT 'value' AS variable, least(1000, greatest(2, ceil(1 / (2 * (q3 - q1) / cbrt(n)))))::BIGINT AS bins, n::DOUBLE AS amount FROM q, b""")
def hist_free_bins(spark, sf_dir):
    return H.plain_histogram(events(spark, sf_dir), ["value"])[0].groupBy("variable").agg(F.count(F.lit(1)).alias("bins"), F.sum("amount").alias("amount"))


@query(f"""WITH {HELD}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM held),
f AS (SELECT greatest(0, least(65535, floor((v / 2 - lo / 2) * (65536 / (hi / 2 - lo / 2)))))::BIGINT AS fine, sum(w) AS w, any_value(lo) AS lo, any_value(hi) AS hi FROM held, b GROUP BY 1),
c AS (SELECT *, sum(w) OVER (ORDER BY fine) AS upto, sum(w) OVER () AS total FROM f WHERE w > 0),
m AS (SELECT arg_min((fine + 1 - (upto - total / 2) / w) / 65536, fine) AS share, any_value(lo) AS lo, any_value(hi) AS hi FROM c WHERE upto >= total / 2),
s AS (SELECT sum(v * w) / sum(w) AS mean FROM held)
SELECT 'value' AS variable, (SELECT count(*) FROM ev) AS n, round(any_value(mean), 6) AS mean, round(sqrt((SELECT sum(w * (v - mean) ** 2) / sum(w) FROM held, s)), 6) AS std, round(any_value(lo * (1 - share) + hi * share), 6) AS median FROM m, s""")
def hist_time_summary(spark, sf_dir):
    """Mean, spread and median by time."""
    return rounded(H.plain_histogram(events(spark, sf_dir), ["value"], "time", 10)[1], "mean", "std", "median").select("variable", "n", "mean", "std", "median")


@query(f"WITH {EV}, s AS (SELECT value AS x, 1.0::DOUBLE AS w FROM ev), h AS (WITH {_fine_sql('s', 8)}) SELECT variable, bin, round(100 * amount / sum(amount) OVER (), 6) AS percent FROM h")
def hist_percent(spark, sf_dir):
    return rounded(H.percent(H.plain_histogram(events(spark, sf_dir), ["value"], bins=8)[0]).select("variable", "bin", "percent"), "percent")


@query(_bucket_sql("mean", 21600, 0, 3600.0, only="""SELECT 'value' AS variable, k::INT AS bin, round(lo + (hi - lo) * k / 6, 6) AS lo, round(lo + (hi - lo) * (k + 1) / 6, 6) AS hi, count(value) AS n
FROM (SELECT min(value) AS lo, max(value) AS hi FROM res WHERE complete) CROSS JOIN range(6) q(k) LEFT JOIN (SELECT value FROM res WHERE complete) r ON least(5, floor((value - lo) / (hi - lo) * 6)) = k GROUP BY k, lo, hi"""))
def bucket_distribution(spark, sf_dir):
    table = H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(X.DAY / 4))
    return rounded(H.bucket_distribution(table, 6), "lo", "hi")


@query(f"""WITH {HELD}, o AS (SELECT floor(min(t) / 86400) * 86400 AS e0, min(t) AS t0, max(t) AS t1 FROM ev),
k AS (SELECT e0 + k * 86400.0::DOUBLE AS s FROM o, range((SELECT floor((t1 - e0) / 86400)::BIGINT + 1 FROM o)) r(k)),
q AS (SELECT s, s AS a, s + 21600 AS z FROM k UNION ALL SELECT s, s + 79200, s + 86400 FROM k),
p AS (SELECT s, x, v, greatest(x, a) AS pt, least(x + w, z) AS en FROM held JOIN q ON (x < z AND x + w > a) OR (x >= a AND x < z)),
m AS (SELECT s, sum(v * (en - pt)) / nullif(sum(en - pt), 0) AS value, sum(en - pt) AS valid FROM p GROUP BY s)
SELECT 'value' AS variable, k.s AS bucket_start, k.s + 86400 AS bucket_end, round(value, 5) AS value, coalesce(value IS NOT NULL AND valid / 28800 >= 0.9, false) AS complete, NULL::DOUBLE AS "at" FROM k LEFT JOIN m USING (s)""")
def filter_midnight(spark, sf_dir):
    """From 22:00 over midnight until 06:00."""
    return rounded(H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(time_filter=X.TimeFilter(22 * 3600, 6 * 3600))), "value", "at", digits=5)


#: A zone behind UTC by a whole number of hours over the events' time; its days begin five hours later.
_WEST = 5 * 3600


@query(_bucket_sql("mean", X.DAY, _WEST, 3600.0))
def bucket_zone(spark, sf_dir):
    return rounded(H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(zone=X.Zone("America/New_York"))), "value", "at", digits=5)


@query("SELECT * FROM (VALUES (1709960400.0::DOUBLE), (1710046800.0), (1710129600.0), (1710216000.0)) v(edge)")
def zone_edges(spark, sf_dir):
    """Days of New York around the night in March 2024 that has 23 hours."""
    return spark.createDataFrame([(e,) for e in X.bucket_edges(1709961000.0, 1710200000.0, X.DAY, 0, X.Zone("America/New_York"))], "edge double")


@query("SELECT * FROM (VALUES (1710050400.0::DOUBLE, 1710054000.0::DOUBLE), (1710136800.0, 1710140400.0)) v(begun, ended)")
def zone_filter(spark, sf_dir):
    """01:00 to 03:00 in that night, of which the second hour doesn't exist, and 02:00 to 03:00 in the next."""
    first = X.target_intervals(X.TimeFilter(3600, 3 * 3600), 1710046800.0, 1710129600.0, X.Zone("America/New_York"))
    second = X.target_intervals(X.TimeFilter(2 * 3600, 3 * 3600), 1710129600.0, 1710216000.0, X.Zone("America/New_York"))
    return spark.createDataFrame(first + second, "begun double, ended double")


# grids: uneven and nice axes, filling, levels

_UX = [2.0, 5.0, 13.0, 30.0, 48.0]


@query(f"""WITH e AS (SELECT unnest({[float(e) for e in G.cell_edges(_UX)[:-1]]}) AS e, unnest(range(5)) AS k),
p AS (SELECT (SELECT max(k) FROM e WHERE e <= l_quantity)::INT AS ix, l_tax FROM lineitem WHERE l_quantity >= {float(G.cell_edges(_UX)[0])} AND l_quantity < {float(G.cell_edges(_UX)[-1])})
SELECT 'l_tax' AS variable, i::INT AS ix, ({_UX})[i + 1]::DOUBLE AS x, round(median(l_tax), 6) AS value, count(l_tax) AS n FROM range(5) a(i) LEFT JOIN p ON ix = i GROUP BY i""")
def grid_uneven_axis(spark, sf_dir):
    return rounded(G.grid_curve(lines(spark, sf_dir, "l_quantity", "l_tax"), "l_quantity", ["l_tax"], _UX, "median"), "value")


@query("SELECT 'step' AS axis, k::INT AS place, round(-1 + k * 0.25, 9) AS point FROM range(9) s(k) UNION ALL SELECT 'count', k::INT, round(k * 2.5, 9) FROM range(5) s(k) UNION ALL SELECT 'nice', k::INT, round(k * 0.5, 9) FROM range(19) s(k)")
def grid_axes(spark, sf_dir):
    specs = {"step": G.AxisSpec("step", -1, 1.1, 0.25), "count": G.AxisSpec("count", 0, 10, count=5), "nice": G.nice_axis(0.2, 8.7)}
    return rounded(spark.createDataFrame([(n, k, float(p)) for n, a in specs.items() for k, p in enumerate(a.points())], "axis string, place int, point double"), "point", digits=9)


_FILL = f"WITH {_placed}, g AS (SELECT ix, iy, x, y, CASE WHEN count(v) >= 900 THEN avg(v) END AS z FROM c LEFT JOIN p USING (ix, iy) GROUP BY ix, iy, x, y)"
query(f"""{_FILL}, near AS (SELECT a.ix, a.iy, arg_min(b.z, ((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2) * 1000 + b.iy * {len(XA)} + b.ix) AS z FROM g a, g b WHERE b.z IS NOT NULL GROUP BY a.ix, a.iy)
SELECT g.ix, g.iy, x, y, round(near.z, 4) AS value, g.z IS NULL AS filled FROM g JOIN near USING (ix, iy)""", "grid_fill_nearest")(QUERIES["grid_fill_nearest"])


@query("SELECT * FROM (VALUES ('nice', 20.0::DOUBLE), ('nice', 40.0), ('nice', 60.0), ('nice', 80.0), ('step', 30.0), ('step', 60.0), ('step', 90.0), ('list', 7.5), ('none', NULL)) v(how, level)")
def contour_levels(spark, sf_dir):
    made = {"nice": G.plan_levels(3.0, 97.0, None)[1::2], "step": G.plan_levels(3.0, 97.0, 30.0), "list": G.plan_levels(3.0, 97.0, values=[7.5, 97.0, 200.0]), "none": G.plan_levels(5.0, 5.0) or [None]}
    return spark.createDataFrame([(n, v) for n, vs in made.items() for v in vs], "how string, level double")


@query("SELECT 1.5::DOUBLE AS level, x0, y0, x1, y1 FROM (VALUES (0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 0.0::DOUBLE)) v(x0, y0, x1, y1)")
def contour_plane(spark, sf_dir):
    """The level 1.5 of x + y over one square runs from the upper side to the right one."""
    segments = G.contour_segments([0.0, 2.0], [0.0, 1.0], np.array([[0.0, 2.0], [1.0, 3.0]]), 1.5)
    rows = [(1.5, *map(float, s if s[0] < s[2] else (s[2], s[3], s[0], s[1]))) for s in segments]
    return spark.createDataFrame(rows, "level double, x0 double, y0 double, x1 double, y1 double")


# drawing, spectra, text


query(f"WITH {EV}, b AS (SELECT min(t) AS t, min(value) AS lo, max(value) AS hi FROM ev, (SELECT greatest(8192, ceil(2 * count(*) / 400.0)::BIGINT) AS n FROM ev) GROUP BY r // n) SELECT t, lo AS v FROM b UNION SELECT t, hi FROM b UNION SELECT t, value FROM ev WHERE r IN (0, (SELECT max(r) FROM ev))", "navigator")(QUERIES["navigator"])


def _lttb_sql(n: int) -> str:
    """The points one after the other: each is chosen when the one before is known."""
    return f"""WITH RECURSIVE {EV}, n AS (SELECT count(*) AS n FROM ev),
cut AS (SELECT k, floor(1 + k * ((n - 2) / {n - 2}.0::DOUBLE))::BIGINT AS a FROM n, range({n - 1}) s(k)),
bk AS (SELECT c.k, c.a, d.a AS b FROM cut c JOIN cut d ON d.k = c.k + 1 UNION ALL SELECT {n - 2}, n - 1, n FROM n),
mean AS (SELECT k, avg(t) AS mt, avg(value) AS mv FROM bk JOIN ev ON r >= a AND r < b GROUP BY k),
pick AS (SELECT -1::BIGINT AS k, 0::BIGINT AS r, t, value FROM ev WHERE r = 0
UNION ALL SELECT p.k + 1, x.r, x.t, x.value FROM pick p, LATERAL (SELECT e.r, e.t, e.value FROM ev e, bk, mean m WHERE bk.k = p.k + 1 AND m.k = p.k + 2 AND e.r >= bk.a AND e.r < bk.b ORDER BY abs((p.t - m.mt) * (e.value - p.value) - (p.t - e.t) * (m.mv - p.value)) DESC, e.r LIMIT 1) x WHERE p.k < {n - 3})
SELECT round(t, 6) AS t, value AS v FROM pick UNION ALL SELECT round(t, 6), value FROM ev WHERE r = (SELECT n - 1 FROM n)"""


for _name, _n in (("draw_lttb", 60), ("draw_lttb_few", 12)):

    def _lttb(spark: SparkSession, sf_dir: str, n: int = _n) -> DataFrame:
        x, y = lttb_of(events(spark, sf_dir), "value", n)
        return rounded(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "t double, v double"), "t")

    query(_lttb_sql(_n), _name)(_lttb)


@query("WITH v AS (SELECT p_partkey AS t, p_retailprice AS y FROM part WHERE p_partkey < 128) SELECT round(f / 128.0, 9) AS frequency, round(sqrt(sum(y * cos(2 * pi() * f * t / 128)) ** 2 + sum(y * sin(2 * pi() * f * t / 128)) ** 2) / 128, 6) AS amplitude FROM v, range(65) s(f) GROUP BY f")
def spectrum(spark, sf_dir):
    s = R.load_series(spark, f"{sf_dir}/part.parquet", "p_partkey", ["p_retailprice"]).rows(0, 128)
    return rounded(rounded(A.spectrum_of(s, "p_retailprice"), "amplitude"), "frequency", digits=9)


@query("SELECT * FROM (VALUES (0.01::DOUBLE, '10 ms', '0.01 Hz'), (120.0, '2 min', '120 Hz'), (1234.5, '20.6 min', '1.23 kHz'), (0.0, '—', '—'), (-1.0, '—', '—')) v(x, interval_text, rate_text)")
def sampling_text(spark, sf_dir):
    return spark.createDataFrame([(x, format_interval(x), format_rate(x)) for x in (0.01, 120.0, 1234.5, 0.0, -1.0)], "x double, interval_text string, rate_text string")


@query("SELECT * FROM (VALUES ('z', 1, true, 'z'), ('z', 2, true, 'series'), ('z', 1, false, 'series'), ('time', 1, false, 'time'), ('time', 2, false, 'series'), ('series', 1, true, 'series')) v(wanted, ys, has_z, got)")
def xy_color_rule(spark, sf_dir):
    cases = [("z", 1, True), ("z", 2, True), ("z", 1, False), ("time", 1, False), ("time", 2, False), ("series", 1, True)]
    return spark.createDataFrame([(w, n, z, C.effective_color(w, n, "z" if z else None)) for w, n, z in cases], "wanted string, ys int, has_z boolean, got string")


# what is written is read again


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one that the session names for checkpoints, else a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/export-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp()}/export"


@query(f"WITH {IN_RANGE} SELECT event_id AS k, rg.value AS v, round((rg.value * 2)::FLOAT::DOUBLE, 4) AS twice FROM rg JOIN events e ON e.event_id = (SELECT min(event_id) FROM events) + rg.r")
def export_range(spark, sf_dir):
    """A range with a raw and a derived column, as float32, written to Parquet."""
    s = events(spark, sf_dir)
    t0 = s.df.agg(F.min("_t")).first()[0]
    plan = build_plan(spark, f"{sf_dir}/events.parquet", ["event_id", "value", "twice"], {"twice": "value * 2"}, "ts", x_range=(t0 + RANGE[0] * X.DAY, t0 + RANGE[1] * X.DAY), float32=True)
    export_parquet(spark, plan, path := _scratch(spark))
    return spark.read.parquet(path).select(F.col("event_id").alias("k"), F.col("value").alias("v"), F.round(F.col("twice").cast("double"), 4).alias("twice"))


@query("SELECT event_id AS k, round(value / 2, 6) AS half FROM events")
def export_view(spark, sf_dir):
    """All that a saved view shows, but for what can't be used."""
    with tempfile.TemporaryDirectory() as folder:
        view = View("shown", f"{sf_dir}/events.parquet", "ts", {"half": "value / 2", "bad": "nothing + 1"}, [["event_id", "half"], ["bad"]])
        view = load_view(save_view(folder, view))
    plan, left = plan_from_view(spark, view)
    export_parquet(spark, plan, path := _scratch(spark))
    return spark.read.parquet(path).select(F.col("event_id").alias("k"), F.round("half", 6).alias("half"))


@query(_bucket_sql("max", X.DAY, 0, 3600.0, only="SELECT count(*) AS buckets, round(max(value), 5) AS top FROM res"))
def export_buckets(spark, sf_dir):
    table = H.bucket_table(events(spark, sf_dir), ["value"], H.BucketSettings(agg="max"))
    write_buckets(spark, table, path := _scratch(spark))
    got = spark.read.parquet(path)
    value = next(c for c in got.columns if c.startswith("value"))
    return got.agg(F.count(F.lit(1)).alias("buckets"), F.round(F.max(F.col(f"`{value}`")), 5).alias("top"))


@query("SELECT epoch_us(date_trunc('day', ts)) / 1e6 AS bucket_start, epoch_us(date_trunc('day', ts)) / 1e6 + 86400 AS bucket_end, count(*) AS n, round(sum(value), 5) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL")
def stream_days(spark, sf_dir):
    """Buckets of a stream that reads the log's files once, all windows closed."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else f"{sf_dir}/event*.parquet")
    name = f"days_{uuid.uuid4().hex}"
    run = stream_buckets(stream, "ts", "value").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.table(name), "total", digits=5)


@query(f"WITH {EV} SELECT count(*) AS n, round(min(t), 6) AS lo, round(max(t), 6) AS hi, true AS ascending FROM ev")
def zone_bounds(spark, sf_dir):
    """Bounds and order of the axis from footers alone."""
    zones = R.zone_map(spark, f"{sf_dir}/events.parquet", "ts")
    one = zones.agg(F.sum("rows").alias("n"), F.round(F.min("lo"), 6).alias("lo"), F.round(F.max("hi"), 6).alias("hi"))
    return one.withColumn("ascending", F.lit(R.ascending_by_groups(zones)))


@query(f"WITH {EV} SELECT r AS _row, value FROM ev WHERE r BETWEEN 130 AND 420")
def window_rows(spark, sf_dir):
    """A range from a reader that holds parts of it already."""
    reader = R.WindowReader(events(spark, sf_dir), ["value"], 64, 4)
    reader.read(0, 200)
    got = reader.read(130, 421)["value"]
    return spark.createDataFrame([(130 + k, float(v)) for k, v in enumerate(got)], "_row long, value double")


@query("SELECT * FROM (VALUES ('level'), ('value')) v(name)")
def axis_names(spark, sf_dir):
    """What is left for a view whose axis is a stamp known by two names."""
    names = effective_available(["ts", "clock", "value", "level"], {"clock": "ts", "level": "value"}, "clock")
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


@query("SELECT count(*) AS n, count(*) * (8 + 8 + 32 + 8) AS bytes FROM events")
def export_size(spark, sf_dir):
    plan = build_plan(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type", "x"], {"x": "value + 1"}, "ts")
    got = estimate(spark, plan)
    return spark.createDataFrame([(got["rows"], got["bytes"])], "n long, bytes long")


@query(f"WITH {EV}, j AS (SELECT unnest(['events_a', 'events_b']) AS log) SELECT log, count(*) AS n, round(sum(value * 2), 3) AS total FROM ev, j GROUP BY log")
def export_batch(spark, sf_dir):
    """A view over two logs at a time."""
    folder, path = _scratch(spark), f"{sf_dir}/events.parquet"
    done = export_many(spark, View("v", path, "ts", {"x": "value * 2"}, [["x"]]), [path, path], folder, stamp="s")
    parts = [spark.read.parquet(d["path"]).agg(F.count("x").alias("n"), F.round(F.sum("x"), 3).alias("total")).select(F.lit(f"events_{c}").alias("log"), "n", "total") for c, d in zip("ab", done, strict=True)]
    return parts[0].unionByName(parts[1])


@query("SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount) * 1.5, 6) AS a FROM lineitem")
def function_store(spark, sf_dir):
    """A function saved, loaded and called."""
    with tempfile.TemporaryDirectory() as folder:
        save_functions(f"{folder}/f.json", Registry().add(UserFunction("net", ("price", "off"), "price * (1 - off) * factor", {"factor": 1.5})))
        registry = load_functions(f"{folder}/f.json")[0]
    s = lines(spark, sf_dir, "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber").derive({"a": "net(l_extendedprice, l_discount)"}, registry)
    return s.df.select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("n"), F.round("a", 6).alias("a"))


@query("SELECT event_id AS k, value AS level FROM events")
def alias_store(spark, sf_dir):
    """Aliases saved and loaded; one that is switched off isn't used."""
    with tempfile.TemporaryDirectory() as folder:
        save_aliases(f"{folder}/a.json", [Alias("level", ["height", "value"]), Alias("off", ["value"], False)])
        known = active_aliases(load_aliases(f"{folder}/a.json")[0])
    s = events(spark, sf_dir, "value", "event_id").renamed(known)
    return s.df.select(F.col("event_id").cast("long").alias("k"), *(c for c in s.df.columns if c in ("level", "off")))


@query("SELECT * FROM (VALUES ('', 'blank'), ('sqrt', 'reserved'), ('level', 'duplicate'), ('none', 'no_candidates'), ('fine', NULL)) v(alias, refusal)")
def alias_checks(spark, sf_dir):
    there = [Alias("level", ["value"])]
    tried = [Alias("", ["value"]), Alias("sqrt", ["value"]), Alias("level", ["value"]), Alias("none", [" "]), Alias("fine", ["value"])]
    return spark.createDataFrame([(a.name, validate_alias(a, there)) for a in tried], "alias string, refusal string")


@query("SELECT * FROM (VALUES ('downsample_ratio', 3), ('eager_load_limit_mb', 512), ('export_parallel', 2)) v(setting, held)")
def settings_store(spark, sf_dir):
    """One setting changed, one broken by hand, one left."""
    with tempfile.TemporaryDirectory() as folder:
        save_settings(f"{folder}/s.json", {"downsample_ratio": 3, "export_parallel": "many"})
        return spark.createDataFrame(sorted(load_settings(f"{folder}/s.json").items()), "setting string, held int")


@query("SELECT * FROM (VALUES ('export', 'a', true), ('export', 'b', false)) v(kind, name, ok)")
def operation_log(spark, sf_dir):
    """Two of three logged operations, chosen by kind."""
    path = f"{tempfile.mkdtemp()}/log.jsonl"
    for kind, name, ok in (("export", "a", True), ("draw", "x", True), ("export", "b", False)):
        log_operation(path, kind, name=name, ok=ok)
    return timeline(spark, f"file://{path}", ["export"]).select("kind", "name", "ok")


@query("SELECT * FROM (VALUES ('a', 1), ('b', 0), ('c', 1)) v(series, shown)")
def hidden_series(spark, sf_dir):
    view = View("v", "x", None, {}, [["a", "b"], ["c"]], looks=[{"series": [{}, {"visible": False}]}])
    shown = {n for p in view.visible_plots() for n in p}
    return spark.createDataFrame([(n, int(n in shown)) for n in "abc"], "series string, shown int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a range, a conditional formula of them, and its daily integral from 06:00 with completeness."""
    s = ranged(events(spark, sf_dir)).derive({"power": "where(value > 10, value * 3.6, 0)"})
    return H.bucket_table(s, ["power"], H.BucketSettings(X.DAY, 6 * 3600, "integral"))
