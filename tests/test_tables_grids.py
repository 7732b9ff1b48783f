"""Lookup tables, clouds, grids, stores, exports, converters."""

import json
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions.lookup import Table, TableError
from tidemark.operators import grid as G
from tidemark.operators import xy as C
from tidemark.plans.expression import Registry, UserFunction
from tidemark.sources import convert, export, stores
from tidemark.sources.series import load_series
from tidemark.sources.tables import TableStore, format_table, parse_table

X, Y = (0.0, 1.0, 4.0, 5.0), (2.0, -1.0, 3.0, 0.5)
EVEN = (0.0, 1.0, 2.0, 3.0)
Z = ((1.0, 2.0, 4.0, 8.0), (3.0, math.nan, 9.0, 1.0), (0.0, 5.0, 2.0, 2.0))
PLACES = [-2.0, 0.0, 0.25, 0.5, 0.75, 1.0, 2.5, 3.999, 4.0, 4.5, 5.0, 7.5, math.nan, math.inf, -math.inf]


@pytest.mark.parametrize("how", ["linear", "nearest", "previous", "spline"])
@pytest.mark.parametrize("outside", ["clamp", "zero", "linear", "nan"])
@pytest.mark.parametrize("x", [X, EVEN])
def test_curve_columns_equal_numbers(spark, how, outside, x):
    t = Table("curve", x, Y, None, how, (outside, outside))
    frame = spark.createDataFrame([(v,) for v in PLACES], "v double").coalesce(1)
    got = frame.select(t.column(F.col("v")).alias("y")).toPandas()["y"].to_numpy(float)
    with np.errstate(all="ignore"):
        want = t.compute(np.array(PLACES))
    np.testing.assert_allclose(got[:13], want[:13], rtol=1e-12, atol=1e-12)
    for v, y in zip(x, Y):
        assert t(v) == pytest.approx(y)
    assert math.isnan(t(math.nan)) and (outside != "zero" or t(99) == 0) and (outside != "clamp" or t(99) == pytest.approx(Y[-1]))
    if how == "linear":
        assert t((x[0] + x[1]) / 2) == pytest.approx(0.5)
        np.testing.assert_allclose(t.compute(np.linspace(x[0], x[-1], 50)), np.interp(np.linspace(x[0], x[-1], 50), x, Y))


@pytest.mark.parametrize("how", ["linear", "nearest", "previous"])
def test_map_columns_equal_numbers(spark, how):
    t = Table("map", X, Z, (0.0, 10.0, 20.0), how, ("linear", "nan"))
    rows = [(a, b) for a in PLACES[:13] for b in (-1.0, 0.0, 5.0, 10.0, 14.0, 20.0, 21.0, math.nan)]
    got = spark.createDataFrame(rows, "a double, b double").coalesce(1).select(t.column(F.col("a"), F.col("b")).alias("z")).toPandas()["z"].to_numpy(float)
    np.testing.assert_allclose(got, t.compute(*np.array(rows).T), rtol=1e-12)
    assert t(0.0, 10.0) == 3.0 and math.isnan(t(1.0, 10.0)) and t(4.0, 10.0) == 9.0


def test_spline_is_smooth():
    x = np.linspace(0, 3, 7)
    t = Table("curve", tuple(x), tuple(np.sin(x)), None, "spline")
    assert np.abs(t.compute(np.linspace(0, 3, 100)) - np.sin(np.linspace(0, 3, 100))).max() < 0.02


def test_bad_tables():
    for make in (lambda: Table("curve", (1.0,), (1.0,)), lambda: Table("curve", (1.0, 1.0), (1.0, 2.0)), lambda: Table("curve", (0.0, 1.0), (math.nan,) * 2), lambda: Table("curve", (0.0, 1.0), (1.0, math.nan), None, "spline"), lambda: Table("map", (0.0, 1.0), ((1.0, 2.0),) * 2, (0.0, 1.0), "spline"), lambda: Table("map", (0.0, 1.0), ((1.0, 2.0),), (0.0, 1.0)), lambda: Table("curve", (0.0, 1.0), (1.0, 2.0), None, "linear", ("far", "far"))):
        with pytest.raises(TableError):
            make()


def test_csv(tmp_path):
    assert parse_table("x,y\n0,1\n2,\n3,4\n").x == (0.0, 2.0, 3.0)
    m = parse_table("﻿,1,2,3\n10,1,2,3\n20,4,,nan\n".lstrip("﻿"))
    assert m.kind == "map" and m.y == (10.0, 20.0) and math.isnan(m.values[1][1])
    for t in (m, Table("curve", X, Y)):
        again = parse_table(format_table(t))
        assert again.x == t.x and np.array_equal(np.array(again.values), np.array(t.values), equal_nan=True)
    for text in ("", "1\n", "x,y\n1,2\n1,3\n", "0,1\n1,a\n", "0,1\n1,2,3\n", ",1,2\n5,1,2\n4,1,2\n", "0,1\n,2\n", "1,2,3\n4,5,6\n"):
        with pytest.raises(TableError):
            parse_table(text)


def test_table_store(tmp_path):
    source = tmp_path / "in.csv"
    source.write_bytes("回転,値\n0,1\n2,5\n".encode("cp932"))
    store = TableStore(str(tmp_path / "tables"))
    assert store.add(str(source), "torque").x == (0.0, 2.0)
    store.change("torque", interpolation="nearest")
    store.rename("torque", "power")
    assert store.names() == ["power"] and store.load("power").interpolation == "nearest"
    source.write_text("0,1\n0,2\n")
    with pytest.raises(TableError):
        store.replace("power", str(source))
    for name in ("abs", "1x", "power"):
        with pytest.raises(TableError):
            store.add(str(source), name)
    (tmp_path / "tables" / "bad.csv").write_text("x")
    (tmp_path / "tables" / "bad.json").write_text("{}")
    good, bad = store.load_all()
    assert list(good) == ["power"] and list(bad) == ["bad"]
    store.delete("power")
    assert store.names() == ["bad"]


@pytest.fixture(scope="module")
def lines(spark):
    return load_series(spark, f"{DATA}/lineitem.parquet", "l_shipdate", ["l_quantity", "l_discount", "l_extendedprice", "l_tax"])


def test_clouds(lines):
    n = lines.row_count()
    b = C.xy_bounds(lines, "l_quantity", ["l_tax"], "l_discount").first()
    assert b.n_valid == n and b.x_max == 50.0
    some = C.xy_scatter(lines, "l_quantity", ["l_tax", "l_discount"], limit=1000)
    assert 800 <= some.count() <= 1000 and C.xy_scatter(lines, "l_quantity", ["l_tax"]).count() == n
    dense = C.xy_density(lines, "l_quantity", ["l_tax", "l_discount"], bins=16)
    frame = lines.df.toPandas()
    both = np.concatenate([frame["l_tax"], frame["l_discount"]])
    want, _, _ = np.histogram2d(np.tile(frame["l_quantity"], 2), both, 16, [[1, 50], [both.min(), both.max()]])
    assert dense.agg({"n": "sum"}).first()[0] == 2 * n and abs(dense.agg({"n": "max"}).first()[0] - want.max()) <= 0.01 * n
    assert C.xyz_points(lines, "l_quantity", "l_tax", "l_discount", 500).count() <= 500
    assert C.is_density(200_001) and not C.is_density(200_000)
    assert [C.effective_color(c, k, z) for c, k, z in (("z", 1, "q"), ("z", 2, "q"), ("time", 1, None), ("time", 2, None))] == ["z", "series", "time", "series"]
    assert C.xy_density(lines.rows(0, 0), "l_quantity", ["l_tax"]).count() == 0


def test_indexed_in_blocks(spark):
    frame = spark.range(0, 500, 3).withColumnRenamed("id", "_row")
    assert [r._i for r in C.indexed(frame, 64).orderBy("_row").collect()] == list(range(167))


@pytest.mark.parametrize("agg", G.AGGREGATIONS[:5])
@pytest.mark.parametrize("x", [[5.0, 15.0, 30.0, 50.0], [10.0, 20.0, 30.0, 40.0]])
def test_grid(lines, agg, x):
    y = [0.0, 0.05, 0.1]
    g = G.grid_map(lines, "l_quantity", "l_discount", "l_extendedprice", x, y, agg, 5)
    frame = lines.df.toPandas()
    ix, iy = (np.searchsorted(G.cell_edges(p), frame[c], "right") - 1 for p, c in ((x, "l_quantity"), (y, "l_discount")))
    made = {"mean": np.mean, "median": np.median, "max": np.max, "min": np.min, "count": len}[agg]
    outside = (ix < 0) | (ix >= len(x)) | (iy < 0) | (iy >= 3)
    for r in g.cells.collect():
        own = frame["l_extendedprice"][(ix == r.ix) & (iy == r.iy) & ~outside]
        assert r.n == len(own)
        want = made(own) if agg == "count" or len(own) >= 5 else None
        assert r.value == (pytest.approx(want) if want is not None else None)
    assert g.status.first().n_outside == outside.sum()


def test_axes():
    assert G.AxisSpec("step", 0, 1, 0.1).points() == [round(k / 10, 12) for k in range(11)] and G.AxisSpec("count", 0, 1, count=3).points() == [0, 0.5, 1]
    for bad in (("step", 0, 1, 0), ("step", 1, 0, 0.1), ("step", 0, 1000, 1), ("count", 0, 1, 0, 1), ("count", 0, 1, 0, 501), ("step", 0, math.inf, 1)):
        with pytest.raises(G.GridError):
            G.AxisSpec(*bad).points()
    a = G.nice_axis(0.3, 97)
    assert (a.lo, a.step, a.hi) == (0, 5, 100)
    assert G.cell_edges([0, 2, 3]) == [-1, 1, 2.5, 3.5]


def test_fills():
    z = np.full((20, 30), np.nan)
    z[0], z[-1], z[:, 0], z[:, -1] = 0, 19, np.arange(20), np.arange(20)
    np.testing.assert_allclose(G.fill_smooth(z), np.tile(np.arange(20.0)[:, None], 30), atol=1e-5)
    line = np.array([[np.nan, 1, np.nan, np.nan, 4, np.nan]])
    assert G.fill_smooth(line).tolist() == [[1, 1, 2, 3, 4, 4]] and G.fill_nearest(line).tolist() == [[1, 1, 1, 4, 4, 4]]
    with pytest.raises(G.GridError):
        G.fill(np.full((2, 2), np.nan), "smooth")
    assert np.isnan(G.fill(line, "none")).sum() == 4


def test_contours():
    assert G.plan_levels(0, 10, 2.5) == [2.5, 5, 7.5] and G.plan_levels(0, 1, values=[0.5, 0, 2]) == [0.5] and len(G.plan_levels(0.1, 9.9)) == 9
    with pytest.raises(G.GridError):
        G.plan_levels(0, 1, 1e-9)
    x = y = np.linspace(-2, 2, 41)
    z = x[None, :] ** 2 + y[:, None] ** 2
    segments = G.contour_segments(x, y, z, 1.0)
    assert len(segments) > 40 and all(abs(math.hypot(a, b) - 1) < 0.01 for s in segments for a, b in (s[:2], s[2:]))
    z[20, 30] = np.nan
    assert len(G.contour_segments(x, y, z, 1.0)) < len(segments)
    assert len(G.contour_segments([0, 1], [0, 1], np.array([[1.0, 0], [0, 1]]), 0.5)) == 2


def test_table_from_grid(lines):
    g = G.grid_map(lines, "l_quantity", "l_discount", "l_extendedprice", [10.0, 30.0], [0.02, 0.08])
    t = G.table_from_grid(g, "nearest")
    assert t(10.0, 0.02) == pytest.approx(G.grid_array(g)[0, 0])


def test_views(tmp_path):
    view = stores.View("day", str(tmp_path / "log.parquet"), "ts", {"p": "value * 2"}, [["p", "value"]], (1.0, 2.0), False)
    path = stores.save_view(str(tmp_path / "v"), view)
    assert stores.load_view(path) == view and stores.list_views(str(tmp_path / "v")) == ["day"]
    body = json.loads(open(path).read())
    body["plots"][0]["series"][0]["variable"] = 3
    open(path, "w").write(json.dumps(body | {"unknown": 1}))
    with pytest.raises(stores.ViewError, match=r"plots\[0\].series\[0\].variable"):
        stores.load_view(path)
    stores.delete_view(str(tmp_path / "v"), "day")
    assert stores.list_views(str(tmp_path / "v")) == []


def test_small_stores(spark, tmp_path):
    path = str(tmp_path / "f.json")
    registry = Registry().add(UserFunction("half", ("x",), "x / 2"))
    stores.save_functions(path, registry, [{"name": "bad"}])
    assert stores.load_functions(path) == (registry, [{"name": "bad"}])
    open(path, "w").write("{")
    assert stores.load_functions(path)[0] == Registry() and any("broken" in p.name for p in tmp_path.iterdir())
    aliases = [stores.Alias("level", ["a", "b"]), stores.Alias("off", ["c"], False)]
    stores.save_aliases(path, aliases)
    assert stores.load_aliases(path)[0] == aliases and stores.active_aliases(aliases) == {"level": ["a", "b"]}
    assert [stores.validate_alias(stores.Alias(n, c), aliases) for n, c in ((" ", ["a"]), ("abs", ["a"]), ("level", ["a"]), ("x", []), ("x", ["a"]))] == ["blank", "reserved", "duplicate", "no_candidates", None]
    stores.save_settings(path, {"downsample_ratio": 3})
    assert stores.load_settings(path)["downsample_ratio"] == 3 and stores.load_settings(str(tmp_path / "none"))["eager_load_limit_mb"] == 512
    log = str(tmp_path / "log.jsonl")
    for k in range(3):
        stores.log_operation(log, "job" if k else "open", name=f"n{k}", seconds=0.5)
    open(log, "a").write("broken\n")
    assert [r.name for r in stores.timeline(spark, log, ["job"]).collect()] == ["n1", "n2"]


def test_export(spark, tmp_path):
    log = f"{DATA}/events.parquet"
    view = stores.View("v", log, "ts", {"double": "value * 2", "smooth": "rolling_mean(double, 5)", "bad": "nope + 1"}, [["value", "smooth", "gone"]])
    plan, skipped = export.plan_from_view(spark, view)
    assert skipped == {"gone": "missing_column", "bad": "missing_column"}
    got = export.export_parquet(spark, plan, f"{tmp_path}/out.parquet")
    frame = spark.read.parquet(f"{tmp_path}/out.parquet")
    assert got == {"rows": 1000, "infinite": {}} and frame.columns == ["ts", "value", "smooth", "double"] and dict(frame.dtypes)["ts"] == "timestamp_ntz"
    assert frame.where("abs(double - 2 * value) > 1e-9").count() == 0
    assert json.loads(open(f"{tmp_path}/out.parquet/_about.json").read())["derived"]["double"] == "value * 2"
    for path in (f"{tmp_path}/out.parquet", log):
        with pytest.raises(export.ExportError):
            export.export_parquet(spark, plan, path)
    t = [r.ts.timestamp() for r in spark.read.parquet(log).select("ts").limit(30).collect()]
    part = export.build_plan(spark, log, ["big"], {"big": "value * 1e300"}, "ts", x_range=(t[10], t[19]), float32=True)
    assert export.export_parquet(spark, part, f"{tmp_path}/part.parquet", True)["infinite"] == {"big": 10}
    with pytest.raises(export.ExportError):
        export.build_plan(spark, log, ["nothing"], {})
    done = export.export_many(spark, view, [log, f"{DATA}/region.parquet", log], str(tmp_path / "many"), stamp="s")
    assert [d["path"] is None for d in done] == [False, True, False] and done[2]["path"].endswith("_v_s_2.parquet")


def test_bucket_sink(spark, tmp_path):
    rows = [("a", 0.0, 86400.0, 1.5, True, None), ("a", 86400.0, 172800.0, None, False, None), ("a_at", 0.0, 86400.0, 2.0, True, 5.0)]
    table = spark.createDataFrame(rows, "variable string, bucket_start double, bucket_end double, value double, complete boolean, at double")
    wide = export.wide_buckets(table)
    assert wide.columns == ["window_start", "window_end", "a", "a_complete", "a_at", "a_at_2", "a_at_complete", "a_at_at"]
    assert [r.a for r in wide.orderBy("window_start").collect()] == [1.5, None]
    export.write_buckets(spark, wide, f"{tmp_path}/b.csv", "csv", {"x": 1})
    assert spark.read.option("header", True).csv(f"{tmp_path}/b.csv").count() == 2
    assert export.wide_buckets(table, "Asia/Tokyo").orderBy("window_start").first().window_start.hour == 9


def test_convert(tmp_path):
    columns, notes = convert.columns_of({"__x": 1, "Time": np.arange(3.0)[:, None], "a": np.arange(3), "b": np.arange(2), "s": np.array(["x"])})
    assert list(columns) == ["Time", "a"] and len(notes) == 2
    path = str(tmp_path / "o.parquet")
    assert convert.write_columns(columns, path) == [] and pq.read_table(path).num_rows == 3
    assert len(convert.write_columns({"t": np.array([1.0, np.nan, 0.5]), "v": np.zeros(3)}, path)) == 2
    for bad in ({}, {"t": np.zeros(0), "v": np.zeros(0)}):
        with pytest.raises(convert.ConvertError):
            convert.write_columns(bad, path)
    merged = convert.align({"a": (np.array([0.0, 1, 2]), np.array([1, 2, 3])), "b": (np.array([1.0, 3]), np.array([5, 6]))})
    assert merged["time"].tolist() == [0, 1, 2, 3] and merged["b"][1] == 5 and np.isnan(merged["b"][2])
    assert convert.align({"a": (np.array([0.0, 1, 2]), np.array([1, 2, 3]))}, 0.5)["a"].tolist() == [1, 1, 2, 2, 3]
    with pytest.raises(convert.ConvertError):
        convert.align({"a": (np.array([1.0, 0]), np.array([1, 2]))})
    assert convert.main([str(tmp_path / "x.foo")]) == 1


def test_stream(spark, tmp_path):
    from tidemark.streaming.buckets import stream_buckets

    rows = spark.read.parquet(f"{DATA}/events.parquet")
    source = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(source)
    stream = stream_buckets(spark.readStream.schema(rows.schema).parquet(source), "ts", "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(n) n, round(sum(total), 6) t FROM buckets").first()
    want = rows.selectExpr("count(value) n", "round(sum(value), 6) t").first()
    assert (got.n, got.t) == (want.n, want.t)
