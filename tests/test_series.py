"""Loading, ranges, ordered functions, statistics, diagnostics."""

import dataclasses
import math
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import stats as A
from tidemark.operators.downsample import drawn, envelope_points, format_interval, format_rate, lttb, nice_ticks, normalize, overview, pick_nearest, project
from tidemark.plans.expression import ExpressionError
from tidemark.sources import series as R

START = datetime(2024, 3, 1)


def write(path, t, **columns):
    pq.write_table(pa.table({"time": t, **columns}), path, row_group_size=50)
    return str(path)


@pytest.fixture(scope="module")
def wave(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    n = 500
    x = rng.normal(size=n)
    x[rng.integers(0, n, 30)] = np.nan
    x[[7, 300]] = np.inf, -np.inf
    path = write(tmp_path_factory.mktemp("d") / "w.parquet", [START + timedelta(seconds=k) for k in range(n)], x=x, y=np.arange(n) % 17, f=np.arange(n, dtype=np.float32), flag=np.arange(n) % 2 == 0, text=["s"] * n)
    return R.load_series(spark, path), x, path


def column(s, name):
    return s.df.orderBy("_row").toPandas()[name].to_numpy(float)


def test_load(spark, wave, tmp_path):
    s, x, path = wave
    assert s.signals == ("x", "y", "f", "flag") and s.time_column == "time"
    np.testing.assert_array_equal(column(s, "x"), x)
    assert column(s, "_t")[1] - column(s, "_t")[0] == 1.0 and column(s, "flag")[:2].tolist() == [1.0, 0.0]
    with pytest.raises(R.NonNumericColumnError):
        R.load_series(spark, path, "time", ["text"])
    nulls = write(tmp_path / "n.parquet", [1.0, 2.0], v=pa.array([None, 3], pa.int32()))
    assert math.isnan(column(R.load_series(spark, nulls), "v")[0])
    assert [g["rows"] for g in R.row_groups(path)][:2] == [50, 50]
    assert R.time_axis_candidates(spark.read.parquet(path).schema) == ["time", "x", "y", "f"]


def test_several_files_follow_one_another(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        write(tmp_path / "d" / f"p{k}.parquet", [float(10 * k + j) for j in range(4)], v=[float(k)] * 4)
    s = R.load_series(spark, str(tmp_path / "d"))
    assert s.df.orderBy("_row").toPandas()["_t"].tolist() == [10.0 * k + j for k in range(3) for j in range(4)]
    assert sorted(r._row for r in s.df.collect()) == list(range(12))


def naive(x, before, after, skip):
    out = np.full(len(x), np.nan)
    for k in range(len(x)):
        w = x[max(0, k - before) : k + after + 1]
        w = w[~np.isnan(w)] if skip else w
        with np.errstate(all="ignore"):
            out[k] = w.mean() if len(w) else np.nan
    return out


@pytest.mark.parametrize("block", [40, 170, 1_000_000])
def test_ordered_functions(wave, block):
    s, x, _ = wave
    texts = {"d": "delta(x)", "r": "rolling_mean(x, 10)", "rn": "rolling_nanmean(x, 7)", "t": "trailing_mean(x, 4)", "tn": "trailing_nanmean(x, 5)", "n": "rolling_nanmean(delta(y), 3)", "wide": "rolling_nanmean(y, 9999)", "c": "delta(3) + rolling_mean(2, 5)"}
    got = s.derive(texts, block_rows=block)
    y = np.arange(500.0) % 17
    dy = np.diff(y, prepend=y[0])
    with np.errstate(all="ignore"):
        want = {"d": np.concatenate([[0], np.diff(x)]), "r": naive(x, 5, 4, False), "rn": naive(x, 3, 3, True), "t": naive(x, 3, 0, False), "tn": naive(x, 4, 0, True), "n": naive(dy, 1, 1, True), "wide": naive(y, 250, 249, True), "c": np.full(500, 2.0)}
    frame = got.df.orderBy("_row").toPandas()
    assert len(frame) == 500
    for name, w in want.items():
        np.testing.assert_allclose(frame[name].to_numpy(float), w, rtol=1e-9, atol=1e-12, err_msg=name)


def test_derived_names(wave):
    s, _, _ = wave
    with pytest.raises(ExpressionError):
        s.derive({"x": "y + 1"})
    chained = s.derive({"b": "a * 2", "a": "y + 1"})
    assert column(chained, "b")[:3].tolist() == [2.0, 4.0, 6.0]
    assert column(s.derive({"z": "time - time"}), "z").max() == 0


def test_ranges(wave):
    s, _, _ = wave
    t = column(s, "_t")
    assert R.find_row_range(s, t[10], t[20]) == (10, 21) and R.find_row_range(s, t[10] + 0.5, t[10] + 0.6) == (0, 0)
    assert s.between(t[10], t[20]).df.count() == 11 and s.rows(-5, 3).df.count() == 3 and s.rows(5, 2).df.count() == 0
    assert R.drawing_range(s, t[10], t[20]).count() == 13
    assert sorted(r._row for r in R.strided(s, 10, 5, 500).collect()) == list(range(5, 500, 49))
    hits = {r.x: r._row for r in R.nearest_rows(s, [t[0] - 9, t[3] + 0.5, t[3] + 0.6, t[-1] + 5]).collect()}
    assert list(hits.values()) == [0, 3, 4, 499]
    plan = s.between(t[10], t[20]).df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan


def test_rows_by_value(wave):
    s, _, _ = wave
    rect = R.in_rectangle(s, "y", ["f"], (3, 4), (0, 100))
    assert sorted(r._row for r in rect.collect()) == [k for k in range(101) if k % 17 in (3, 4)]
    assert R.without_rows(s.df, rect).count() == 500 - rect.count()
    named = s.renamed({"level": ["nothing", "y"], "x": ["y"]})
    assert named.signals == ("x", "y", "f", "flag", "level")


def test_statistics(wave):
    s, x, _ = wave
    ok = x[np.isfinite(x)]
    r = A.basic_stats(s, ["x"]).first()
    assert (r["count"], r.nan_count, r.min, r.max) == (500, 500 - len(ok), ok.min(), ok.max())
    np.testing.assert_allclose([r["mean"], r.std, r.median], [ok.mean(), ok.std(), np.median(ok)], rtol=1e-12)
    none = A.basic_stats(s.rows(0, 0), ["x"]).first()
    assert none["count"] == 0 and math.isnan(none["mean"]) and math.isnan(none.median)
    assert A.bounds(s, ["x", "y"]).first().hi == 16.0
    both = A.joint_bounds(s, ["x", "y"]).first()
    assert both.n_valid == len(ok) and both.x_max == ok.max()
    assert A.effective_rate(s, "x").first().rate_hz == pytest.approx(len(ok) / 499)


def test_exact_ranks_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(A, "FINE_BINS", 4)
    monkeypatch.setattr(A, "LAST_ROWS", 3)
    values = [0.0, 1e-9, 2e-9, 3.0, 3.0, 3.0, 3.0, 1e300, -1e300, 5.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = A.order_statistics(frame, F.col("v"), list(range(10)), -1e300, 1e300)
    assert [got[k] for k in range(10)] == sorted(values)


@pytest.mark.parametrize(("t", "want"), [([0, 1, 2, 3], (0, 0, 0, None, True)), ([0, 2, 1, 1, math.nan, 5], (1, 1, 1, 2, False)), ([5.0], (0, 0, 0, None, True)), ([], (0, 0, 0, None, True))])
def test_time_order(spark, tmp_path, t, want):
    s = R.load_series(spark, write(tmp_path / "t.parquet", pa.array(t, pa.float64()), v=pa.array([1.0] * len(t), pa.float64())))
    r = A.time_order(s).collect()
    if t:
        assert (r[0].n_nonfinite, r[0].n_decreases, r[0].n_duplicates, r[0].first_bad_row, r[0].ok) == want


def test_time_order_across_blocks(spark):
    frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 2, math.nan, math.nan, 3, 2, 9, 10])], "_row long, _t double")
    got = A._blocked_previous(frame, ~F.isnan("_t"), 2).orderBy("_row").collect()
    assert [None if r["__prev"] is None else r["__prev"]["_t"] for r in got] == [None, 1.0, 2.0, 2.0, 2.0, 3.0, 2.0, 9.0]


@pytest.mark.parametrize(("t", "reason"), [([0, 1], "too_few"), ([0, 1, math.inf], "not_finite"), ([0, 1, 1], "not_ascending"), ([0, 1, 2, 4], "non_uniform"), ([0, 1, 2, 3], "ok")])
def test_sampling(spark, tmp_path, t, reason):
    s = R.load_series(spark, write(tmp_path / "t.parquet", [float(v) for v in t], v=[1.0] * len(t)))
    assert A.sampling_report(s).first().reason == reason
    if reason == "ok":
        assert A.spectrum_of(s, "v").orderBy("frequency").first().amplitude == pytest.approx(1.0)
    else:
        with pytest.raises(ValueError):
            A.spectrum_of(s, "v")


def test_spectrum():
    t = np.arange(1000) / 100
    f, a = A.spectrum(t, np.sin(2 * np.pi * 5 * t))
    assert f[a.argmax()] == pytest.approx(5.0) and a.max() == pytest.approx(0.5)
    with pytest.raises(ValueError):
        A.spectrum(np.zeros(5), np.zeros(5))


def test_envelope_and_drawing(wave):
    s, x, _ = wave
    env = A.envelope(s, "x", 64).orderBy("bucket").toPandas()
    for k, r in env.iterrows():
        own = x[64 * k : 64 * k + 64]
        own = own[np.isfinite(own)]
        assert (r["lo"], r["hi"]) == (own.min(), own.max())
    assert envelope_points(s, "x", 64).count() == 16
    tx, ty = drawn(s, "f", 50)
    assert len(tx) == 50 and ty[0] == 0 and ty[-1] == 499 and (np.diff(tx) > 0).all()
    few, _ = drawn(s, "f", 20, limit=100)
    assert len(few) <= 20 and overview(s, "f", 10).count() > 2


def test_lttb():
    x = np.arange(300.0)
    y = np.sin(x / 9)
    y[50] = np.nan
    px, py = lttb(x, y, 30)
    assert len(px) == 30 and px[0] == 0 and px[-1] == 299 and set(px) <= set(x) and np.isfinite(py).all()
    assert lttb(x, y, 400)[0] is x
    assert len(lttb(x, y, 2)[0]) == 3
    gap = np.where((x >= 100) & (x < 200), np.nan, y)
    assert np.isfinite(lttb(x, gap, 8)[0]).all()


def test_lttb_of_all_rows(spark, tmp_path):
    """The same points as from all rows at once, with gaps and ties, and with rows left out."""
    from tidemark.operators.downsample import lttb_of

    rng = np.random.default_rng(5)
    t, v = np.cumsum(rng.exponential(1, 30_000)) + 1.7e9, np.round(rng.gamma(2, 20, 30_000), 2)
    v[rng.random(30_000) < 0.05] = np.nan
    v[9000:13_000], v[20_000:24_000] = np.nan, 7.0
    pq.write_table(pa.table({"t": t, "v": v}), tmp_path / "long.parquet", row_group_size=3000)
    s = R.load_series(spark, str(tmp_path / "long.parquet"), "t", ["v"])
    for n in (3, 12, 60):
        for got, want in zip(lttb_of(s, "v", n), lttb(t, v, n), strict=True):
            assert np.array_equal(got, want, equal_nan=True)
    some = s.between(t[100], t[20_000])
    holed = dataclasses.replace(some, df=some.df.where("_row % 7 != 3"))
    own = np.array([k for k in range(100, 20_001) if k % 7 != 3])
    assert np.array_equal(lttb_of(holed, "v", 40), lttb(t[own], v[own], 40), equal_nan=True)
    assert len(lttb_of(s.rows(0, 4), "v", 12)[0]) == 4


def test_drawing_reads_all_rows(spark, monkeypatch):
    from tidemark.operators import downsample
    from tidemark.queries import QUERIES

    want = QUERIES["draw_lttb_few"](spark, DATA).collect()
    monkeypatch.setattr(downsample.drawn, "__defaults__", (10,))  # beyond so few rows an envelope stands for the rows
    assert QUERIES["draw_lttb_few"](spark, DATA).collect() == want


def test_helpers():
    assert normalize(np.array([1.0, 3.0]), 1, 5).tolist() == [0.0, 0.5] and normalize(np.array([1.0]), 2, 2).tolist() == [0.5]
    assert nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10]
    assert format_rate(1234.5) == "1.23 kHz" and format_interval(0.01) == "10 ms"
    assert [format_interval(t) for t in (120, 59.99, 0.9999, 1.5, 6000, 3e-12, 0, -1, math.nan)] == ["2 min", "1 min", "1 s", "1.5 s", "100 min", "0.003 ns", "\u2014", "\u2014", "\u2014"]
    assert [format_rate(f) for f in (999.6, 5e9, 0.25, 0)] == ["1 kHz", "5000 MHz", "0.25 Hz", "\u2014"]
    assert nice_ticks(math.nan, 1) and normalize(np.zeros(2), 0, math.inf).tolist() == [0.5, 0.5]
    cube = np.array([[0, 0, 0], [1, 1, 1.0]])
    assert pick_nearest(project(cube, 30, 20), tuple(project(cube, 30, 20)[1]), 0.1) == 1 and pick_nearest(project(cube, 0, 0), (9, 9), 0.1) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    s = R.load_series(spark, f"{DATA}/events.parquet", "ts", ["value"])
    assert s.row_count() == 1000


def test_zone_map_and_windows(spark, tmp_path):
    """Footers on the numeric scale; blocks give the same rows as a plain read, and few are held."""
    import pandas as pd

    n = 1000
    frame = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=n, freq="s").astype("datetime64[us]"), "v": np.where(np.arange(n) % 7 == 0, np.nan, np.arange(n, dtype=float)), "s": "x"})
    path = str(tmp_path / "log.parquet")
    frame.to_parquet(path, row_group_size=100)
    zones = R.zone_map(spark, path, "t").orderBy("offset").collect()
    assert len(zones) == 10 and [z.offset for z in zones] == list(range(0, n, 100)) and zones[3].lo == pd.Timestamp("2024-01-01 00:05:00").timestamp()
    assert R.ascending_by_groups(R.zone_map(spark, path, "t")) and not R.ascending_by_groups(spark.createDataFrame([(0, 1.0, 5.0), (1, None, None), (2, 4.0, 9.0)], "offset long, lo double, hi double"))
    with pytest.raises(R.NonNumericColumnError):
        R.zone_map(spark, path, "s")
    reader = R.WindowReader(R.load_series(spark, path, "t", ["v"]), ["v"], 64, 3)
    for a, b in ((0, 10), (60, 70), (-5, 200), (150, 420), (990, 2000), (5, 5)):
        np.testing.assert_array_equal(reader.read(a, b)["v"], frame["v"].to_numpy()[max(0, a) : max(0, b)])
    assert len(reader.blocks) <= 3
