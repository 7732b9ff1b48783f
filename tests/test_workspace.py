"""Workspaces, background jobs and the export queue."""

import pytest

from tests.conftest import DATA
from tidemark.plans.expression import ExpressionError, Registry, UserFunction
from tidemark.plans.workspace import Jobs, Queue, Request, Workspace
from tidemark.sources.series import load_series


@pytest.fixture(scope="module")
def space(spark):
    return Workspace(load_series(spark, f"{DATA}/events.parquet", "ts", ["value", "user_id"]))


def test_derived_variables(space):
    s = space.put("a", "value * 2").put("b", "a + 1")
    assert s.view("b").df.where("abs(b - 2) > 1e9").count() == 0 and s.view("b", "value").signals == ("b", "value")
    edited = s.put("a", "value * 3")
    first = edited.view("value", "b").df.first()
    assert first.b == pytest.approx(first.value * 3 + 1)
    for bad in (lambda: s.put("a", "b"), lambda: s.put("value", "1"), lambda: s.put("c", "nothing"), lambda: s.drop("a"), lambda: s.put("c", "half(a)")):
        with pytest.raises(ExpressionError):
            bad()
    assert list(s.drop("b").drop("a").derived) == [] and s.problems() == {"a": None, "b": None}


def test_functions(space):
    registry = Registry().add(UserFunction("half", ("x",), "x / 2")).add(UserFunction("quarter", ("x",), "half(half(x))"))
    s = space.with_registry(registry).put("q", "quarter(value)").put("r", "value")
    assert s.users_of("half") == ["q"]
    with pytest.raises(ExpressionError):
        s.with_registry(Registry())


def test_jobs(spark, space):
    jobs = Jobs(spark, 2)
    one, two = (jobs.submit(lambda: space.series.row_count(), "count") for _ in range(2))
    assert one.result() == two.result() == 1000 and jobs.latest(two) and not jobs.latest(one)
    bad = jobs.submit(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad.result()
    jobs.cancel(one)
    jobs.close()


def test_queue():
    q = Queue(2, 0, lambda volume: 100)
    a, b, c, d = (q.add(Request(t, "v", n)) for t, n in (("x", 40), ("x", 10), ("y", 80), ("z", 10)))
    assert q.start_next() is a and q.start_next() is None
    q.finish(a)
    assert q.start_next() is b and q.start_next() is c and q.start_next() is None
    q.cancel(b)
    q.finish(c)
    assert q.start_next() is d and b.state == "cancelled"
    full = Queue(1, 0, lambda volume: 5)
    for k in range(3):
        full.add(Request(str(k), "v", 10))
    assert full.start_next() is None and [r.state for r in full.items] == ["no_room", "no_room", "stopped"]


def test_what_a_view_says_besides(tmp_path):
    """Colours, visibility, ranges and heights go through; hidden series are left out of what is drawn."""
    import json

    from tidemark.sources.stores import load_view, save_view

    body = {"source": {"parquet_path": "x.parquet"}, "plots": [{"plot_id": 7, "height_ratio": 2.5, "x_linked": False, "y_axis_range": [0, 1], "series": [{"variable": "a", "color": "#123456", "visible": False}, {"variable": "b", "color": "#ff0000", "visible": True}]}]}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(body))
    view = load_view(str(path))
    assert view.visible_plots() == [["b"]]
    again = json.loads(open(save_view(str(tmp_path), view)).read())
    assert again["plots"] == body["plots"]


def test_names_of_the_axis_are_taken_out():
    from tidemark.plans.derived import effective_available

    names, aliases = {"t", "clock", "v", "w"}, {"clock": "t", "w": "v"}
    assert effective_available(names, aliases, "clock") == effective_available(names, aliases, "t") == {"v", "w"}
    assert effective_available(names, aliases, None) == effective_available(names, aliases, "other") == names


def test_queue_keeps_to_its_memory():
    from tidemark.plans.workspace import Queue, Request

    queue = Queue(parallel=3, free=lambda _: 1 << 40, memory=100)
    for k, need in enumerate((60, 50, 10)):
        queue.add(Request(f"f{k}", "v", 1, memory=need))
    first = queue.start_next()
    assert first.target == "f0" and queue.start_next() is None
    queue.finish(first)
    assert [queue.start_next().target, queue.start_next().target] == ["f1", "f2"]


def test_size_of_an_export(spark):
    from tests.conftest import DATA
    from tidemark.sources.export import build_plan, estimate

    plan = build_plan(spark, f"{DATA}/events.parquet", ["user_id", "event_type", "x"], {"x": "value + 1"}, "ts", float32=True)
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert estimate(spark, plan) == {"rows": n, "bytes": n * (8 + 8 + 32 + 4), "part_rows": 1_000_000}
