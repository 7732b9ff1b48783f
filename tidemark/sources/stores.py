"""Small JSON stores: views, user functions, aliases, settings, and the log of operations."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.expression import ALL_BUILTINS, ExpressionError, Registry, UserFunction, validate_function
from tidemark.sources.tables import replace_file

VIEW_VERSION = 3


class ViewError(ValueError):
    """A saved view with a wrong shape; ``path`` says where."""

    def __init__(self, path: str, what: str):
        super().__init__(f"{path}: {what}")
        self.path = path


@dataclass
class View:
    """What is shown of a log: derived variables, plots (their series), ranges.

    looks: what else a saved plot says, for each plot (its ranges, height, link) and, under ``series``, for each of its series
    (colour, visible). It goes through loading and saving as it is.
    """

    name: str
    parquet_path: str
    time_column: str | None = None
    derived: dict[str, str] = field(default_factory=dict)
    plots: list[list[str]] = field(default_factory=list)
    x_range: tuple[float, float] | None = None
    downsample: bool = True
    looks: list[dict] = field(default_factory=list)

    def look(self, plot: int, series: int | None = None) -> dict:
        """What is known of a plot, or of one of its series; nothing if there is nothing."""
        found = self.looks[plot] if plot < len(self.looks) else {}
        if series is None:
            return {k: v for k, v in found.items() if k != "series"}
        own = found.get("series", [])
        return own[series] if series < len(own) else {}

    def visible_plots(self) -> list[list[str]]:
        """The plots without the series that are switched off."""
        return [[v for j, v in enumerate(p) if self.look(k, j).get("visible", True)] for k, p in enumerate(self.plots)]


def _want(value: object, kind: type | tuple, path: str) -> object:
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise ViewError(path, f"{type(value).__name__} is not expected")
    return value


def save_view(folder: str, view: View) -> str:
    """Write <folder>/<name>.json; the log's path is kept both absolute and relative to the folder."""
    body = {
        "schema_version": VIEW_VERSION,
        "view_name": view.name,
        "source": {"parquet_path": view.parquet_path, "relative_path": os.path.relpath(view.parquet_path, folder)},
        "time_column": view.time_column,
        "derived_variables": [{"name": n, "expression": e} for n, e in view.derived.items()],
        "plots": [{"plot_id": k} | view.look(k) | {"series": [view.look(k, j) | {"variable": v} for j, v in enumerate(p)]} for k, p in enumerate(view.plots)],
        "x_axis_range": list(view.x_range) if view.x_range else None,
        "downsample": {"enabled": view.downsample},
    }
    path = Path(folder) / f"{view.name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    replace_file(path, json.dumps(body, ensure_ascii=False, indent=1))
    return str(path)


def load_view(path: str) -> View:
    """Read a view; unknown keys are passed over, wrong shapes raise ViewError."""
    try:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as error:
        raise ViewError("$", f"not JSON: {error}") from None
    _want(body, dict, "$")
    source = _want(body.get("source"), dict, "source")
    derived = {}
    for k, d in enumerate(_want(body.get("derived_variables", []), list, "derived_variables")):
        _want(d, dict, f"derived_variables[{k}]")
        derived[_want(d.get("name"), str, f"derived_variables[{k}].name")] = _want(d.get("expression"), str, f"derived_variables[{k}].expression")
    plots = []
    for k, p in enumerate(_want(body.get("plots", []), list, "plots")):
        _want(p, dict, f"plots[{k}]")
        plots.append([_want(_want(s, dict, f"plots[{k}].series[{j}]").get("variable"), str, f"plots[{k}].series[{j}].variable") for j, s in enumerate(_want(p.get("series", []), list, f"plots[{k}].series"))])
    looks = [{k: v for k, v in p.items() if k != "series"} | {"series": [{k: v for k, v in s.items() if k != "variable"} for s in p.get("series", [])]} for p in body.get("plots", [])]
    span = body.get("x_axis_range")
    if span is not None:
        if len(_want(span, list, "x_axis_range")) != 2:
            raise ViewError("x_axis_range", "two numbers are expected")
        span = tuple(float(_want(v, (int, float), f"x_axis_range[{k}]")) for k, v in enumerate(span))
    where = _want(source.get("parquet_path"), str, "source.parquet_path")
    relative = source.get("relative_path")
    if "://" not in where and not os.path.exists(where) and isinstance(relative, str):
        near = os.path.normpath(os.path.join(os.path.dirname(path), relative))
        where = near if os.path.exists(near) else where
    axis = body.get("time_column")
    return View(str(body.get("view_name", Path(path).stem)), where, axis if axis is None else _want(axis, str, "time_column"), derived, plots, span, bool((body.get("downsample") or {}).get("enabled", True)), looks)


def list_views(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def delete_view(folder: str, name: str) -> None:
    (Path(folder) / f"{name}.json").unlink(missing_ok=True)


def _read_entries(path: str) -> list:
    """A JSON list; a file that isn't one is set aside under another name."""
    try:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
        if isinstance(body, list):
            return body
    except FileNotFoundError:
        return []
    except ValueError:
        pass
    os.replace(path, f"{path}.broken-{int(time.time())}")
    return []


def load_functions(path: str) -> tuple[Registry, list]:
    """(registry of the valid functions, the entries that aren't, as they were)."""
    registry, bad = Registry(), []
    for entry in _read_entries(path):
        try:
            registry = registry.add(UserFunction(entry["name"], tuple(entry["params"]), entry["body"], dict(entry.get("constants", {}))))
        except (ExpressionError, KeyError, TypeError, AttributeError):
            bad.append(entry)
    return registry, bad


def save_functions(path: str, registry: Registry, bad: list | None = None) -> None:
    for f in registry.functions.values():
        validate_function(f, registry)
    entries = [{"name": f.name, "params": list(f.params), "body": f.body, "constants": dict(f.constants)} for f in registry.functions.values()]
    replace_file(Path(path), json.dumps([*entries, *(bad or [])], ensure_ascii=False))


@dataclass
class Alias:
    name: str
    candidates: list[str]
    enabled: bool = True


def validate_alias(entry: Alias, others: list[Alias]) -> str | None:
    """Why an alias can't be used: blank, reserved, duplicate, no_candidates; None if it can."""
    if not entry.name.strip():
        return "blank"
    if entry.name in ALL_BUILTINS or entry.name in ("_row", "_t"):
        return "reserved"
    if any(o.name == entry.name for o in others):
        return "duplicate"
    return None if [c for c in entry.candidates if c.strip()] else "no_candidates"


def load_aliases(path: str) -> tuple[list[Alias], list]:
    good: list[Alias] = []
    bad = []
    for entry in _read_entries(path):
        try:
            one = Alias(str(entry["name"]), [str(c) for c in entry["candidates"]], bool(entry.get("enabled", True)))
        except (KeyError, TypeError):
            bad.append(entry)
            continue
        if validate_alias(one, good):
            bad.append(entry)
        else:
            good.append(one)
    return good, bad


def save_aliases(path: str, aliases: list[Alias], bad: list | None = None) -> None:
    replace_file(Path(path), json.dumps([*map(asdict, aliases), *(bad or [])], ensure_ascii=False))


def active_aliases(aliases: list[Alias]) -> dict[str, list[str]]:
    return {a.name: a.candidates for a in aliases if a.enabled}


DEFAULTS = {"eager_load_limit_mb": 512, "downsample_ratio": 2, "export_parallel": 2}


def load_settings(path: str) -> dict:
    """Known settings, each of the default's type and positive; else the default."""
    try:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
    except (FileNotFoundError, ValueError):
        body = {}
    body = body if isinstance(body, dict) else {}
    return {k: body[k] if isinstance(body.get(k), type(d)) and not isinstance(body[k], bool) and body[k] > 0 else d for k, d in DEFAULTS.items()}


def save_settings(path: str, settings: dict) -> None:
    replace_file(Path(path), json.dumps({k: settings.get(k, d) for k, d in DEFAULTS.items()}))


def log_operation(path: str, kind: str, **info: object) -> None:
    """Append one line of JSON."""
    with open(path, "a", encoding="utf-8") as to:
        to.write(json.dumps({"at": time.time(), "kind": kind} | info, ensure_ascii=False) + "\n")


def timeline(spark: SparkSession, path: str, kinds: list[str] | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """The log's records, by time; lines that aren't JSON are left out."""
    rows = spark.read.schema("at double, kind string, name string, seconds double, ok boolean, error string, _corrupt_record string").json(path).where("at IS NOT NULL")
    for met in (F.col("kind").isin(kinds) if kinds else None, F.col("at") >= start if start is not None else None, F.col("at") <= end if end is not None else None):
        rows = rows.where(met) if met is not None else rows
    return rows.drop("_corrupt_record").orderBy("at")
