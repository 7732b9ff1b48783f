"""Lookup tables as CSV files, and a folder of them with settings."""

from __future__ import annotations

import csv
import io
import json
import math
import os
import shutil
from pathlib import Path

from tidemark.functions.lookup import Table, TableError, check_name


def _number(cell: str) -> float | None:
    try:
        return float(cell.strip())
    except ValueError:
        return None


def _value(cell: str, row: int, column: int) -> float:
    """A cell's number; blank is NaN."""
    if not cell.strip():
        return math.nan
    v = _number(cell)
    if v is None or math.isinf(v):
        raise TableError(f"row {row}, column {column}: {cell!r} is not a finite number")
    return v


def _axis(cell: str, row: int, column: int) -> float:
    v = _value(cell, row, column)
    if math.isnan(v):
        raise TableError(f"row {row}, column {column}: an axis has no empty cell")
    return v


def read_text(path: str) -> str:
    """UTF-8, with or without a mark, else code page 932."""
    data = Path(path).read_bytes()
    for encoding in ("utf-8-sig", "cp932"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise TableError("the file is neither UTF-8 nor CP932")


def parse_table(text: str, kind: str = "auto", interpolation: str = "linear", outside: tuple[str, str] = ("clamp", "clamp")) -> Table:
    """A table from CSV text.

    auto: two columns are a curve; three or more whose corner isn't a number are a map with x in the first row and y in the
    first column. A curve's first row is a header if neither of its cells is a number.
    """
    rows = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    if not rows:
        raise TableError("the file is empty")
    width = len(rows[0])
    if kind == "auto":
        kind = "curve" if width == 2 else "map" if width >= 3 and _number(rows[0][0]) is None else ""
        if not kind:
            raise TableError("neither a curve nor a map")
    for k, r in enumerate(rows):
        if len(r) != width or (kind == "curve" and width != 2):
            raise TableError(f"row {k + 1}: {len(r)} cells")
    if kind == "curve":
        head = int(_number(rows[0][0]) is None and _number(rows[0][1]) is None)
        body = rows[head:]
        x = tuple(_axis(r[0], k + head + 1, 1) for k, r in enumerate(body))
        return Table("curve", x, tuple(_value(r[1], k + head + 1, 2) for k, r in enumerate(body)), None, interpolation, outside)
    x = tuple(_axis(c, 1, k + 2) for k, c in enumerate(rows[0][1:]))
    y = tuple(_axis(r[0], k + 2, 1) for k, r in enumerate(rows[1:]))
    z = tuple(tuple(_value(c, k + 2, j + 2) for j, c in enumerate(r[1:])) for k, r in enumerate(rows[1:]))
    return Table("map", x, z, y, interpolation, outside)


def format_table(table: Table, axis_names: tuple[str, str] = ("x", "y")) -> str:
    """CSV text that parse_table reads back exactly."""
    cell = lambda v: "" if math.isnan(v) else repr(float(v))
    out = io.StringIO()
    to = csv.writer(out, lineterminator="\n")
    if table.kind == "curve":
        to.writerow(axis_names)
        to.writerows((repr(float(x)), cell(v)) for x, v in zip(table.x, table.values, strict=True))
    else:
        to.writerow([f"{axis_names[1]}\\{axis_names[0]}", *(repr(float(x)) for x in table.x)])
        to.writerows([repr(float(y)), *map(cell, row)] for y, row in zip(table.y, table.values, strict=True))
    return out.getvalue()


def replace_file(path: Path, data: str | bytes) -> None:
    """Write beside, then rename: readers see the old file or the new one."""
    part = path.with_name(path.name + ".part")
    part.write_bytes(data.encode() if isinstance(data, str) else data)
    os.replace(part, path)


class TableStore:
    """A folder with <name>.csv and <name>.json (interpolation, outside, axis names, origin)."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.csv") if p.with_suffix(".json").exists())

    def _path(self, name: str, kind: str) -> Path:
        return self.folder / f"{name}.{kind}"

    def add(self, path: str, name: str, kind: str = "auto", interpolation: str = "linear", outside: tuple[str, str] = ("clamp", "clamp")) -> Table:
        """Copy a CSV file in; nothing is left behind if it isn't a table."""
        check_name(name, self.names())
        text = read_text(path)
        table = parse_table(text, kind, interpolation, outside)
        self._save(name, text, {"kind": table.kind, "interpolation": interpolation, "outside": list(outside), "axis_names": ["x", "y"]})
        return table

    def put(self, name: str, table: Table, axis_names: tuple[str, str] = ("x", "y"), origin: dict | None = None) -> None:
        """Write a table made here, over one of the same name."""
        check_name(name)
        self._save(name, format_table(table, axis_names), {"kind": table.kind, "interpolation": table.interpolation, "outside": list(table.outside), "axis_names": list(axis_names), "origin": origin})

    def _save(self, name: str, text: str, settings: dict) -> None:
        replace_file(self._path(name, "csv"), text)
        replace_file(self._path(name, "json"), json.dumps(settings))

    def settings(self, name: str) -> dict:
        return json.loads(self._path(name, "json").read_text())

    def change(self, name: str, **settings) -> Table:
        """New settings, if the table allows them."""
        merged = self.settings(name) | settings
        table = parse_table(read_text(str(self._path(name, "csv"))), merged["kind"], merged["interpolation"], tuple(merged["outside"]))
        replace_file(self._path(name, "json"), json.dumps(merged))
        return table

    def load(self, name: str) -> Table:
        return self.change(name)

    def load_all(self) -> tuple[dict[str, Table], dict[str, str]]:
        """(tables by name, what was wrong with the others)."""
        good, bad = {}, {}
        for name in self.names():
            try:
                good[name] = self.load(name)
            except (TableError, ValueError, KeyError, OSError) as error:
                bad[name] = str(error)
        return good, bad

    def replace(self, name: str, path: str) -> Table:
        """New values from a CSV file, the settings kept."""
        settings, text = self.settings(name), read_text(path)
        table = parse_table(text, settings["kind"], settings["interpolation"], tuple(settings["outside"]))
        replace_file(self._path(name, "csv"), text)
        return table

    def rename(self, old: str, new: str) -> None:
        check_name(new, self.names())
        shutil.copy(self._path(old, "csv"), self._path(new, "csv"))
        os.replace(self._path(old, "json"), self._path(new, "json"))
        self._path(old, "csv").unlink()

    def delete(self, name: str) -> None:
        for kind in ("json", "csv"):
            self._path(name, kind).unlink(missing_ok=True)
