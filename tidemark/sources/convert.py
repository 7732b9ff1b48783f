"""Other formats to Parquet: MATLAB files and measurement files, by optional libraries, and a command line."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from collections.abc import Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

TIME_NAMES = ("time", "t", "timestamp", "timestamps")


class ConvertError(ValueError):
    """A file that can't be converted."""


def axis_warnings(t: np.ndarray) -> list[str]:
    """What is wrong with a time axis."""
    out = []
    if not np.isfinite(t).all():
        out.append("the time axis has values that aren't finite")
    if (np.diff(t[np.isfinite(t)]) <= 0).any():
        out.append("the time axis doesn't ascend")
    return out


def columns_of(arrays: Mapping[str, object], time_name: str | None = None) -> tuple[dict[str, np.ndarray], list[str]]:
    """(time first, then one-dimensional numeric variables of its length; what was left out)."""
    flat, notes = {}, []
    for name, value in arrays.items():
        if name.startswith("__"):
            continue
        a = np.asarray(value)
        a = a.squeeze() if a.ndim == 2 and 1 in a.shape else a
        if a.dtype.kind not in "fiub" or a.ndim != 1:
            notes.append(f"{name} left out: not a series of numbers")
            continue
        flat[name] = a
    axis = time_name or next((n for want in TIME_NAMES for n in flat if n.lower() == want), None)
    if axis not in flat:
        raise ConvertError("there is no time variable")
    out = {axis: flat[axis].astype(float)}
    for name, a in flat.items():
        if name == axis:
            continue
        if len(a) != len(out[axis]):
            notes.append(f"{name} left out: {len(a)} values for {len(out[axis])} times")
        else:
            out[name] = a
    return out, notes


def write_columns(columns: Mapping[str, np.ndarray], path: str) -> list[str]:
    """One Parquet file, written beside and renamed; returns warnings about the axis."""
    first = next(iter(columns.values()), None)
    if first is None or len(columns) < 2:
        raise ConvertError("there are no signals")
    if not len(first):
        raise ConvertError("there are no rows")
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    os.close(fd)
    try:
        pq.write_table(pa.table({n: pa.array(a) for n, a in columns.items()}), part)
        os.replace(part, path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise
    return axis_warnings(np.asarray(first, float))


def refuse_itself(source: str, target: str) -> None:
    """A target that is the source, by whatever path, would destroy it."""
    if os.path.realpath(source) == os.path.realpath(target) or (os.path.exists(target) and os.path.exists(source) and os.path.samefile(source, target)):
        raise ConvertError("the target is the source itself")


def convert_mat(source: str, target: str, time_name: str | None = None) -> list[str]:
    """A MATLAB file; version 7.3 through HDF5."""
    refuse_itself(source, target)
    try:
        from scipy.io import loadmat
    except ImportError:
        raise ConvertError("reading MATLAB files needs scipy") from None
    try:
        arrays = loadmat(source)
    except NotImplementedError:
        try:
            import h5py
        except ImportError:
            raise ConvertError("reading MATLAB 7.3 files needs h5py") from None
        with h5py.File(source) as f:
            arrays = {n: d[()] for n, d in f.items() if isinstance(d, h5py.Dataset)}
    columns, notes = columns_of(arrays, time_name)
    return notes + write_columns(columns, target)


def align(channels: Mapping[str, tuple[np.ndarray, np.ndarray]], raster: float | None = None) -> dict[str, np.ndarray]:
    """Channels of (times, values) on one axis: all times of all, or a raster that holds the last value; gaps are NaN."""
    for name, (t, _) in channels.items():
        if (np.diff(t) < 0).any():
            raise ConvertError(f"the times of {name} don't ascend")
    every = np.unique(np.concatenate([t for t, _ in channels.values()])) if channels else np.zeros(0)
    if raster and len(every):
        every = every[0] + np.arange(int((every[-1] - every[0]) / raster + 1e-9) + 1) * raster
    out = {"time": every}
    for name, (t, v) in channels.items():
        column = np.full(len(every), np.nan)
        at = np.searchsorted(t, every, "right") - 1
        hit = (at >= 0) & ((t[np.maximum(at, 0)] == every) | bool(raster)) if len(t) else np.zeros(len(every), bool)
        column[hit] = np.asarray(v, float)[at[hit]]
        out[name] = column
    return out


def convert_mdf(source: str, target: str, raster: float | None = None) -> list[str]:
    """A measurement file: numeric channels on one axis of epoch seconds."""
    refuse_itself(source, target)
    try:
        from asammdf import MDF
    except ImportError:
        raise ConvertError("reading measurement files needs asammdf") from None
    with MDF(source) as mdf:
        start = mdf.header.start_time.timestamp()
        channels = {s.name: (s.timestamps + start, s.samples) for s in mdf.iter_channels() if s.samples.dtype.kind in "fiub" and s.samples.ndim == 1}
    return write_columns(align(channels, raster), target)


CONVERTERS = {".mat": convert_mat, ".mdf": convert_mdf, ".mf4": convert_mdf, ".dat": convert_mdf}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Convert a measurement file to Parquet.")
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--raster", type=float, help="seconds between rows (measurement files)")
    parser.add_argument("--time", help="name of the time variable (MATLAB files)")
    args = parser.parse_args(argv)
    kind = Path(args.source).suffix.lower()
    target = args.target or str(Path(args.source).with_suffix(".parquet"))
    try:
        if kind not in CONVERTERS:
            raise ConvertError(f"unknown kind of file: {kind}")
        refuse_itself(args.source, target)
        more = {"time_name": args.time} if kind == ".mat" else {"raster": args.raster}
        for note in CONVERTERS[kind](args.source, target, **more):
            print(f"warning: {note}", file=sys.stderr)
    except (ConvertError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
