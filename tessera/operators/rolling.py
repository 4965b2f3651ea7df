"""Rolling means, sums, deviations and extremes of many columns and windows in one pass over the rows of each symbol.

A window frame of Spark that slides is summed up anew for each of its rows, w steps a row. Here stretches of 1, 2, 4,
... rows are put together, so a window takes some log w steps, and all columns and windows share one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"avg": "moments", "std": "moments", "sum": "moments", "min": "range", "max": "range"}


def name(x: str, w: int, least: int, part: str) -> str:
    return f"__{part}_{x}_{w}_{least}"


def value(part: str, s: tuple, least: int) -> pa.Array:
    """A part of a stretch, null under ``least`` values (under two for the deviation)."""
    n = np.maximum(s[0], 2)
    v = {"sum": lambda: s[1], "avg": lambda: s[1] / np.maximum(s[0], 1), "std": lambda: np.sqrt(s[2] / (n - 1)), "min": lambda: s[1], "max": lambda: s[2]}[part]()
    return pa.array(v, mask=s[0] < max(least, 2 if part == "std" else 1))


def merged(kind: str, a: tuple, b: tuple) -> tuple:
    """Two neighbouring stretches as one; n = 0 marks an empty one."""
    n = a[0] + b[0]
    if kind == "range":
        return n, np.fmin(a[1], b[1]), np.fmax(a[2], b[2])
    both = (a[0] > 0) & (b[0] > 0)
    one, two = np.where(both, a[0], 1), np.where(both, b[0], 1)
    gap = np.where(both, a[1] / one - b[1] / two, 0)
    return n, a[1] + b[1], a[2] + b[2] + gap * gap * one * two / (one + two)


def stretches(x: np.ndarray, place: np.ndarray, windows: list[int], kind: str) -> dict[int, tuple]:
    """The parts of ``kind`` over the last w values of ``x`` for each of ``windows``; NaN is missing, ``place`` counts the rows of a symbol from 0."""
    there = ~np.isnan(x)
    empty = (0.0, 0.0, 0.0) if kind == "moments" else (0.0, np.nan, np.nan)

    def back(s: tuple, k: int) -> tuple:
        inside = place[k:] >= k
        return tuple(np.concatenate([np.full(min(k, len(v)), e), np.where(inside, v[: max(0, len(v) - k)], e)]) for v, e in zip(s, empty))

    n = there.astype(float)
    made = {1: (n, np.where(there, x, 0), np.zeros(len(x))) if kind == "moments" else (n, x, x)}
    long = 1
    while 2 * long <= max(windows):
        made[2 * long] = merged(kind, made[long], back(made[long], long))
        long *= 2
    out = {}
    for w in windows:
        have = 1 << (w.bit_length() - 1)
        s = made[have]
        while have < w:
            part = 1 << ((w - have).bit_length() - 1)
            s, have = merged(kind, s, back(made[part], have)), have + part
        out[w] = s
    return out


def with_rolling(panel: DataFrame, wanted: set[tuple[str, int, int, str]]) -> DataFrame:
    """The panel with a column for each (column, window, least number of values, part) of ``wanted``: the rows of a symbol, in order of t, lie in one task."""
    asked = sorted(wanted)
    groups: dict[tuple[str, str], set[int]] = {}
    for x, w, _, part in asked:
        groups.setdefault((x, KINDS[part]), set()).add(w)
    names = [name(*k) for k in asked]
    columns = panel.columns
    own = columns.index("symbol")

    def valued(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        symbol = table.column(own).to_numpy()
        starts = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        rows = np.arange(len(symbol))
        place = rows - np.maximum.accumulate(np.where(starts, rows, 0))
        held = {}
        for (x, kind), ws in groups.items():
            values = table.column(columns.index(x)).cast(pa.float64()).to_numpy().astype(float)
            held |= {(x, w, kind): s for w, s in stretches(values, place, sorted(ws), kind).items()}
        out = [value(part, held[x, w, KINDS[part]], least) for x, w, least, part in asked]
        return pa.RecordBatch.from_arrays([c.chunk(0) for c in table.columns] + out, columns + names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            symbol = batch.column(own).to_numpy(zero_copy_only=False)
            new = np.nonzero(symbol[1:] != symbol[:-1])[0] + 1
            cut = int(new[-1]) if len(new) else 0 if held and symbol[0] != last else None
            if cut is not None:
                if whole := held + ([batch.slice(0, cut)] if cut else []):
                    yield valued(whole)
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = symbol[-1]
        if held:
            yield valued(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    return panel.repartition("symbol").sortWithinPartitions("symbol", "t").mapInArrow(run, schema + "".join(f", `{n}` double" for n in names))
