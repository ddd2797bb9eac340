"""How far a page is turned, by counting (a Hough accumulator as aggregations over runs).

Rows are runs ``y a z`` of dark pixels (``operators.regions``). Slopes are whole per mille, offsets whole
pixels at the page's middle, all counts integers, so results don't depend on order or
rounding. Every run votes with its length for each slope and the offset that it has there. A coarse
round over all slopes finds each page's best, a fine one around it finds lines: the
greatest counts within ``NEAR`` offsets. A line's slope is that of the pixels near it. A page's votes are
counted in arrays by the task that has its runs; where they are rows of a table, a page's are gathered first.

A page with ``LEAST`` lines or more is turned by their median slope; another by the tilt of
the least rectangle around all its ink, found by extremes over slopes likewise.

Defined results: pages without runs have no lines, no angle and the method ``none``; null sizes count as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.regions import RUNS, columns_of

#: Slopes looked at (about 5 degrees) and between them in the coarse round, in per mille; offsets that one coarse count joins.
MOST, STEP, COARSE = 88, 8, 8
#: Slopes of rectangles (45 degrees) and between them in the coarse round.
TILT, TILT_STEP = 1000, 20
#: Shortest run that votes, offsets within which one line counts, lines that decide.
SHORTEST, NEAR, LEAST = 8, 4, 5
#: Numbers in an array that a step makes.
MOST_AT_ONCE = 1 << 20


def _cells(y, x2, n, slopes, wide: int):
    """``k rho n``: votes for the slopes and offsets, ``wide`` of them in one, where there are any."""
    ks, rhos, ns = [], [], []
    step = max(1, MOST_AT_ONCE // len(y))
    for at in range(0, len(slopes), step):
        part = slopes[at : at + step]
        rho = (2000 * y - part[:, None] * x2) // (2000 * wide)
        low = rho.min()
        size = int(rho.max() - low) + 1
        cell = (rho - low + size * np.arange(len(part))[:, None]).ravel()
        weight = np.tile(n, len(part))
        if size * len(part) <= max(1 << 16, 4 * len(cell)):
            sums = np.bincount(cell, weight, size * len(part))
            found = np.flatnonzero(sums)
            sums = sums[found]
        else:  # far apart
            found, place = np.unique(cell, return_inverse=True)
            sums = np.bincount(place, weight)
        ks.append(part[found // size])
        rhos.append(found % size + low)
        ns.append(sums.astype(np.int64))
    return np.concatenate(ks), np.concatenate(rhos), np.concatenate(ns)


def _peaks(k, rho, n, least: int):
    """``k rho`` of the cells that nothing within ``NEAR`` offsets outranks, from ``least`` on."""
    # one number orders counts, then flat slopes, then upper offsets
    rank = ((n * 256 + (128 - np.abs(k))) * 2 + (k >= 0)) * (1 << 21) + ((1 << 20) - rho)
    low = rho.min()
    if rho.max() - low < max(1 << 16, 4 * len(rho)):
        place, at = rho - low, np.arange(low, rho.max() + 1)
    else:  # far apart
        at, place = np.unique(rho, return_inverse=True)
    best = np.full(len(at), np.iinfo(np.int64).min)
    np.maximum.at(best, place, rank)
    most = best.copy()
    for step in range(1, min(NEAR, len(at) - 1) + 1):
        near = at[step:] - at[:-step] <= NEAR
        np.maximum(most[step:], np.where(near, best[:-step], most[step:]), out=most[step:])
        np.maximum(most[:-step], np.where(near, best[step:], most[:-step]), out=most[:-step])
    found = np.flatnonzero((n >= least) & (rank == most[place]))
    return k[found], rho[found]


def page_lines(width: int, y, a, z) -> list[tuple[float, int, int]]:
    """Slope, offset and pixels of each line of a page's runs."""
    long_ = z - a >= SHORTEST
    if not long_.any():
        return []
    order = np.argsort(y[long_], kind="stable")
    y, a, z = (c[long_][order] for c in (y, a, z))
    x, n = a + z - width, z - a
    k, _, votes = _cells(y, x, n, np.arange(-MOST, MOST + 1, STEP), COARSE)
    # long lines stand out in the squares of counts
    energy = {}
    for slope in np.unique(k).tolist():
        energy[slope] = int((votes[k == slope] ** 2).sum())
    best = max(energy, key=lambda k: (energy[k], -abs(k), k))
    cells = _cells(y, x, n, np.arange(best - STEP, best + STEP + 1), 1)
    k, rho = _peaks(*cells, max(100, width // 12))
    found = []
    # a line meets the rows that it covers
    ends = rho + k * x.min() // 2000, rho + k * x.max() // 2000
    first = np.searchsorted(y, np.minimum(*ends) - NEAR - 2)
    many = np.searchsorted(y, np.maximum(*ends) + NEAR + 3) - first
    step = max(1, MOST_AT_ONCE // max(1, int(many.max(initial=0))))
    for at in range(0, len(k), step):
        size = many[at : at + step]
        line = np.repeat(np.arange(at, at + len(size)), size)
        run = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + first[line]
        ny, nx = y[run] - rho[line], x[run]
        near = np.flatnonzero(np.abs(2000 * ny - k[line] * nx) <= 2000 * NEAR)
        line, ny, nx, nn = line[near], ny[near], nx[near], n[run[near]]
        if not len(line):
            continue
        # the squares of a run's own pixels stand in for those of its middle; x counts half pixels
        start, nnx = np.flatnonzero(np.append(True, line[1:] != line[:-1])), nn * nx
        sums = (np.add.reduceat(c, start).tolist() for c in (nn, nnx, nn * ny, nnx * ny, nnx * nx + (nn * nn * nn - nn) // 3))
        for offset, total, sx, sy, sxy, sxx in zip(rho[line[start]].tolist(), *sums, strict=True):
            if total * sxx > sx * sx:
                slope = 2000.0 * float(total * sxy - sx * sy) / float(total * sxx - sx * sx)
                if abs(slope) <= MOST:
                    found.append((slope, offset, total))
    return found


def page_tilt(y, a, z) -> int | None:
    """The tilt of the least rectangle around a page's runs, between -45 and 45 degrees."""
    if not len(y):
        return None
    order = np.argsort(y, kind="stable")
    y, a, z = y[order], a[order], z[order]
    at = np.flatnonzero(np.append(True, np.diff(y) != 0))
    y = np.concatenate([y[at], y[at]])
    x = np.concatenate([np.minimum.reduceat(a, at), np.maximum.reduceat(z, at) - 1])

    def least(slopes):
        found, step = [], max(1, MOST_AT_ONCE // len(y))
        for i in range(0, len(slopes), step):
            k = slopes[i : i + step, None]
            u, v = 1000 * x + k * y, 1000 * y - k * x
            area = (u.max(1) - u.min(1)).astype(np.float64) * (v.max(1) - v.min(1)) / (1_000_000 + k[:, 0] * k[:, 0])
            found += zip(area.tolist(), np.abs(k[:, 0]).tolist(), k[:, 0].tolist(), strict=True)
        return min(found)[2]

    rough = least(np.arange(-TILT, TILT + 1, TILT_STEP))
    return least(np.arange(max(-TILT, rough - TILT_STEP), min(TILT, rough + TILT_STEP) + 1))


def _found(packed: DataFrame, keys: list[str], made, fields: str, kinds: list[pa.DataType]) -> DataFrame:
    """``keys`` and the rows that ``made`` has of each page's width and runs (:func:`regions.packed_runs`)."""
    n, names = len(keys), [*keys, *(f.split()[0] for f in fields.split(", "))]

    def task(batches):
        for batch in batches:
            ends, runs = columns_of(batch.column(n + 1))
            at, rows = [], []
            for i, width in enumerate(batch.column(n).to_pylist()):
                got = made(width or 0, *(c[ends[i] : ends[i + 1]] for c in runs))
                at += [i] * len(got)
                rows += got
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(at, pa.int32())) for j in range(n)), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=names)

    own = "".join(f"`{k}` {packed.schema[k].dataType.simpleString()}, " for k in keys)
    return packed.select(*keys, F.col("width").cast("int").alias("width"), F.col("runs").cast(RUNS).alias("runs")).mapInArrow(task, own + fields)


def gathered(runs: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys width runs`` of every page from a run table."""
    each = runs.groupBy(*keys).agg(F.collect_list(F.struct("y", "a", "z")).alias("runs"))
    return pages.select(*keys, "width").join(each, keys, "left")


def lines(runs: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys slope offset n``: the lines of each page (``keys width``), n the pixels near one, slopes in per mille."""
    return _found(gathered(runs, pages, keys), keys, page_lines, "slope double, offset long, n long", [pa.float64(), pa.int64(), pa.int64()])


def degrees(slope: Column) -> Column:
    return F.degrees(F.atan(slope / 1000.0))


def turned_pages(packed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys n slope angle method`` of every page (``keys width runs``): ``lines``, ``box`` or ``none``; angle in degrees, clockwise as rows go down."""

    def page(width, y, a, z):
        slopes = [slope for slope, _, _ in page_lines(width, y, a, z)]
        if len(slopes) >= LEAST:
            return [(len(slopes), float(np.median(slopes)), "lines")]
        tilt = page_tilt(y, a, z)
        return [(len(slopes), None if tilt is None else float(tilt), "none" if tilt is None else "box")]

    found = _found(packed, keys, page, "n long, slope double, method string", [pa.int64(), pa.float64(), pa.string()])
    return found.select(*keys, "n", "slope", degrees(F.col("slope")).alias("angle"), "method")


def turned(runs: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`turned_pages` of the runs of every page (``keys width``)."""
    return turned_pages(gathered(runs, pages, keys), keys)
