"""Connected regions of page images as tables of runs.

One pass over the pixels makes a row of each run: consecutive pixels of a row that
belong to the region's kind. Runs that touch in neighbouring rows are found by a join over
tiles of ``TILE`` columns, regions are the components of that graph, and areas and boxes
are sums and extremes over their runs. After the run table no page is one task's alone.

Where pages are many and each fits a task, as it does in its row of pixels, :func:`page_regions` finds
the same regions without the table: runs of many pages at a time, in arrays.

Defined results: pages without pixels, null pages and null limits have no runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.graph import components
from scorelake.sources.tables import materialize

#: Columns of a tile, and runs in one batch.
TILE, BATCH = 64, 100_000
#: Runs that whole pages are taken together for.
TOGETHER = 1 << 18


def _page_runs(w: int, h: int, gray, lo: int, hi: int):
    """Rows, first columns and ends of a page's runs in reading order, a block of rows at a time."""
    step = max(1, (1 << 22) // max(1, w))
    for top in range(0, h, step):
        g = np.frombuffer(gray, np.uint8, min(step, h - top) * w, top * w).reshape(-1, w)
        edges = np.diff(np.pad(((g > lo) & (g <= hi)).astype(np.int8), ((0, 0), (1, 1))), axis=1)
        y, a = np.nonzero(edges == 1)
        yield y + top, a, np.nonzero(edges == -1)[1]


def _pages_of(batch: pa.RecordBatch, n_keys: int):
    """The place in its batch, width and height of each page with pixels, and its runs."""
    w, h, lo, hi = (batch.column(n_keys + k).to_pylist() for k in (0, 1, 3, 4))
    for i, gray in enumerate(batch.column(n_keys + 2)):
        if gray.is_valid and w[i] and h[i] and lo[i] is not None and hi[i] is not None:
            yield i, w[i], h[i], _page_runs(w[i], h[i], gray.as_buffer(), lo[i], hi[i])


def _given(pages: DataFrame, keys: list[str], low: Column, high: Column) -> tuple[DataFrame, str]:
    fields = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keys)
    return pages.select(*keys, "width", "height", "gray", low.cast("int").alias("_low"), high.cast("int").alias("_high")), fields


def run_table(pages: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """``keys y a z``: runs of pixels ``low < v <= high`` from column a to before z."""
    names, n = [*keys, "y", "a", "z"], len(keys)
    given, fields = _given(pages, keys, low, high)

    def task(batches):
        for batch in batches:
            for i, _, _, blocks in _pages_of(batch, n):
                for found in blocks:
                    for k in range(0, len(found[0]), BATCH):
                        part = [x[k : k + BATCH] for x in found]
                        at = pa.array(np.full(len(part[0]), i), pa.int32())
                        yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(n)), *(pa.array(x, pa.int32()) for x in part)], names=names)

    return given.mapInArrow(task, f"{fields}y int, a int, z int")


def packed_runs(pages: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """``keys width runs``: the runs of :func:`run_table` as an array of ``y a z`` for each page, empty for pages without."""
    n = len(keys)
    given, fields = _given(pages, keys, low, high)

    def task(batches):
        for batch in batches:
            found = [np.zeros((3, 0), np.int64)] * batch.num_rows
            for i, _, _, blocks in _pages_of(batch, n):
                found[i] = np.concatenate([np.array(x) for x in blocks], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(n)), batch.column(n), lists_of([x.shape[1] for x in found], *np.concatenate(found, axis=1))], names=[*keys, "width", "runs"])

    return given.mapInArrow(task, f"{fields}width int, runs {RUNS}")


#: Packed runs, and as Arrow lists.
RUNS = "array<struct<y:int,a:int,z:int>>"


def lists_of(sizes, y, a, z) -> pa.ListArray:
    """Packed runs from the number of each page and the columns of all."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (y, a, z)], ["y", "a", "z"]))


def columns_of(runs: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each page's packed runs begin and end, and the columns of all; a null page has none."""
    runs = runs.fill_null([]) if runs.null_count else runs
    flat = runs.flatten()
    return np.concatenate([[0], np.cumsum(np.asarray(runs.value_lengths()), dtype=np.int64)]), [np.asarray(flat.field(k)).astype(np.int64) for k in range(3)]


def run_id(y="y", a="a") -> Column:
    """A run's number on its page, in reading order."""
    return F.shiftleft(F.col(y).cast("long"), 32) + F.col(a)


def touching(runs: DataFrame, keys: list[str], corners: bool = True) -> DataFrame:
    """``keys u v``: the runs that touch in neighbouring rows (``corners``: also by a corner)."""
    wide = int(corners)
    over = lambda a, z: F.explode(F.sequence(F.floor(a / TILE), F.floor((z - 1) / TILE)))
    low = runs.select(*keys, F.col("y"), "a", "z", run_id().alias("u"), over(F.col("a"), F.col("z")).alias("_tile"))
    a, z = F.col("a") - wide, F.col("z") + wide
    up = runs.select(*keys, (F.col("y") + 1).alias("y"), a.alias("_a"), z.alias("_z"), run_id().alias("v"), over(a, z).alias("_tile"))
    pairs = low.join(up, [*keys, "y", "_tile"]).where((F.col("a") < F.col("_z")) & (F.col("_a") < F.col("z")))
    # told in the tile where both begin
    return pairs.where(F.col("_tile") == F.floor(F.greatest("a", "_a") / TILE)).select(*keys, "u", "v")


def labelled(runs: DataFrame, keys: list[str], corners: bool = True) -> DataFrame:
    """``runs`` with ``region``: the number of the first run of each one's region."""
    found = components(touching(runs, keys, corners), keys)
    named = runs.withColumn("node", run_id()).join(found, [*keys, "node"], "left")
    return named.select(*keys, "y", "a", "z", F.coalesce("root", "node").alias("region"))


def regions(runs: DataFrame, keys: list[str], corners: bool = True) -> DataFrame:
    """``keys region x y w h area`` of each region; numbers rise with the place of its first pixel."""
    each = labelled(runs, keys, corners).groupBy(*keys, "region")
    box = each.agg(
        F.min("a").alias("x"), F.min("y").alias("y"), F.max("z").alias("_z"), F.max("y").alias("_y"), F.sum(F.col("z") - F.col("a")).alias("area"),
    )
    return box.select(*keys, "region", "x", "y", (F.col("_z") - F.col("x")).alias("w"), (F.col("_y") - F.col("y") + 1).alias("h"), "area")


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number for each of n nodes that those of its component share, by edges u v.

    A round hangs each root either on its least neighbour or on its greatest, whichever moves more: at
    least half of the roots that have one, so rounds grow with the logarithm of a component.
    """
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        lower, upper = np.zeros(n, bool), np.zeros(n, bool)
        lower[low] = upper[high] = True
        if upper.sum() >= lower.sum():
            np.minimum.at(root, high, low)
        else:
            np.maximum.at(root, low, high)
        while not np.array_equal(up := root[root], root):
            root = up


def _boxes(y: np.ndarray, a: np.ndarray, z: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    """First run, x, y, w, h and area of the regions of runs in reading order."""
    n, step = len(y), int(z.max()) + 2
    first, end = y * step + a, y * step + z
    begin = np.searchsorted(end, first - step - wide, "right")
    many = np.maximum(np.searchsorted(first, end - step + wide, "left") - begin, 0)
    u = np.repeat(np.arange(n), many)
    v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    root = _roots(n, u, v)
    order = np.argsort(root, kind="stable")
    root = root[order]
    at = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
    a, z, y = a[order], z[order], y[order]
    x, top, area = np.minimum.reduceat(a, at), y[at], np.add.reduceat(z - a, at)
    return order[at], x, top, np.maximum.reduceat(z, at) - x, np.maximum.reduceat(y, at) - top + 1, area


def page_regions(pages: DataFrame, keys: list[str], low: Column, high: Column, corners: bool = True) -> DataFrame:
    """:func:`regions` of the runs ``low < v <= high``, found where the pixels are read: nothing is dealt out or joined."""
    n, names, kinds = len(keys), [*keys, "region", "x", "y", "w", "h", "area"], [pa.int64(), *[pa.int32()] * 4, pa.int64()]
    given, fields = _given(pages, keys, low, high)

    def made(batch, found):
        # pages stand below each other with a row between them
        page, height, runs = (np.array([f[0] for f in found]), np.array([f[1] for f in found]), [f[2] for f in found])
        y, a, z = np.concatenate(runs, axis=1)
        each = np.repeat(np.arange(len(page)), [r.shape[1] for r in runs])
        top = (np.cumsum(height + 1) - height - 1)[each]
        first, x, row, w, h, area = _boxes(y + top, a, z, int(corners))
        columns = ((y[first] << 32) + a[first], x, row - top[first], w, h, area)
        return pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(page[each[first]], pa.int32())) for j in range(n)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    def task(batches):
        for batch in batches:
            found, size = [], 0
            for i, _, height, blocks in _pages_of(batch, n):
                runs = np.concatenate([np.array(b, np.int64) for b in blocks], axis=1)
                if runs.shape[1]:
                    found.append((i, height, runs))
                    size += runs.shape[1]
                if size >= TOGETHER:
                    yield made(batch, found)
                    found, size = [], 0
            if found:
                yield made(batch, found)

    return given.mapInArrow(task, f"{fields}region long, x int, y int, w int, h int, area long")


def sheet_boxes(found: DataFrame, pages: DataFrame, keys: list[str], share: float = 0.05) -> DataFrame:
    """``keys left top right bottom``: the largest region of ``share`` of the page or more that doesn't touch all borders; without one, the page."""
    each = found.join(pages.select(*keys, "width", "height"), keys)
    whole = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("w") >= F.col("width")) & (F.col("h") >= F.col("height"))
    fit = each.where((F.col("area") >= F.col("width").cast("double") * F.col("height") * share) & ~whole)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("area").desc(), "region"))
    best = fit.withColumn("_place", place).where("_place = 1").select(*keys, "x", "y", "w", "h")
    both = pages.select(*keys, "width", "height").join(best, keys, "left")
    return both.select(
        *keys, F.coalesce("x", F.lit(0)).alias("left"), F.coalesce("y", F.lit(0)).alias("top"),
        F.coalesce(F.col("x") + F.col("w"), "width").alias("right"), F.coalesce(F.col("y") + F.col("h"), "height").alias("bottom"),
    )


def kept_runs(pages: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """:func:`run_table`, kept: pixels are read once."""
    return materialize(run_table(pages, keys, low, high))
