"""Page rasters: small numpy passes over the pixels of a page, decisions in columns.

A page is a row ``width height gray`` (row-major bytes) with any keys. Passes add
counts as array columns (``hist``, ``rows``, ``cols``, ``parts``), from which expressions
find thresholds and boxes without a shuffle, so a page's pixels never move between
executors and one task holds one batch of pages. Rows aren't made of pixels.
Defined results: pages without pixels and null pages stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = "array<struct<x:int,y:int,w:int,h:int,area:bigint>>"
_PART = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("area", pa.int64())]))


def _map(pages: DataFrame, fn, args: list[str], new: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``pages`` with the columns ``new`` (replaced where there) from ``fn(image, *args)``, page by page.

    An image is None for null pages and pages without pixels.
    """
    kept = [c for c in pages.columns if c not in new]
    fields = [pages.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, (t, _) in new.items()]
    names = [f.name for f in fields]

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                value = lambda c: row.column(c)[0].as_py()  # noqa: B023, E731
                w, h, gray = value("width"), value("height"), row.column("gray")[0].as_buffer() if row.column("gray")[0].is_valid else None
                image = np.frombuffer(gray, np.uint8).reshape(h, w) if gray is not None and w and h else None
                out = fn(image, *(value(a) for a in args))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in kept), *(pa.array([out.get(n, value(n) if n in row.schema.names else None)], t) for n, (_, t) in new.items())], names=names
                )

    return pages.mapInArrow(task, T.StructType(fields))


def _page(image) -> dict:
    return {"gray": np.ascontiguousarray(image, np.uint8).tobytes(), "width": image.shape[1], "height": image.shape[0]}


_NEW_PAGE = {"width": ("int", pa.int32()), "height": ("int", pa.int32()), "gray": ("binary", pa.binary())}


def with_histogram(pages: DataFrame) -> DataFrame:
    """``hist``: 256 counts of values."""
    return _map(pages, lambda g: {"hist": [] if g is None else np.bincount(g.ravel(), minlength=256).tolist()}, [], {"hist": ("array<bigint>", pa.list_(pa.int64()))})


def otsu_of(hist: Column) -> Column:
    """The threshold of a histogram array; values above it are light. Ties: the least; one value only: 0."""
    total = F.aggregate(hist, F.lit(0).cast("double"), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(hist, lambda x, i: x * i), F.lit(0).cast("double"), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(a, x):
        w, s = a["w"] + x, a["s"] + x * a["i"]
        lead = weighted * w - s * total
        score = F.when((w > 0) & (w < total), lead * lead / (w * (total - w))).otherwise(F.lit(-1.0))
        better = score > a["best"]
        return F.struct(
            w.alias("w"), s.alias("s"), F.when(better, score).otherwise(a["best"]).alias("best"), F.when(better, a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i")
        )

    return F.aggregate(hist, start, step, lambda a: a["at"])


def shifted(image: np.ndarray, pick, cross: bool) -> np.ndarray:
    """3 x 3 minimum or maximum (``cross``: the five nearest pixels)."""
    p = np.pad(image, 1, mode="edge")
    h, w = image.shape
    out = image
    for dy in range(3):
        for dx in range(3):
            if not cross or dy == 1 or dx == 1:
                out = pick(out, p[dy : dy + h, dx : dx + w])
    return out


def opened(ink: np.ndarray, cross: bool = False) -> np.ndarray:
    return shifted(shifted(ink, np.minimum, cross), np.maximum, cross)


def runs(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``y start end`` of each row's runs of ink, in reading order (ends exclusive)."""
    edges = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, start = np.nonzero(edges == 1)
    return y, start, np.nonzero(edges == -1)[1]


def labelled(ink: np.ndarray, corners: bool = True) -> tuple[tuple, np.ndarray]:
    """Runs and the component of each; runs that touch (``corners``: also by a corner) are one."""
    y, a, z = runs(ink)
    root = np.arange(len(y))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(y, np.arange(ink.shape[0] + 1))
    more = int(corners)
    for row in range(1, ink.shape[0]):
        i, j = first[row - 1], first[row]
        while i < first[row] and j < first[row + 1]:
            if a[i] < z[j] + more and a[j] < z[i] + more:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if z[i] < z[j]:
                i += 1
            else:
                j += 1
    return (y, a, z), np.array([find(i) for i in range(len(y))], np.int64)


def parts_of(ink: np.ndarray, corners: bool = True) -> list[dict]:
    """Box and area of each component, in the order of their first pixels."""
    (y, a, z), label = labelled(ink, corners)
    names, k = np.unique(label, return_inverse=True)
    n = len(names)
    x0, y0, x1, y1 = np.full(n, 1 << 30), np.full(n, 1 << 30), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(x0, k, a), np.minimum.at(y0, k, y), np.maximum.at(x1, k, z), np.maximum.at(y1, k, y + 1)
    area = np.bincount(k, z - a, n).astype(int)
    return [dict(zip("x y w h area".split(), map(int, v), strict=True)) for v in zip(x0, y0, x1 - x0, y1 - y0, area, strict=True)]


def with_profiles(pages: DataFrame, threshold: str, denoise: bool = False) -> DataFrame:
    """``rows`` and ``cols``: how many pixels of each row and column are at most the threshold."""

    def count(g, t):
        if g is None or t is None:
            return {"rows": [], "cols": []}
        ink = (g <= t).astype(np.uint8)
        ink = opened(ink, cross=True) if denoise else ink
        return {"rows": ink.sum(1, dtype=np.int64).tolist(), "cols": ink.sum(0, dtype=np.int64).tolist()}

    return _map(pages, count, [threshold], {c: ("array<bigint>", pa.list_(pa.int64())) for c in ("rows", "cols")})


def with_parts(pages: DataFrame, threshold: str, dark: bool = True, denoise: bool = False) -> DataFrame:
    """``parts``: boxes and areas of the components of dark (or light) pixels."""

    def find(g, t):
        if g is None or t is None:
            return {"parts": []}
        ink = (g <= t) == dark
        return {"parts": parts_of(opened(ink.astype(np.uint8)) if denoise else ink)}

    return _map(pages, find, [threshold], {"parts": (PARTS, _PART)})


def best_part(parts: Column, score, fit) -> Column:
    """The part of the highest score among those that fit, the first among equals; null where none does."""
    rated = F.filter(
        F.transform(parts, lambda p, i: F.struct(score(p).cast("double").alias("s"), (-i).alias("i"), p.alias("p"), fit(p).alias("ok"))), lambda r: r["ok"]
    )
    return F.array_max(F.transform(rated, lambda r: F.struct(r["s"].alias("s"), r["i"].alias("i"), r["p"].alias("p"))))["p"]


def cropped(pages: DataFrame, left: str, top: str, right: str, bottom: str) -> DataFrame:
    """Pages cut to a box (ends exclusive, columns); null or empty boxes leave a page as it is."""

    def cut(g, x0, y0, x1, y1):
        if g is None or None in (x0, y0, x1, y1) or x1 <= x0 or y1 <= y0:
            return {}
        return _page(g[y0:y1, x0:x1])

    return _map(pages, cut, [left, top, right, bottom], _NEW_PAGE)


def flooded(pages: DataFrame, threshold: str) -> DataFrame:
    """Dark regions that reach a corner become white, then all but the light pixels' box goes."""

    def fill(g, t):
        if g is None or t is None:
            return {}
        dark, out = g <= t, g.copy()
        (y, a, z), label = labelled(dark, corners=False)
        h, w = g.shape
        at_corner = np.isin(y, (0, h - 1)) & ((a == 0) | (z == w))
        for i in np.flatnonzero(np.isin(label, label[at_corner])):
            out[y[i], a[i] : z[i]] = 255
        light = np.argwhere(~dark)
        if not len(light):
            return {}
        (y0, x0), (y1, x1) = light.min(0), light.max(0) + 1
        return _page(out[y0:y1, x0:x1])

    return _map(pages, fill, [threshold], _NEW_PAGE)


# Weights of small blurs.
SMALL = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}


def blurred(image: np.ndarray, k: int) -> np.ndarray:
    """Gaussian blur of odd size k, mirrored at the edges without the edge pixel; as floats."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    x = np.arange(k) - k // 2
    kernel = np.array(SMALL[k], np.float64) if k in SMALL else np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs((np.arange(-(k // 2), n + k // 2) + n - 1) % max(1, 2 * n - 2) - (n - 1)) if n > 1 else np.zeros(k, int)
        wide = np.take(out, at, axis)
        size = wide.shape[axis] + k
        spectrum = np.fft.rfft(kernel, size)
        spectrum = spectrum[:, None] if axis == 0 else spectrum
        full = np.fft.irfft(np.fft.rfft(wide, size, axis) * spectrum, size, axis)
        out = np.take(full, np.arange(k - 1, k - 1 + n), axis)
    return out


def background_normalized(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """Each pixel over its blurred surroundings, times 255, at most 255; where those are 0, 0."""

    def even(g):
        if g is None:
            return {}
        k = max(3, round(g.shape[1] * share)) | 1
        around = np.rint(blurred(g, k))
        return _page(np.where(around > 0, np.minimum(255, np.rint(g * 255.0 / np.maximum(around, 1))), 0))

    return _map(pages, even, [], _NEW_PAGE)


def toned(pages: DataFrame, table: list[int]) -> DataFrame:
    """Each value replaced by its entry in a table of 256, such as :func:`gamma_table`."""
    t = np.array(table, np.uint8)
    return _map(pages, lambda g: {} if g is None else _page(t[g]), [], _NEW_PAGE)


def gamma_table(g: float = 2.0) -> list[int]:
    return [int((i / 255.0) ** (1.0 / g) * 255) for i in range(256)]


def truncation_table(limit: int = 200) -> list[int]:
    return [255 if i >= limit else i for i in range(256)]


def with_skew(pages: DataFrame, threshold: str, least: int = 5, most: float = 5.0) -> DataFrame:
    """``skew``: the median angle in degrees of long horizontal strokes, null with fewer than ``least``.

    Strokes are components of rows' runs that are long enough; the angle of each is
    that of its pixels' least-squares line. Unlike a randomised line search, this
    gives one result.
    """

    def angle(g, t):
        if g is None or t is None:
            return {"skew": None}
        long_ = max(40, g.shape[1] // 12)
        y, a, z = runs(g <= t)
        ok = z - a >= long_
        kept = np.zeros(g.shape, bool)
        for i in np.flatnonzero(ok):
            kept[y[i], a[i] : z[i]] = True
        (y, a, z), label = labelled(kept)
        found = []
        for name in np.unique(label):
            m = label == name
            n, x, v = z[m] - a[m], (a[m] + z[m] - 1) / 2, y[m]
            mx, my = np.average(x, weights=n), np.average(v, weights=n)
            var = (n * ((x - mx) ** 2 + (n**2 - 1) / 12)).sum()
            found.append(float(np.degrees(np.arctan2((n * (x - mx) * (v - my)).sum(), var))))
        found = [d for d in found if -most < d < most]
        return {"skew": float(np.median(found)) if len(found) >= least else None}

    return _map(pages, angle, [threshold], {"skew": ("double", pa.float64())})


def deskewed(pages: DataFrame, skew: str = "skew", least: float = 0.1) -> DataFrame:
    """Pages turned about their centre so that strokes at ``skew`` degrees lie flat; same size, edges repeated, linear."""

    def turn(g, d):
        if g is None or d is None or abs(d) < least:
            return {}
        h, w = g.shape
        c, s = np.cos(np.radians(d)), np.sin(np.radians(d))
        y, x = np.mgrid[0:h, 0:w]
        dx, dy = x - w // 2, y - h // 2
        sx, sy = np.clip(dx * c - dy * s + w // 2, 0, w - 1), np.clip(dx * s + dy * c + h // 2, 0, h - 1)
        x0, y0 = np.minimum(sx.astype(int), max(0, w - 2)), np.minimum(sy.astype(int), max(0, h - 2))
        fx, fy = sx - x0, sy - y0
        x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
        v = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
        return _page(np.rint(v))

    return _map(pages, turn, [skew], _NEW_PAGE)


def contrast_limited(pages: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Adaptive histogram equalisation: per tile with clipped counts, blended linearly between tile centres."""

    def even(g):
        if g is None:
            return {}
        h, w = g.shape
        th, tw = -(-h // tiles), -(-w // tiles)
        p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th, tw) else "edge")
        limit = max(1, int(clip * th * tw / 256))
        maps = np.empty((tiles, tiles, 256))
        for i in range(tiles):
            for j in range(tiles):
                n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
                over = int(np.maximum(n - limit, 0).sum())
                n = np.minimum(n, limit) + over // 256 + (np.arange(256) < over % 256)
                maps[i, j] = np.minimum(255, np.rint(np.cumsum(n) * 255.0 / (th * tw)))
        fy, fx = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
        y0, x0 = np.minimum(fy.astype(int), tiles - 2), np.minimum(fx.astype(int), tiles - 2)
        a, b = (fy - y0)[:, None], (fx - x0)[None, :]
        at = lambda dy, dx: maps[(y0 + dy)[:, None], (x0 + dx)[None, :], g]
        return _page(np.rint((at(0, 0) * (1 - b) + at(0, 1) * b) * (1 - a) + (at(1, 0) * (1 - b) + at(1, 1) * b) * a))

    return _map(pages, even, [], _NEW_PAGE)


def main_sheet(pages: DataFrame) -> DataFrame:
    """Pages cut to their largest dark component of 5 % of the page or more that doesn't touch all borders."""
    found = with_parts(with_histogram(pages).withColumn("_t", otsu_of(F.col("hist"))), "_t")
    w, h = F.col("width"), F.col("height")
    touches = lambda p: (p["x"] == 0) & (p["y"] == 0) & (p["x"] + p["w"] >= w) & (p["y"] + p["h"] >= h)
    best = best_part(F.col("parts"), lambda p: p["area"], lambda p: (p["area"] >= w * h * 0.05) & ~touches(p))
    return _cut_to(found, best, pages.columns, 0.0)


def _in_blurred(pages: DataFrame, size, dark: bool, denoise: bool = False) -> DataFrame:
    """``pages`` with the ``parts`` of their blurred images, parted by the blurred images' threshold."""
    blur = _map(pages.withColumn("_sharp", F.col("gray")), lambda g: {} if g is None else _page(np.rint(blurred(g, size(g)))), [], _NEW_PAGE)
    found = with_parts(with_histogram(blur).withColumn("_t", otsu_of(F.col("hist"))), "_t", dark, denoise)
    return found.withColumn("gray", F.col("_sharp"))


def outlined_sheet(pages: DataFrame) -> DataFrame:
    """Pages cut to the light region of the largest box that doesn't touch all borders, found in a coarse blur."""
    found = _in_blurred(pages, lambda g: max(51, min(g.shape) // 8) | 1, dark=False)
    w, h = F.col("width"), F.col("height")
    touches = lambda p: (p["x"] == 0) & (p["y"] == 0) & (p["x"] + p["w"] >= w) & (p["y"] + p["h"] >= h)
    best = best_part(F.col("parts"), lambda p: p["w"].cast("long") * p["h"], lambda p: ~touches(p))
    # a box ends with one more row and column, where the page has them
    wider = F.when(best.isNotNull(), F.struct(best["x"].alias("x"), best["y"].alias("y"), (best["w"] + 1).alias("w"), (best["h"] + 1).alias("h")))
    return _cut_to(found, wider, pages.columns, 0.0)


def music_block(pages: DataFrame) -> DataFrame:
    """Pages cut to their best block by area and closeness to the centre, shrunk by 1 % on each side."""
    found = _in_blurred(pages, lambda g: 5, dark=True, denoise=True)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    dx, dy = (lambda p: p["x"] + p["w"] / 2.0 - w / 2.0), (lambda p: p["y"] + p["h"] / 2.0 - h / 2.0)
    score = lambda p: p["w"] * p["h"] - 0.5 * (dx(p) * dx(p) + dy(p) * dy(p))
    fit = lambda p: (p["w"] * p["h"]).between(w * h * 0.1, w * h * 0.95) & (p["w"] / p["h"]).between(0.3, 3.0) & (score(p) > -1)
    return _cut_to(found, best_part(F.col("parts"), score, fit), pages.columns, 0.01)


def _cut_to(pages: DataFrame, part: Column, columns: list[str], shrink: float) -> DataFrame:
    sx, sy = F.floor(F.col("width") * shrink), F.floor(F.col("height") * shrink)
    boxed = pages.withColumn("_p", part).withColumns(
        {
            "_l": (F.col("_p.x") + sx).cast("int"), "_u": (F.col("_p.y") + sy).cast("int"),
            "_r": (F.col("_p.x") + F.col("_p.w") - sx).cast("int"), "_d": (F.col("_p.y") + F.col("_p.h") - sy).cast("int"),
        }
    )
    return cropped(boxed, "_l", "_u", "_r", "_d").select(*columns)


def tight(pages: DataFrame, share: float = 0.01) -> DataFrame:
    """Pages cut to their ink and a margin."""
    found = with_profiles(with_histogram(pages).withColumn("_t", otsu_of(F.col("hist"))), "_t")
    first = lambda c: F.array_position(F.transform(c, lambda x: x > 0), True) - 1
    margin = F.floor(F.greatest("width", "height") * share)
    end = lambda c: F.size(c) - first(F.reverse(c))
    none = F.exists("rows", lambda x: x > 0)
    boxed = found.withColumns(
        {
            "_l": F.when(none, F.greatest(F.lit(0), first(F.col("cols")) - margin)).cast("int"), "_u": F.when(none, F.greatest(F.lit(0), first(F.col("rows")) - margin)).cast("int"),
            "_r": F.when(none, F.least("width", end(F.col("cols")) + margin)).cast("int"), "_d": F.when(none, F.least("height", end(F.col("rows")) + margin)).cast("int"),
        }
    )
    return cropped(boxed, "_l", "_u", "_r", "_d").select(*pages.columns)
