"""Contrast of page images evened out tile by tile, with limited slopes.

One pass counts the values of each tile; clipping, spreading what was clipped and the cumulative
maps are windows over rows ``page tile v n``; a second pass looks each pixel up in
the maps of the four tiles around it. A page's pixels are joined to its maps once.

Defined results: pages without pixels and null pages stay as they are; a page that isn't a whole
number of tiles is continued by its mirror image (by its edge, if it is smaller than a tile).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.images import _NEW_PAGE, _map, _page
from scorelake.sources.tables import materialize


def tile_counts(pages: DataFrame, keys: list[str], tiles: int = 8) -> DataFrame:
    """``keys size tile v n``: how often each tile holds each value that it has, size being a tile's pixels."""
    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                w, h = (batch.column(len(keys) + k)[i].as_py() for k in range(2))
                gray = batch.column(len(keys) + 2)[i]
                if not gray.is_valid or not w or not h:
                    continue
                th, tw = -(-h // tiles), -(-w // tiles)
                g = np.frombuffer(gray.as_buffer(), np.uint8).reshape(h, w)
                p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th, tw) else "edge")
                place = (np.arange(th * tiles) // th)[:, None] * tiles + np.arange(tw * tiles) // tw
                n = np.bincount((place * 256 + p).ravel(), minlength=tiles * tiles * 256)
                at = np.flatnonzero(n)
                same = pa.array(np.full(len(at), i), pa.int32())
                columns = (pa.array(np.full(len(at), th * tw), pa.int64()), pa.array(at // 256, pa.int32()), pa.array(at % 256, pa.int32()), pa.array(n[at], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(same) for j in range(len(keys))), *columns], names=[*keys, "size", "tile", "v", "n"])

    return pages.select(*keys, "width", "height", "gray").mapInArrow(task, f"{fields}, size long, tile int, v int, n long")


def tile_maps(counts: DataFrame, keys: list[str], clip: float = 2.0) -> DataFrame:
    """``keys maps``: for each tile of a page, in order, the 256 values that take the place of its own."""
    limit = F.greatest(F.lit(1), F.floor(F.lit(clip) * F.col("size") / 256))
    each = counts.withColumn("_limit", limit)
    over = each.groupBy(*keys, "tile", "size", "_limit").agg(F.sum(F.greatest(F.col("n") - F.col("_limit"), F.lit(0))).alias("_over"))
    dense = over.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v")).join(counts.select(*keys, "tile", "v", "n"), [*keys, "tile", "v"], "left")
    n = F.least(F.coalesce("n", F.lit(0)), F.col("_limit")) + F.floor(F.col("_over") / 256) + (F.col("v") < F.col("_over") % 256).cast("long")
    upto = Window.partitionBy(*keys, "tile").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.least(F.lit(255.0), F.rint(F.sum(n).over(upto) * 255.0 / F.col("size"))).cast("int")
    rows = dense.select(*keys, "tile", "v", value.alias("to"))
    tiles = rows.groupBy(*keys, "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "to"))), lambda x: x["to"]).alias("map"))
    return tiles.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "map"))), lambda x: x["map"]).alias("maps"))


def equalized(pages: DataFrame, keys: list[str], clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """``pages`` with even contrast; between tiles' middles the maps are blended linearly."""
    maps = materialize(tile_maps(materialize(tile_counts(pages, keys, tiles)), keys, clip))

    def look_up(g, found):
        if g is None or found is None:
            return {}
        m = np.array(found, np.float64).reshape(tiles, tiles, 256)
        h, w = g.shape
        th, tw = -(-h // tiles), -(-w // tiles)
        fy, fx = (np.clip((np.arange(n) + 0.5) / t - 0.5, 0, tiles - 1) for n, t in ((h, th), (w, tw)))
        y, x = (np.minimum(f.astype(int), tiles - 2) for f in (fy, fx))
        a, b = (fy - y)[:, None], (fx - x)[None, :]
        at = lambda dy, dx: m[(y + dy)[:, None], (x + dx)[None, :], g]
        return _page(np.rint((at(0, 0) * (1 - b) + at(0, 1) * b) * (1 - a) + (at(1, 0) * (1 - b) + at(1, 1) * b) * a))

    return _map(pages.join(maps, keys, "left"), look_up, ["maps"], _NEW_PAGE).select(*pages.columns)
