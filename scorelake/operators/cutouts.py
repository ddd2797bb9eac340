"""Cut-outs of page images: each page goes to Python once with its boxes, and comes out as its parts.

A page's boxes are dealt into groups of ``BOXES``; the page is joined to its groups, not to
its boxes, so its pixels are read once whatever their number and a page
with very many boxes is no task's alone. Parts leave in batches of ``BATCH`` bytes.

Defined results: a box is cut to the page; what has no area then, a null box, and all boxes of a page
without pixels give a part of width and height 0 without pixels (null), so every box has its row.
Boxes of pages that aren't there, and pages without boxes, give none.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boxes that share one copy of a page, and bytes of parts in one batch.
BOXES, BATCH = 1024, 8 << 20


def png(gray: np.ndarray) -> bytes:
    """A page of bytes as a PNG file."""
    h, w = gray.shape
    rows = np.zeros((h, w + 1), np.uint8)  # each row after its filter's number
    rows[:, 1:] = gray
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def dealt(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys boxes``: groups of at most some ``BOXES`` boxes of a page, ``array<struct<name, left, top, right, bottom>>``."""
    counted = boxes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BOXES).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("name", F.to_json(F.struct("rect"))), F.col("_parts")).alias("_part")
    box = F.struct("name", *(F.col("rect")[c].cast("int").alias(c) for c in ("left", "top", "right", "bottom"))).alias("box")
    rows = boxes.join(counted, keys).select(*keys, part, box)
    return rows.groupBy(*keys, "_part").agg(F.collect_list("box").alias("boxes")).drop("_part")


def crops(pages: DataFrame, boxes: DataFrame, keys: list[str], as_png: bool = False) -> DataFrame:
    """``keys name width height gray`` of the boxes ``keys name rect`` (left, top, right, bottom; ends exclusive); ``as_png``: ``data`` in place of ``gray``.

    ``pages``: keys, width, height, gray (row by row, a byte a pixel), one row for each page.
    """
    whole = pages.select(*keys, "width", "height", "gray").join(dealt(boxes, keys), keys)
    last = "data" if as_png else "gray"
    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "name", "width", "height", last]

    def parts(w, h, gray, found):
        image = np.frombuffer(gray, np.uint8).reshape(h, w) if gray is not None and w and h else None
        for b in found:
            edges = [b[c] for c in ("left", "top", "right", "bottom")]
            if image is None or None in edges:
                yield b["name"], 0, 0, None
                continue
            x0, y0, x1, y1 = max(0, edges[0]), max(0, edges[1]), min(w, edges[2]), min(h, edges[3])
            if x1 <= x0 or y1 <= y0:
                yield b["name"], 0, 0, None
                continue
            cut = image[y0:y1, x0:x1]
            yield b["name"], x1 - x0, y1 - y0, png(cut) if as_png else cut.tobytes()

    def made(row, out):
        n = pa.array([0] * len(out), pa.int32())
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([*(row.column(j).take(n) for j in range(len(keys))), *(pa.array(c, t) for c, t in zip(zip(*out), types, strict=True))], names=names)

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, out, size = batch.slice(i, 1), [], 0
                w, h = (row.column(len(keys) + k)[0].as_py() for k in range(2))
                gray = row.column(len(keys) + 2)[0]
                for part in parts(w, h, gray.as_buffer() if gray.is_valid else None, row.column(len(keys) + 3)[0].as_py()):
                    out.append(part)
                    size += len(part[3] or b"")
                    if size >= BATCH:
                        yield made(row, out)
                        out, size = [], 0
                if out:
                    yield made(row, out)

    return whole.mapInArrow(task, f"{fields}, name string, width int, height int, {last} binary")


def named(folder: Column, number: Column, kind: str) -> Column:
    """File names ``folder/systems/system_0001.png`` of numbered parts."""
    return F.concat(folder, F.format_string(f"/{kind}s/{kind}_%04d.png", number))
