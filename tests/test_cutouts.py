"""Cut-outs: parts against slices by hand, pixels that cross once, PNG files that are written and read back."""

import random
import zlib

import numpy as np
import pytest

from scorelake.operators import cutouts
from scorelake.sources import named_files

BOXES = "page int, name string, rect struct<left:int,top:int,right:int,bottom:int>"
PAGES = "page int, width int, height int, gray binary, extra string"


def image(page, w=50, h=40):
    return np.random.default_rng(page).integers(0, 256, (h, w)).astype(np.uint8)


@pytest.mark.parametrize("boxes,batch", [(1024, 8 << 20), (3, 100)])
def test_parts_match_slices(spark, monkeypatch, boxes, batch):
    monkeypatch.setattr(cutouts, "BOXES", boxes)
    monkeypatch.setattr(cutouts, "BATCH", batch)
    rng, rows, want = random.Random(1), [], {}
    for page in (1, 2, 3):
        for k in range(40):
            x0, y0, x1, y1 = rng.randint(-5, 55), rng.randint(-5, 45), rng.randint(-5, 60), rng.randint(-5, 60)
            rows.append((page, f"n{k}", (x0, y0, x1, y1)))
            part = image(page)[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] if page < 3 else np.zeros((0, 0))
            want[page, f"n{k}"] = (part.shape[1], part.shape[0], part.astype(np.uint8).tobytes()) if part.size else (0, 0, None)
    rows += [(1, "n0", rows[0][2]), (2, "none", None), (9, "no page", (0, 0, 1, 1))]
    want[2, "none"] = (0, 0, None)
    pages = [(p, 50, 40, bytearray(image(p).tobytes()), "x") for p in (1, 2, 4)] + [(3, 0, 0, None, None)]
    got = cutouts.crops(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rows, BOXES).repartition(4), ["page"])
    assert got.columns == ["page", "name", "width", "height", "gray"]
    found = got.collect()
    assert len(found) == len(rows) - 1
    for r in found:
        assert (r["width"], r["height"], None if r["gray"] is None else bytes(r["gray"])) == want[r["page"], r["name"]]


def test_a_page_crosses_once_for_many_boxes(spark):
    pages = spark.createDataFrame([(1, 50, 40, bytearray(image(1).tobytes()), "x")], PAGES)
    boxes = spark.createDataFrame([(1, f"n{k}", (0, 0, 2 + k % 9, 3)) for k in range(900)], BOXES)
    assert cutouts.dealt(boxes, ["page"]).count() == 1
    assert cutouts.crops(pages, boxes, ["page"]).count() == 900
    assert cutouts.crops(pages, boxes.limit(0), ["page"]).count() == cutouts.crops(pages.limit(0), boxes, ["page"]).count() == 0


def decoded(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(data[at + 4 : at + 8 + n])
        if kind == b"IHDR":
            w, h = (int.from_bytes(data[at + 8 + k : at + 12 + k], "big") for k in (0, 4))
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:]


def test_png_files_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(p, 50, 40, bytearray(image(p).tobytes()), "x") for p in (1, 2)], PAGES)
    boxes = spark.createDataFrame([(p, f"systems/system_{10 * p + k:04d}.png", (k, 2 * k, 30, 31)) for p in (1, 2) for k in range(5)], BOXES)
    named_files.write_files(cutouts.crops(pages, boxes, ["page"], as_png=True).where("data IS NOT NULL"), str(tmp_path))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).collect()
    assert len(found) == 10
    for r in found:
        p, k = divmod(int(r["path"][-8:-4]), 10)
        assert (decoded(bytes(r["content"])) == image(p)[2 * k : 31, k:30]).all()
