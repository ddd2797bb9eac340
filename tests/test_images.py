"""Page rasters with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import cutouts, images


def page(spark, *arrays):
    rows = [(i, int(a.shape[1]), int(a.shape[0]), bytearray(a.astype(np.uint8).tobytes())) for i, a in enumerate(arrays)]
    return spark.createDataFrame([*rows, (99, None, None, None)], "page int, width int, height int, gray binary")


def back(df):
    return {r["page"]: np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"]) for r in df.where("gray IS NOT NULL").collect()}


def drawn(seed):
    return np.random.default_rng(seed).random((20, 30)) < 0.45


@pytest.mark.parametrize("corners", [True, False])
def test_components_match_a_fill(corners):
    for seed in range(8):
        ink, seen, want = drawn(seed), set(), []
        for y, x in zip(*np.nonzero(ink), strict=True):
            if (y, x) in seen:
                continue
            stack, own = [(y, x)], set()
            while stack:
                p = stack.pop()
                if p in own or not (0 <= p[0] < 20 and 0 <= p[1] < 30) or not ink[p]:
                    continue
                own.add(p)
                stack += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if corners or not (a and b)]
            seen |= own
            ys, xs = zip(*own, strict=True)
            want.append({"x": min(xs), "y": min(ys), "w": max(xs) - min(xs) + 1, "h": max(ys) - min(ys) + 1, "area": len(own)})
        assert images.parts_of(ink, corners) == want


def test_blur_matches_convolution():
    g, k = np.random.default_rng(1).integers(0, 255, (40, 50)), 7
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-(np.arange(-3, 4) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    wide = np.pad(g.astype(float), 3, mode="reflect")
    rows = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 1, wide)
    assert np.allclose(images.blurred(g, k), np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 0, rows))


def test_page_passes(spark):
    sheet = np.full((100, 120), 250)
    sheet[20:80, 30:90] = 10
    skewed = np.full((200, 400), 255)
    for k in range(6):
        x = np.arange(20, 380)
        skewed[np.rint(20 + 25 * k + x * np.tan(np.radians(2.0))).astype(int), x] = 0
        skewed[np.rint(21 + 25 * k + x * np.tan(np.radians(2.0))).astype(int), x] = 0
    pages = page(spark, sheet, skewed, np.full((30, 40), 255))
    found = images.with_histogram(pages).withColumn("t", images.otsu_of(F.col("hist")))
    assert {r["page"]: r["t"] for r in found.collect()}[0] == 10
    assert {k: v.shape for k, v in back(images.main_sheet(pages)).items()}[0] == (60, 60)
    assert back(images.tight(pages))[0].shape == (62, 62) and back(images.tight(pages))[2].shape == (30, 40)
    boxes = spark.createDataFrame([(0, "a", (30, 20, 40, 25))], "page int, name string, rect struct<left:int,top:int,right:int,bottom:int>")
    assert (back(cutouts.crops(pages, boxes, ["page"]))[0] == 10).all()
    assert back(images.toned(pages, images.truncation_table()))[0].max() == 255
    skew = images.with_skew(found, "t")
    assert abs({r["page"]: r["skew"] for r in skew.collect()}[1] - 2.0) < 0.2
    again = images.with_skew(images.with_histogram(images.deskewed(skew)).withColumn("t", F.lit(200)), "t")
    assert abs({r["page"]: r["skew"] for r in again.collect()}[1] or 0) < 0.3
    for out in (images.contrast_limited(pages), images.background_normalized(pages), images.flooded(found, "t")):
        assert set(back(out.select("page", "width", "height", "gray"))) == {0, 1, 2}


def test_sheet_and_block_in_blurs(spark):
    dark = np.full((260, 300), 20)
    dark[40:220, 50:260] = 240
    block = np.full((200, 240), 250)
    block[50:150, 60:180] = 15
    pages = page(spark, dark, block, np.full((60, 60), 255))
    sheet = back(images.outlined_sheet(pages))
    # the blur rounds corners and moves edges by the threshold, not more than a few pixels
    assert abs(sheet[0].shape[0] - 181) <= 12 and abs(sheet[0].shape[1] - 211) <= 12 and sheet[2].shape == (60, 60)
    cut = back(images.music_block(pages))
    assert abs(cut[1].shape[0] - 98) <= 4 and abs(cut[1].shape[1] - 116) <= 4 and (cut[1] == 15).mean() > 0.95


def test_pixel_passes_match_numpy(spark):
    """Flood fill, background and equalisation on small pages, against direct forms."""
    rng = np.random.default_rng(3)
    noisy = rng.integers(60, 256, (48, 64))
    noisy[0, 0:9], noisy[1, 3] = 10, 10  # dark pixels that reach a corner
    noisy[20, 20] = 10
    pages = page(spark, noisy)
    seen, stack = set(), [(0, 0)]
    while stack:
        y, x = stack.pop()
        if (y, x) not in seen and 0 <= y < 48 and 0 <= x < 64 and noisy[y, x] <= 30:
            seen.add((y, x))
            stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    want = noisy.copy()
    for y, x in seen:
        want[y, x] = 255
    ys, xs = np.nonzero(noisy > 30)
    got = back(images.flooded(pages.withColumn("t", F.lit(30)), "t"))[0]
    assert (got == want[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]).all()
    around = np.rint(images.blurred(noisy.astype(np.uint8), 7))
    assert (back(images.background_normalized(pages))[0] == np.minimum(255, np.rint(noisy * 255.0 / around))).all()
    flat = back(images.contrast_limited(pages, clip=1e9, tiles=2))[0]
    tile = noisy[:24, :32]
    # without a clip, near a corner the tile's own cumulative counts decide
    for y, x in ((2, 2), (5, 9), (11, 14)):
        assert abs(int(flat[y, x]) - round((tile <= noisy[y, x]).sum() * 255.0 / tile.size)) <= 1
