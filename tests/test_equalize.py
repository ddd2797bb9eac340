"""Tile maps against plain numpy, and evened pages against the pixel pass."""

import numpy as np

from scorelake.operators import equalize, images
from tests.test_images import back, page


def plain_maps(g, clip, tiles):
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th, tw) else "edge")
    limit, out = max(1, int(clip * th * tw / 256)), []
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256 + (np.arange(256) < over % 256)
            out.append(np.minimum(255, np.rint(np.cumsum(n) * 255.0 / (th * tw))).astype(int).tolist())
    return out


def test_maps_and_pages(spark):
    rng = np.random.default_rng(4)
    pictures = [rng.integers(0, 256, (64, 80)), rng.integers(90, 110, (61, 37)), np.full((30, 30), 7), np.clip(rng.normal(200, 30, (100, 50)), 0, 255).astype(int), rng.integers(0, 256, (3, 90))]
    pages = page(spark, *pictures)
    for clip, tiles in ((2.0, 8), (40.0, 3)):
        maps = {r["page"]: r["maps"] for r in equalize.tile_maps(equalize.tile_counts(pages, ["page"], tiles), ["page"], clip).collect()}
        assert maps == {k: plain_maps(p, clip, tiles) for k, p in enumerate(pictures)}
        done, want = back(equalize.equalized(pages, ["page"], clip, tiles)), back(images.contrast_limited(pages, clip, tiles))
        assert done.keys() == want.keys() and all((done[k] == want[k]).all() for k in want)
    assert equalize.equalized(pages, ["page"]).count() == len(pictures) + 1
