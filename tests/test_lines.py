"""Angles of pages by counted votes: turned staves, boxes, and each count by hand."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import images, lines, regions
from tests.test_images import page


def staves(w, h, degrees, thick=3, n=6, gap=None):
    """Five-line staves over most of a page's width, turned about its middle."""
    y, x = np.mgrid[0:h, 0:w]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    u, v = (x - w / 2) * c + (y - h / 2) * s + w / 2, -(x - w / 2) * s + (y - h / 2) * c + h / 2
    gap = gap or h // (n * 9)
    on = np.zeros((h, w), bool)
    for k in range(n):
        for j in range(5):
            top = h * (k + 0.7) / (n + 0.5) + j * gap
            on |= (v >= top) & (v < top + thick) & (u > 0.1 * w) & (u < 0.9 * w)
    return np.where(on, 0, 255)


def measured(spark, *pictures):
    pages = page(spark, *pictures)
    runs = regions.kept_runs(pages, ["page"], F.lit(-1), F.lit(100))
    return {r["page"]: r for r in lines.turned(runs, pages, ["page"]).collect()}


def test_wide_pages_get_their_angles(spark):
    """Lines of three pixels that cross 140 rows: no row has a long run of them."""
    angles = (2.0, -3.4, 0.0, 4.6)
    got = measured(spark, *(staves(4000, 900 if a < 4 else 1200, a, n=3) for a in angles))
    for k, a in enumerate(angles):
        assert got[k]["method"] == "lines" and got[k]["n"] >= 10 and abs(got[k]["angle"] - a) < 0.06, (a, got[k])


def test_the_box_decides_with_few_lines(spark):
    y, x = np.mgrid[0:300, 0:400]
    pictures = []
    for a in (7.0, -12.0, 0.0, 30.0):
        c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
        u, v = (x - 200) * c + (y - 150) * s, -(x - 200) * s + (y - 150) * c
        pictures.append(np.where((abs(u) < 110) & (abs(v) < 60) & ((abs(u) > 104) | (abs(v) > 54)), 0, 255))
    got = measured(spark, *pictures, np.full((20, 30), 255), staves(400, 60, 0, n=1, gap=40))
    for k, a in enumerate((7.0, -12.0, 0.0, 30.0)):
        assert got[k]["method"] == "box" and abs(got[k]["angle"] - a) < 0.8, (a, got[k])
    assert tuple(got[4])[1:] == (0, None, None, "none")
    assert got[5]["method"] == "box" and got[5]["n"] < 5 and got[5]["angle"] == 0
    assert tuple(got[99])[1:] == (0, None, None, "none")


def test_turned_pages_lie_flat(spark):
    pages = page(spark, staves(600, 400, 3.0, n=3))
    runs = regions.kept_runs(pages, ["page"], F.lit(-1), F.lit(100))
    found = pages.join(lines.turned(runs, pages, ["page"]).select("page", F.col("angle").alias("skew")), "page")
    flat = images.deskewed(found).where("gray IS NOT NULL").select("page", "width", "height", "gray")
    again = lines.turned(regions.kept_runs(flat, ["page"], F.lit(-1), F.lit(128)), flat, ["page"]).collect()[0]
    assert again["method"] == "lines" and abs(again["angle"]) < 0.12


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_counts_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    w, slope, runs = 700, (37, -52)[seed - 1], []
    for k in range(12):
        for x in range(0, w - 40, 40):
            runs.append((20 * k + (x + 10) * slope // 1000, x, x + int(rng.integers(9, 21))))
    runs += [(int(rng.integers(0, 240)), a, a + int(rng.integers(1, 30))) for a in rng.integers(0, w - 40, 60).tolist()]
    long_ = [r for r in runs if r[2] - r[1] >= lines.SHORTEST]

    def votes(slopes, wide):
        n = Counter()
        for y, a, z in long_:
            for k in slopes:
                n[k, (2000 * y - k * (a + z - w)) // (2000 * wide)] += z - a
        return n

    energy = Counter()
    for (k, _), n in votes(range(-88, 89, 8), 8).items():
        energy[k] += n * n
    best = max(energy, key=lambda k: (energy[k], -abs(k), k))
    fine = votes(range(best - 8, best + 9), 1)
    order = lambda k, rho: (fine[k, rho], -abs(k), k >= 0, -rho)
    peaks = [o for o, n in fine.items() if n >= 100 and order(*o) == max(order(*p) for p in fine if abs(p[1] - o[1]) <= 4)]
    want = {}
    for k, rho in peaks:
        px = [(x - (w - 1) / 2, y - rho) for y, a, z in long_ if abs(2000 * (y - rho) - k * (a + z - w)) <= 8000 for x in range(a, z)]
        x, y = np.array(px).T
        fit = 1000 * np.polyfit(x, y, 1)[0]
        if abs(fit) <= 88:
            want[rho] = (len(px), fit)
    df = spark.createDataFrame([(1, *map(int, r)) for r in runs], "page int, y int, a int, z int")
    pages = spark.createDataFrame([(1, w)], "page int, width int")
    got = {r["offset"]: (r["n"], r["slope"]) for r in lines.lines(df, pages, ["page"]).collect()}
    assert got.keys() == want.keys() and len(want) >= 5
    for rho, (n, fit) in want.items():
        assert got[rho][0] == n and abs(got[rho][1] - fit) < 1e-6
    assert lines.lines(df.limit(0), pages, ["page"]).count() == 0


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_packed_pages_match_tables(spark, monkeypatch, at_once):
    """The same angles from packed runs, wherever counts are made in parts or far apart, and no page is dealt out."""
    monkeypatch.setattr(lines, "MOST_AT_ONCE", at_once)
    pages = page(spark, staves(600, 400, 3.0, n=3), staves(300, 60, 0, n=1, gap=40), np.full((20, 30), 255))
    packed = regions.packed_runs(pages, ["page"], F.lit(-1), F.lit(100))
    found = lines.turned_pages(packed, ["page"])
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    want = lines.turned(regions.kept_runs(pages, ["page"], F.lit(-1), F.lit(100)), pages, ["page"])
    rows = {r["page"]: tuple(r) for r in found.collect()}
    assert rows == {r["page"]: tuple(r) for r in want.collect()} and {r[4] for r in rows.values()} == {"lines", "box", "none"}


def test_runs_far_apart():
    y, a, z = (np.array(c) for c in ([0, 10**7, 10**7 + 3, 2 * 10**7], [0, 0, 200, 0], [150, 150, 350, 9]))
    assert sorted((rho, n) for _, rho, n in lines.page_lines(400, y, a, z)) and lines.page_tilt(y, a, z) == 0
    assert lines.page_lines(400, y[:0], a[:0], z[:0]) == [] and lines.page_tilt(y[:0], a[:0], z[:0]) is None
