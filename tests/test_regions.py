"""Regions and graphs in tables against flood fills and searches by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import graph, images, regions
from tests.test_images import page


def filled(ink, corners):
    """Box and area of each region by flood fill."""
    h, w = ink.shape
    left, out = ink.copy(), []
    for y in range(h):
        for x in range(w):
            if not left[y, x]:
                continue
            todo, seen = [(y, x)], []
            left[y, x] = False
            while todo:
                b, a = todo.pop()
                seen.append((b, a))
                for db in (-1, 0, 1):
                    for da in (-1, 0, 1):
                        q, p = b + db, a + da
                        if (corners or not db or not da) and 0 <= q < h and 0 <= p < w and left[q, p]:
                            left[q, p] = False
                            todo.append((q, p))
            ys, xs = zip(*seen)
            out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)))
    return sorted(out)


def spiral(n):
    ink = np.zeros((n, n), bool)
    y = x = d = 0
    for k in range(n - 1, 0, -2):
        for _ in range(4):
            for _ in range(k):
                ink[y, x] = True
                y, x = y + (0, 1, 0, -1)[d], x + (1, 0, -1, 0)[d]
            d = (d + 1) % 4
        y, x = y + 1, x + 1
    return ink


@pytest.mark.parametrize("corners", [True, False])
@pytest.mark.parametrize("tile", [4, 64])
def test_regions_match_flood_fill(spark, monkeypatch, corners, tile):
    monkeypatch.setattr(regions, "TILE", tile)
    monkeypatch.setattr(regions, "BATCH", 7)
    rng = np.random.default_rng(tile)
    pictures = [rng.random((24, 33)) < p for p in (0.2, 0.45, 0.6, 1.1)] + [spiral(33), np.eye(40, dtype=bool), np.zeros((3, 3), bool)]
    pages = page(spark, *(np.where(p, 10, 200) for p in pictures))
    found = {}
    for r in regions.regions(regions.kept_runs(pages, ["page"], F.lit(-1), F.lit(10)), ["page"], corners).collect():
        found.setdefault(r["page"], []).append((r["x"], r["y"], r["w"], r["h"], r["area"]))
    for k, p in enumerate(pictures):
        assert sorted(found.get(k, [])) == filled(p, corners)
    assert 99 not in found


@pytest.mark.parametrize("corners", [True, False])
@pytest.mark.parametrize("together", [1, 300, 1 << 18])
def test_regions_of_pages_match_flood_fill(spark, monkeypatch, corners, together):
    monkeypatch.setattr(regions, "TOGETHER", together)
    rng = np.random.default_rng(together)
    pictures = [rng.random((24, 33)) < p for p in (0.2, 0.45, 0.6, 1.1)] + [spiral(33), np.eye(40, dtype=bool), np.zeros((3, 3), bool), np.ones((1, 7), bool), spiral(121)]
    pages = page(spark, *(np.where(p, 10, 200) for p in pictures)).coalesce(1)
    found = {}
    made = regions.page_regions(pages, ["page"], F.lit(-1), F.lit(10), corners)
    assert "Exchange hash" not in made._jdf.queryExecution().executedPlan().toString()
    for r in made.collect():
        found.setdefault(r["page"], []).append((r["x"], r["y"], r["w"], r["h"], r["area"]))
    for k, p in enumerate(pictures):
        assert sorted(found.get(k, [])) == filled(p, corners)
    assert 99 not in found
    assert made.select("page", "region").exceptAll(regions.regions(regions.kept_runs(pages, ["page"], F.lit(-1), F.lit(10)), ["page"], corners).select("page", "region")).isEmpty()


def test_components_of_arrays():
    """Stars whose middle comes last or first, and a chain that goes up and down."""
    for n, u, v in ((2001, np.full(2000, 2000), np.arange(2000)), (2001, np.full(2000, 0), np.arange(1, 2001)), (4096, np.random.default_rng(1).permutation(4096)[:-1], np.random.default_rng(1).permutation(4096)[1:])):
        root = regions._roots(n, u, v)
        assert len(set(root.tolist())) == 1
    assert regions._roots(3, np.array([], int), np.array([], int)).tolist() == [0, 1, 2]


def test_limits_part_values(spark):
    p = page(spark, np.array([[0, 5, 6, 9, 255]]))
    assert [tuple(r) for r in regions.run_table(p, ["page"], F.lit(0), F.lit(6)).collect()] == [(0, 0, 1, 3)]
    assert regions.run_table(p, ["page"], F.lit(None), F.lit(6)).count() == 0


def test_sheet_boxes_match_pixel_passes(spark):
    rng = np.random.default_rng(9)
    pictures = []
    for k in range(6):
        p = np.full((60, 80), 255)
        p[10 + k : 40, 5 : 30 + k] = 3
        p[45:58, 50:78] = 3
        pictures.append(np.where(rng.random(p.shape) < 0.02, 3, p))
    frame = np.full((30, 30), 255)
    frame[[0, -1], :] = frame[:, [0, -1]] = 3
    pages = page(spark, *pictures, frame, np.full((20, 20), 255))
    limits = images.with_histogram(pages).withColumn("_t", images.otsu_of(F.col("hist"))).where("width IS NOT NULL")
    found = regions.regions(regions.kept_runs(limits, ["page"], F.lit(-1), F.col("_t")), ["page"])
    boxes = {r["page"]: (r["right"] - r["left"], r["bottom"] - r["top"]) for r in regions.sheet_boxes(found, limits, ["page"]).collect()}
    assert boxes == {r["page"]: (r["width"], r["height"]) for r in images.main_sheet(pages).where("width IS NOT NULL").collect()}
    assert boxes[6] == (30, 30) and boxes[7] == (20, 20)


def graphs(seed):
    rng = random.Random(seed)
    edges = [("g", k, k + 1) for k in range(20)] + [("g", 20, 20), ("h", 5, 3), ("h", 3, 5), ("h", 3, 5)]
    edges += [("r", rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    return edges


def test_components_of_graphs(spark):
    edges = graphs(1)
    got = {(r["g"], r["node"]): r["root"] for r in graph.components(spark.createDataFrame(edges, "g string, u long, v long"), ["g"]).collect()}
    want = {}
    for g in "ghr":
        root = {x: x for e in edges if e[0] == g for x in e[1:]}
        for _ in root:
            for _, a, b in (e for e in edges if e[0] == g):
                root[a] = root[b] = min(root[a], root[b])
        want |= {(g, x): r for x, r in root.items()}
    linked = {(g, x) for g, a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


def test_reached_and_cycles(spark):
    edges = graphs(2)
    df = spark.createDataFrame(edges, "g string, up long, down long")
    reach = graph.reached(df, ["g"])
    want = {}
    for g in "ghr":
        mine = [(a, b) for k, a, b in edges if k == g]
        for x in {x for e in mine for x in e}:
            level, n = {x}, 0
            while level:
                want |= {(g, x, y): n for y in level}
                level, n = {b for a, b in mine if a in level and (g, x, b) not in want}, n + 1
    assert {(r["g"], r["node"], r["to"]): r["n"] for r in reach.collect()} == want
    looped = {(g, b) for g, a, b in edges if (g, b, a) in want}
    assert {tuple(r) for r in graph.cycles(reach, df, ["g"]).collect()} == looped
    one = graph.reached(df, ["g"], spark.createDataFrame([("g", 18), ("z", 1)], "g string, node long"))
    assert sorted(map(tuple, one.collect())) == [("g", 18, 18, 0), ("g", 18, 19, 1), ("g", 18, 20, 2), ("z", 1, 1, 0)]
    assert graph.reached(df.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize(("gathered", "kind"), [(6, "long"), (50_000, "string")])
def test_followed_as_by_rounds(spark, monkeypatch, gathered, kind):
    """Small graphs by tasks and large ones by joins give the same."""
    monkeypatch.setattr(graph, "GATHERED", gathered)
    rng = random.Random(3)
    edges = [(f"s{g}", rng.randrange(9), rng.randrange(9)) for g in range(30) for _ in range(rng.randrange(1, 12))] + [("s1", 3, None), ("s2", None, 4)]
    df = spark.createDataFrame(edges, "g string, up long, down long").selectExpr("g", f"cast(up as {kind}) as up", f"cast(down as {kind}) as down")
    starts = spark.createDataFrame([(g, x) for g in ["z", *(f"s{k}" for k in range(30))] for x in (7, 3, 18, 3)], "g string, node long").selectExpr("g", f"cast(node as {kind}) as node")
    of = lambda x: sorted(map(repr, x.select("g", "node", "because", "n", "in_cycle").collect()))
    got = graph.followed(df, ["g"], starts)
    assert of(got) == of(graph._by_rounds(df, ["g"], starts))


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    """A chain of 300 is one task's, not 300 joins."""
    monkeypatch.setattr(graph, "reached", None)
    df = spark.createDataFrame([(g, k, k + 1) for g in range(3) for k in range(300)] + [(2, 300, 0)], "g int, up int, down int")
    got = graph.followed(df, ["g"], spark.createDataFrame([(0, 5), (2, 0), (2, 9)], "g int, node int")).collect()
    assert {r["node"]: r["n"] for r in got if r["g"] == 0} == {k: k - 5 for k in range(5, 301)}
    assert [r["in_cycle"] for r in got if r["g"] == 2] == [True] * 301 and not any(r["in_cycle"] for r in got if r["g"] == 0)
    assert {r["because"] for r in got if r["g"] == 2} == {0, 9}
