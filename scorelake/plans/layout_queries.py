"""Layouts over the driver's tables: an order is a system, its lines are measures or staves, a customer a score."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.geometry import crop_rect, padding, raster_dpi
from scorelake.operators import candidates, layout, reconcile

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _bounds(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    key = ["l_orderkey"]
    systems = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("l_orderkey"),
        padding(F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise((F.col("o_orderkey") % 23).cast("string"))).alias("padding"),
        F.lit(1000).alias("page_width"), F.lit(1400).alias("page_height"),
    )
    staves = lines.where("l_linestatus = 'O'").select(
        *key, F.col("l_quantity").cast("int").alias("left"), (F.col("l_quantity") * 10).cast("int").alias("right"),
        (F.col("l_suppkey") + 0.5).alias("top"), (F.col("l_suppkey") + F.col("l_quantity") + 0.5).alias("bottom"),
    )
    glyphs = lines.where("l_returnflag = 'R'").select(
        *key, (F.col("l_partkey") % 700).cast("string").alias("x"), F.when(F.col("l_linenumber") != 3, (F.col("l_suppkey") % 1300).cast("string")).otherwise("?").alias("y"),
        F.col("l_quantity").cast("int").cast("string").alias("w"), F.col("l_linenumber").cast("string").alias("h"),
    )
    return layout.system_bounds(systems, staves, glyphs, key)


def system_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir).select("l_orderkey", "bounds.*")


def crop_rects(spark, sf_dir):
    return _bounds(spark, sf_dir).select("l_orderkey", crop_rect(F.col("bounds"), F.col("page_width"), F.col("page_height")).alias("r")).select("l_orderkey", "r.*")


_BOUNDS = """b AS (
  SELECT o_orderkey AS l_orderkey, CAST(round_even(CASE WHEN o_orderkey % 7 = 0 THEN 20.0 ELSE o_orderkey % 23 END * 4.5, 0) AS INT) AS pad FROM orders
), st AS (
  SELECT l_orderkey, CAST(min(CAST(l_quantity AS INT)) AS INT) AS lx, CAST(max(l_quantity * 10) AS INT) AS rx,
         CAST(round_even(min(l_suppkey + 0.5), 0) AS INT) AS ty, CAST(round_even(max(l_suppkey + l_quantity + 0.5), 0) AS INT) AS by_
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1
), g AS (
  SELECT l_orderkey, CAST(min(l_partkey % 700) AS INT) AS gx, CAST(min(l_suppkey % 1300) AS INT) AS gy,
         CAST(max(l_partkey % 700 + CAST(l_quantity AS INT)) AS INT) AS gr, CAST(max(l_suppkey % 1300 + l_linenumber) AS INT) AS gb
  FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 3 GROUP BY 1
), e AS (
  SELECT l_orderkey, least(coalesce(lx, 0), coalesce(gx, coalesce(lx, 0))) AS x0, greatest(0, coalesce(ty, 0) - pad) AS y0,
         coalesce(gy, greatest(0, coalesce(ty, 0) - pad)) AS gy, greatest(coalesce(rx, 0), coalesce(gr, 0)) AS x1,
         greatest(least(1399, coalesce(by_, 0) + pad), coalesce(gb, 0)) AS y1
  FROM b LEFT JOIN st USING (l_orderkey) LEFT JOIN g USING (l_orderkey)
), box AS (SELECT l_orderkey, x0 AS x, least(y0, gy) AS y, x1 - x0 AS width, y1 - least(y0, gy) AS height FROM e)"""
SYSTEM_BOUNDS = f"WITH {_BOUNDS} SELECT * FROM box"
CROPS = f"""WITH {_BOUNDS} SELECT l_orderkey, greatest(0, x - 20) AS "left", greatest(0, y - 20) AS top, least(1000, x + width + 20) AS "right", least(1400, y + height + 20) AS bottom FROM box"""


def _sheets(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("score_id"), F.col("o_orderkey").alias("sheet"), (F.col("o_orderkey") % 6).alias("declared"))


def sheet_offsets(spark, sf_dir):
    return layout.sheet_offsets(_sheets(spark, sf_dir), ["score_id"], ["sheet"])


OFFSETS = """SELECT o_custkey AS score_id, o_orderkey AS sheet, o_orderkey % 6 AS declared,
  CAST(coalesce(sum(o_orderkey % 6) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM orders"""


def global_ids(spark, sf_dir):
    offsets = sheet_offsets(spark, sf_dir)
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("sheet"), *ORDER)
    lines = lines.join(offsets.select("score_id", "sheet"), "sheet")
    return layout.measure_ids(lines, ["score_id"], ["sheet"], ORDER, offsets)


IDS = f"""WITH o AS ({OFFSETS}), m AS (SELECT l_orderkey AS sheet, {', '.join(ORDER)},
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS INT) AS local_id FROM lineitem)
SELECT m.*, score_id, "offset" + local_id AS global_id FROM m JOIN o USING (sheet)"""


def system_numbers(spark, sf_dir):
    return layout.system_ids(_sheets(spark, sf_dir).drop("declared"), ["score_id"], ["sheet"])


SYSTEM_NUMBERS = "SELECT o_custkey AS score_id, o_orderkey AS sheet, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS global_id FROM orders"


def measure_ranges(spark, sf_dir):
    return layout.measure_ranges(global_ids(spark, sf_dir), ["score_id", "sheet"])


RANGES = f"SELECT score_id, sheet, min(global_id) AS first, max(global_id) AS last FROM ({IDS}) GROUP BY ALL"


def order_warnings(spark, sf_dir):
    stacks = _lines(spark, sf_dir).select("l_orderkey", F.col("l_partkey").alias("stack_id"), F.col("l_suppkey").alias("left"), *ORDER)
    return layout.order_warnings(stacks, ["l_orderkey"], ORDER)


WARNINGS = f"""SELECT l_orderkey, count(*) FILTER (c) AS n_not_consecutive, count(*) FILTER (l) AS n_not_left_to_right FROM (
  SELECT l_orderkey, l_partkey <> lag(l_partkey) OVER w + 1 AS c, l_suppkey < lag(l_suppkey) OVER w AS l FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)})
) GROUP BY 1 HAVING count(*) FILTER (c) > 0 OR count(*) FILTER (l) > 0"""


def layout_reconcile(spark, sf_dir):
    """Suppliers are scores, orders pages; the book lacks a few lines and has others changed."""
    lines = _lines(spark, sf_dir).select("l_suppkey", "l_orderkey", *[c for c in ORDER if c != "l_suppkey"])
    rows = lambda change: lines.select(
        F.col("l_suppkey").alias("score_id"), (F.col("l_orderkey") % 50).alias("page"), "l_orderkey", *[c for c in ORDER if c != "l_suppkey"], change.alias("first"), (F.col("l_linenumber") + 1).alias("last")
    )
    pages = rows(F.col("l_linenumber")).where("l_orderkey % 13 <> 0")
    book = rows(F.col("l_linenumber") + (F.col("l_orderkey") % 17 == 0).cast("int")).where("l_orderkey % 13 <> 0 AND l_partkey % 29 <> 0 OR l_orderkey % 39 = 0")
    return reconcile.layouts(pages, book, ["score_id"], "page", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ["first", "last"])


RECONCILE = """WITH l AS (SELECT l_suppkey AS score_id, l_orderkey % 50 AS page, * FROM lineitem),
p AS (SELECT score_id, page, l_linenumber AS f, row_number() OVER w AS system, count(*) OVER (PARTITION BY score_id, page) AS n FROM l WHERE l_orderkey % 13 <> 0
      WINDOW w AS (PARTITION BY score_id, page ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
b AS (SELECT score_id, page, l_linenumber + CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END AS f, l_linenumber AS z, row_number() OVER w AS system, count(*) OVER (PARTITION BY score_id, page) AS n
      FROM l WHERE l_orderkey % 13 <> 0 AND l_partkey % 29 <> 0 OR l_orderkey % 39 = 0
      WINDOW w AS (PARTITION BY score_id, page ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
c AS (SELECT score_id, page, pn, bn FROM (SELECT DISTINCT score_id, page, n AS pn FROM p) FULL JOIN (SELECT DISTINCT score_id, page, n AS bn FROM b) USING (score_id, page))
SELECT score_id, page, CAST(NULL AS INT) AS system, CASE WHEN bn IS NULL THEN 'missing_in_book' WHEN pn IS NULL THEN 'missing_in_pages' ELSE 'system_count' END AS error
FROM c WHERE pn IS DISTINCT FROM bn
UNION ALL SELECT score_id, page, CAST(system AS INT), 'measure_range' FROM p JOIN b USING (score_id, page, system)
WHERE p.n = b.n AND (p.f, p.f + 1) <> (b.f, b.z + 1)"""


def raster_dpi_query(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", raster_dpi(F.col("p_size") * 20.0, F.col("p_retailprice")).alias("dpi"))


DPI = "SELECT p_partkey, CAST(floor(sqrt(20000000 * 0.85 / ((p_size * 20.0 / 72) * (p_retailprice / 72)))) AS BIGINT) AS dpi FROM part"


def top1_candidate(spark, sf_dir):
    """Lines are contours of an order's page; the best by area and distance, the first among equals."""
    lines = _lines(spark, sf_dir).select("l_orderkey", *ORDER, (F.col("l_quantity") * 10).alias("w"), (F.col("l_suppkey") % 50 * 10 + 100).alias("h"))
    page = [F.lit(700.0), F.lit(600.0)]
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    score = candidates.block_score(x, y, F.col("w"), F.col("h"), *page)
    return candidates.best(lines, ["l_orderkey"], score, ORDER, candidates.block_fit(F.col("w"), F.col("h"), *page))


TOP1 = f"""SELECT l_orderkey, {', '.join(ORDER)}, w, h FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
    w * h - ((x + w / 2.0 - 350) ** 2 + (y + h / 2.0 - 300) ** 2) * 0.5 DESC, {', '.join(ORDER)}) AS r
  FROM (SELECT *, l_quantity * 10 AS w, l_suppkey % 50 * 10 + 100 AS h, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem)
  WHERE w * h / (700.0 * 600.0) BETWEEN 0.1 AND 0.95 AND w / h BETWEEN 0.3 AND 3.0) WHERE r = 1"""


def first_composer(spark, sf_dir):
    """The first urgent order of each customer, and the last."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    first = candidates.first_match(o, ["o_custkey"], ["o_orderkey"], "o_totalprice", urgent)
    last = candidates.last_match(o, ["o_custkey"], ["o_orderkey"], "o_totalprice", urgent).withColumnRenamed("o_totalprice", "last_price")
    return first.join(last, "o_custkey")


FIRST = """SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS o_totalprice,
  arg_max(o_totalprice, o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS last_price FROM orders GROUP BY 1"""

QUERIES = {
    "system_bounds": (system_bounds, SYSTEM_BOUNDS),
    "crop_rects": (crop_rects, CROPS),
    "sheet_offsets": (sheet_offsets, OFFSETS),
    "global_ids": (global_ids, IDS),
    "system_numbers": (system_numbers, SYSTEM_NUMBERS),
    "measure_ranges": (measure_ranges, RANGES),
    "order_warnings": (order_warnings, WARNINGS),
    "layout_reconcile": (layout_reconcile, RECONCILE),
    "raster_dpi": (raster_dpi_query, DPI),
    "top1_candidate": (top1_candidate, TOP1),
    "first_match": (first_composer, FIRST),
}
