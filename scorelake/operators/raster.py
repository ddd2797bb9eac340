"""Page images by aggregation: histograms, thresholds, projections, boxes, gaps, tone curves.

Pixels come as rows ``page y x v`` (small or test images), or, as page images do,
already counted: ``histogram`` (page, v, n) and ``profile`` (page, axis, i, ink)
tables, which :mod:`scorelake.operators.images` takes from binary rasters without
making a row of each pixel. What follows from counts is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, page: list[str], value: str = "v") -> DataFrame:
    return pixels.groupBy(*page, F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, page: list[str]) -> DataFrame:
    """``page threshold``: the value that parts dark from light with the greatest between-class variance.

    Values above the threshold are light. Ties go to the least value; a page of
    one value has threshold 0. Counts are integers throughout, so only the final
    quotient is rounded.
    """
    upto = Window.partitionBy(*page).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*page)
    n, s = F.col("n").cast("double"), F.col("n").cast("double") * F.col("v")
    sums = hist.select(
        *page, "v", F.sum(n).over(upto).alias("w0"), F.sum(s).over(upto).alias("s0"), F.sum(n).over(whole).alias("w"), F.sum(s).over(whole).alias("s")
    )
    w1 = F.col("w") - F.col("w0")
    lead = F.col("s") * F.col("w0") - F.col("s0") * F.col("w")
    between = lead * lead / (F.col("w0") * w1)
    return sums.groupBy(*page).agg(
        F.coalesce(F.max_by("v", F.when(w1 > 0, F.struct(between.alias("b"), (-F.col("v")).alias("v")))), F.lit(0)).alias("threshold")
    )


def ink_statistics(hist: DataFrame, page: list[str], k: float = 1.5) -> DataFrame:
    """``page mean std ink_threshold`` over what isn't white; a white page has nulls (it is left as it is)."""
    v = F.when(F.col("v") < 255, F.col("v").cast("double"))
    n = F.when(F.col("v") < 255, F.col("n"))
    total, s, q = F.sum(n), F.sum(n * v), F.sum(n * v * v)
    mean = s / F.nullif(total, F.lit(0))
    var = F.greatest(F.lit(0.0), (q - s * s / F.nullif(total, F.lit(0))) / F.nullif(total, F.lit(0)))
    got = hist.groupBy(*page).agg(mean.alias("mean"), F.when(total > 0, F.sqrt(var)).alias("std"))
    cut = F.col("mean") - F.col("std") * k
    return got.withColumn("ink_threshold", F.when(cut >= 0, F.floor(cut)).otherwise(F.ceil(cut)).cast("int"))


def projections(ink: DataFrame, page: list[str]) -> DataFrame:
    """``page axis i ink`` of rows ``page y x`` that are ink: how much stands in each row (``y``) and column (``x``)."""
    both = ink.select(*page, F.explode(F.array(F.struct(F.lit("y").alias("axis"), F.col("y").alias("i")), F.struct(F.lit("x").alias("axis"), F.col("x").alias("i")))).alias("a"))
    return both.groupBy(*page, F.col("a.axis").alias("axis"), F.col("a.i").alias("i")).agg(F.count(F.lit(1)).alias("ink"))


def ink_box(profile: DataFrame, page: list[str], least: int | Column = 1) -> DataFrame:
    """``page x0 y0 x1 y1`` (inclusive) of the rows and columns with ``least`` ink or more."""
    at = lambda axis: F.when((F.col("axis") == axis) & (F.col("ink") >= least), F.col("i"))
    return profile.groupBy(*page).agg(
        F.min(at("x")).alias("x0"), F.min(at("y")).alias("y0"), F.max(at("x")).alias("x1"), F.max(at("y")).alias("y1")
    )


def tight_crop(boxes: DataFrame, width: Column, height: Column, share: float = 0.01) -> DataFrame:
    """``boxes`` with ``left top right bottom`` (ends exclusive): the box, a margin and the page's limits; null box: the page."""
    margin = F.floor(F.greatest(width, height) * share)
    lim = lambda a, b: F.coalesce(a, b).cast("int")
    return boxes.withColumns(
        {
            "left": lim(F.when(F.col("x0").isNotNull(), F.greatest(F.lit(0), F.col("x0") - margin)), F.lit(0)),
            "top": lim(F.when(F.col("y0").isNotNull(), F.greatest(F.lit(0), F.col("y0") - margin)), F.lit(0)),
            "right": lim(F.when(F.col("x1").isNotNull(), F.least(width, F.col("x1") + 1 + margin)), width),
            "bottom": lim(F.when(F.col("y1").isNotNull(), F.least(height, F.col("y1") + 1 + margin)), height),
        }
    )


def gap_inward(profile: DataFrame, keys: list[str], start: str, stop: str, least: str, i: str = "i", ink: str = "ink") -> DataFrame:
    """``keys inner``: where content resumes after the first gap, going from ``start`` towards ``stop``.

    ``stop`` itself isn't looked at, nor the first 5 % of the way. Where no gap or
    nothing behind one is found, ``start``. ``profile`` has a row for each index and
    the three limits in its rows; a start after the stop goes backward.
    """
    ahead = F.col(stop) >= F.col(start)
    step = F.when(ahead, F.col(i) - F.col(start)).otherwise(F.col(start) - F.col(i))
    way = F.abs(F.col(stop) - F.col(start))
    skip = F.greatest(F.floor(way * 0.05), F.lit(1)) - 1  # steps before the first that is looked at
    rows = profile.select(*keys, F.col(start).alias("_start"), step.alias("_step"), F.col(i).alias("_i"), (F.col(ink) < F.col(least)).alias("_gap"), ((step >= skip) & (step < way)).alias("_on"))
    far = Window.partitionBy(*keys)
    rows = rows.withColumn("_first", F.min(F.when(F.col("_on") & F.col("_gap"), F.col("_step"))).over(far))
    back = F.col("_on") & ~F.col("_gap") & (F.col("_step") > F.col("_first"))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.min_by("_i", F.when(back, F.col("_step"))), F.first("_start", ignorenulls=True)).alias("inner")
    )


def least_ink(width: Column, height: Column) -> Column:
    """Ink from which a row or column counts as content."""
    return F.greatest(F.lit(10), F.floor(F.least(width, height) / 50)).cast("int")


def block_by_projection(profile: DataFrame, pages: DataFrame, page: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """``pages`` with ``x0 y0 x1 y1`` (inclusive): the music block inside its border, with a small margin.

    The outer box has the rows and columns with enough ink; from each of its sides
    a border goes if a gap lies behind it. Pages without content have their full size.
    """
    sized = pages.withColumn("_least", least_ink(F.col(width), F.col(height)))
    rows = profile.join(sized.select(*page, "_least"), page)
    outer = ink_box(rows, page, F.col("_least"))
    side = lambda axis, at, a, b: F.struct(F.lit(axis).alias("axis"), F.lit(at).alias("side"), F.col(a).alias("start"), F.col(b).alias("stop"))
    sides = outer.select(*page, F.explode(F.array(side("x", "x0", "x0", "x1"), side("x", "x1", "x1", "x0"), side("y", "y0", "y0", "y1"), side("y", "y1", "y1", "y0"))).alias("s")).select(*page, "s.*")
    # rows and columns without ink are part of a profile too
    dense = sized.select(*page, "_least", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col(width).alias("n")), F.struct(F.lit("y").alias("axis"), F.col(height).alias("n")))).alias("a"))
    dense = dense.select(*page, "_least", "a.axis", F.explode(F.sequence(F.lit(0), F.col("a.n") - 1)).alias("i"))
    dense = dense.join(profile, [*page, "axis", "i"], "left").fillna({"ink": 0})
    inner = gap_inward(dense.join(sides, [*page, "axis"]), [*page, "side"], "start", "stop", "_least")
    inner = inner.groupBy(*page).agg(*(F.max(F.when(F.col("side") == s, F.col("inner"))).alias(f"_{s}") for s in ("x0", "y0", "x1", "y1")))
    m = F.floor(F.greatest(width, height) * 0.005)
    found = sized.join(inner, page, "left")
    empty = F.col("_x0").isNull() | F.col("_y0").isNull()
    low = lambda c: F.when(empty, 0).otherwise(F.greatest(F.lit(0), F.col(c) - m)).cast("int")
    high = lambda c, n: F.when(empty, F.col(n) - 1).otherwise(F.least(F.col(n) - 1, F.col(c) + m)).cast("int")
    return found.select(
        *(f"`{c}`" for c in pages.columns), low("_x0").alias("x0"), low("_y0").alias("y0"), high("_x1", width).alias("x1"), high("_y1", height).alias("y1")
    )


def truncated(v: Column, limit: int = 200) -> Column:
    """Light values become white."""
    return F.when(v >= limit, 255).otherwise(v).cast("int")


def gamma(v: Column, g: float = 2.0) -> Column:
    return F.floor(F.pow(v / 255.0, F.lit(1.0 / g)) * 255).cast("int")


def median_skew(lines: DataFrame, page: list[str], least: int = 5, most: float = 5.0) -> DataFrame:
    """``page n angle``: the median angle of near-horizontal lines ``x1 y1 x2 y2`` in degrees, null with too few."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))
    near = lines.where(dx != 0).withColumn("_a", angle)
    near = near.withColumn("_a", F.when((F.col("_a") > -most) & (F.col("_a") < most), F.col("_a")))
    return near.groupBy(*page).agg(F.count("_a").alias("n"), F.when(F.count("_a") >= least, F.median("_a")).alias("angle"))
