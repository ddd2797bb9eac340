"""Sizes, paddings and boxes of pages. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes that results depend on.
POINTS_PER_INCH = 72
#: A page image has this many pixels at most: a margin under the recogniser's limit.
MOST_PIXELS = 20_000_000 * 0.85
#: Padding of a system, in spaces between staff lines; the space where none is known.
PADDING_SPACES, DEFAULT_SPACE = 4.5, 20.0
CROP_PADDING = 0.02


def raster_dpi(width_pts: Column, height_pts: Column) -> Column:
    """Highest whole resolution that keeps a page under ``MOST_PIXELS``; null for pages without area."""
    area = (width_pts / POINTS_PER_INCH) * (height_pts / POINTS_PER_INCH)
    return F.when(area > 0, F.floor(F.sqrt(F.lit(MOST_PIXELS) / area)).cast("long"))


def padding(interline: Column) -> Column:
    """Pixels around a system, from the space between staff lines (any type; unreadable: the default)."""
    space = F.coalesce(interline.try_cast("double"), F.lit(DEFAULT_SPACE))
    return F.bround(space * PADDING_SPACES).cast("int")


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def measure_box(left: Column, right: Column, system: Column) -> Column:
    """A measure stands between its bar lines and is as high as its system."""
    return box(left, system["y"], right - left, system["height"])


def crop_rect(bounds: Column, page_width: Column, page_height: Column) -> Column:
    """``STRUCT<left, top, right, bottom>``: the box and 2 % of the page's width around it, inside the page."""
    pad = F.bround(page_width * CROP_PADDING).cast("int")
    return F.struct(
        F.greatest(F.lit(0), bounds["x"] - pad).alias("left"),
        F.greatest(F.lit(0), bounds["y"] - pad).alias("top"),
        F.least(page_width, bounds["x"] + bounds["width"] + pad).alias("right"),
        F.least(page_height, bounds["y"] + bounds["height"] + pad).alias("bottom"),
    )
