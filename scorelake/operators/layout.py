"""Page layouts: identifiers, offsets, bounds and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.geometry import box


def sheet_offsets(sheets: DataFrame, score: list[str], order: list[str], declared: str = "declared") -> DataFrame:
    """``sheets`` with ``offset``: the declared numbers of measures of the sheets before, which may differ from those found."""
    before = Window.partitionBy(*score).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sheets.withColumn("offset", F.coalesce(F.sum(F.coalesce(F.col(declared), F.lit(0))).over(before), F.lit(0)))


def measure_ids(measures: DataFrame, score: list[str], sheet: list[str], order: list[str], offsets: DataFrame) -> DataFrame:
    """``measures`` with ``local_id``, counted within a sheet in reading order, and ``global_id``, from the sheet's offset on."""
    in_sheet = Window.partitionBy(*score, *sheet).orderBy(*order)
    numbered = measures.withColumn("local_id", F.row_number().over(in_sheet))
    return numbered.join(offsets.select(*score, *sheet, "offset"), [*score, *sheet]).withColumn(
        "global_id", F.col("offset") + F.col("local_id")
    ).drop("offset")


def system_ids(systems: DataFrame, score: list[str], order: list[str]) -> DataFrame:
    """``systems`` with ``global_id`` from 1, over the pages of a score in order."""
    return systems.withColumn("global_id", F.row_number().over(Window.partitionBy(*score).orderBy(*order)))


def order_warnings(stacks: DataFrame, system: list[str], order: list[str], stack_id: str = "stack_id", left: str = "left") -> DataFrame:
    """``system n_not_consecutive n_not_left_to_right``, for systems with any."""
    before = Window.partitionBy(*system).orderBy(*order)
    seen = stacks.select(
        *system,
        (F.col(stack_id) != F.lag(stack_id).over(before) + 1).alias("_c"),
        (F.col(left) < F.lag(left).over(before)).alias("_l"),
    )
    told = seen.groupBy(*system).agg(F.count_if("_c").alias("n_not_consecutive"), F.count_if("_l").alias("n_not_left_to_right"))
    return told.where("n_not_consecutive > 0 OR n_not_left_to_right > 0")


def staff_extent(staves: DataFrame, system: list[str]) -> DataFrame:
    """``system left top right bottom`` over the staves of each system's first part.

    ``staves``: ``left right top bottom``, top and bottom being the first points of
    the outermost lines (null without lines). What no staff has is 0.
    """
    return staves.groupBy(*system).agg(
        F.coalesce(F.min("left"), F.lit(0)).cast("int").alias("left"),
        F.coalesce(F.bround(F.min("top")), F.lit(0)).cast("int").alias("top"),
        F.coalesce(F.max("right"), F.lit(0)).cast("int").alias("right"),
        F.coalesce(F.bround(F.max("bottom")), F.lit(0)).cast("int").alias("bottom"),
    )


def glyph_extent(glyphs: DataFrame, system: list[str]) -> DataFrame:
    """``system gx gy gr gb`` over the symbols whose four numbers can be read; others are left out."""
    read = glyphs.select(*system, *(F.col(c).try_cast("int").alias(c) for c in ("x", "y", "w", "h"))).dropna(subset=["x", "y", "w", "h"])
    return read.groupBy(*system).agg(
        F.min("x").alias("gx"), F.min("y").alias("gy"), F.max(F.col("x") + F.col("w")).alias("gr"), F.max(F.col("y") + F.col("h")).alias("gb")
    )


def system_bounds(
    systems: DataFrame, staves: DataFrame, glyphs: DataFrame, system: list[str], padding: str = "padding", page_height: str = "page_height"
) -> DataFrame:
    """``systems`` with ``bounds``: padded staves, kept inside the page, and all symbols around them (as they are)."""
    rows = systems.join(staff_extent(staves, system), system, "left").join(glyph_extent(glyphs, system), system, "left")
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    # least and greatest pass over nulls: without symbols the staves alone count
    x = F.least(at("left"), F.col("gx"))
    y = F.least(F.greatest(F.lit(0), at("top") - F.col(padding)), F.col("gy"))
    right = F.greatest(at("right"), F.col("gr"))
    bottom = F.greatest(F.least(F.col(page_height) - 1, at("bottom") + F.col(padding)), F.col("gb"))
    return rows.select(*(f"`{c}`" for c in systems.columns), box(x, y, right - x, bottom - y).alias("bounds"))


def measure_ranges(measures: DataFrame, system: list[str]) -> DataFrame:
    """``system first last``: the range of global ids of each system."""
    return measures.groupBy(*system).agg(F.min("global_id").alias("first"), F.max("global_id").alias("last"))


def nested(sheets: DataFrame, systems: DataFrame, measures: DataFrame, score: list[str]) -> DataFrame:
    """One row per score: ``sheets`` as an array of systems as arrays of measures, each in order.

    ``measures``: score, sheet, system_id, local_id, global_id, bounds; ``systems``: score,
    sheet, system_id, local_id, global_id, bounds; ``sheets``: score, sheet, width, height.
    """
    inner = measures.groupBy(*score, "sheet", "system_id").agg(
        F.array_sort(F.collect_list(F.struct("local_id", "global_id", "bounds"))).alias("measures")
    )
    of_sheet = systems.join(inner, [*score, "sheet", "system_id"], "left")
    many = F.col("measures")
    of_sheet = of_sheet.groupBy(*score, "sheet").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "global_id", "local_id", "bounds",
                    F.array(F.get(many, F.lit(0))["global_id"], F.element_at(many, -1)["global_id"]).alias("measure_range"),
                    "measures",
                )
            )
        ).alias("systems")
    )
    whole = sheets.join(of_sheet, [*score, "sheet"], "left")
    return whole.groupBy(*score).agg(F.array_sort(F.collect_list(F.struct("sheet", "width", "height", "systems"))).alias("sheets"))


def page_files(paths: DataFrame, score: list[str], path: str = "path") -> DataFrame:
    """``paths`` with ``sheet``: page images in the order of their names stand for sheets 1, 2 and so on."""
    return paths.withColumn("sheet", F.row_number().over(Window.partitionBy(*score).orderBy(path)))
