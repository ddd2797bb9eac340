"""Selection of single rows: best by score, first and last match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, group: list[str], score: Column, order: list[str], at_least: Column | None = None) -> DataFrame:
    """The row of the highest score in each group, the first in order among equals.

    ``at_least``: rows that don't fulfil it are no candidates; a group without any is absent.
    """
    fit = rows if at_least is None else rows.where(at_least)
    place = Window.partitionBy(*group).orderBy(F.desc("_score"), *order)
    return fit.withColumn("_score", score).withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place", "_score")


def component_fit(area: Column, page_area: Column, x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A sheet candidate: 5 % of the page at least and not touching all four borders."""
    touches_all = (x == 0) & (y == 0) & (x + w >= page_w) & (y + h >= page_h)
    return (area >= page_area * 0.05) & ~touches_all


def block_fit(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A music block candidate: 10 to 95 % of the page, neither too flat nor too tall."""
    share, aspect = (w * h) / (page_w * page_h), w / h
    return share.between(0.1, 0.95) & aspect.between(0.3, 3.0)


def block_score(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Area less half the squared distance of the centres."""
    dx, dy = (x + w / 2.0) - page_w / 2.0, (y + h / 2.0) - page_h / 2.0
    return w * h - (dx * dx + dy * dy) * 0.5


def first_match(rows: DataFrame, group: list[str], order: list[str], value: str, where: Column) -> DataFrame:
    """``group value``: the first value in order that matches (null where none does)."""
    return rows.groupBy(*group).agg(F.min_by(F.when(where, F.col(value)), F.when(where, F.struct(*order))).alias(value))


def last_match(rows: DataFrame, group: list[str], order: list[str], value: str, where: Column) -> DataFrame:
    return rows.groupBy(*group).agg(F.max_by(F.when(where, F.col(value)), F.when(where, F.struct(*order))).alias(value))
