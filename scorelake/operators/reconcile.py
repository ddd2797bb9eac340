"""Reconciliation of two layouts of one score: page by page against the whole book."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def layouts(pages: DataFrame, book: DataFrame, score: list[str], page: str, order: list[str], value: list[str], listed: DataFrame | None = None) -> DataFrame:
    """``score page system error``: every disagreement, systems numbered from 1 in order.

    ``pages`` and ``book`` hold a row per system; ``listed`` may name pages of the
    book (``from_book`` true) or of the page run without any system. Errors:
    ``missing_in_book``, ``system_count``, ``measure_range`` (of pages whose counts
    agree), ``missing_in_pages`` (only if the book has systems there).
    """
    key = [*score, page]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        at = Window.partitionBy(*key).orderBy(*order)
        return df.select(*key, F.row_number().over(at).alias("system"), F.struct(*value).alias(name))

    def counted(df: DataFrame, name: str, from_book: bool) -> DataFrame:
        rows = df.select(*key, F.lit(1).alias("_n"))
        if listed is not None:
            rows = rows.unionByName(listed.where(F.col("from_book") == from_book).select(*key, F.lit(0).alias("_n")))
        return rows.groupBy(*key).agg(F.sum("_n").alias(name))

    counts = counted(pages, "n_pages", False).join(counted(book, "n_book", True), key, "full_outer")
    by_page = counts.select(
        *key, F.lit(None).cast("int").alias("system"),
        F.when(F.col("n_book").isNull(), "missing_in_book")
        .when(F.col("n_pages").isNull(), F.when(F.col("n_book") > 0, "missing_in_pages"))
        .when(F.col("n_pages") != F.col("n_book"), "system_count")
        .alias("error"),
    ).where(F.col("error").isNotNull())
    equal = counts.where(F.col("n_pages") == F.col("n_book")).select(*key)
    both = numbered(pages, "_p").join(numbered(book, "_b"), [*key, "system"]).join(equal, key, "left_semi")
    by_system = both.where(~F.col("_p").eqNullSafe(F.col("_b"))).select(*key, "system", F.lit("measure_range").alias("error"))
    return by_page.unionByName(by_system)
