"""Bundles of a score's files: which source counts, what a given source undoes, the log, and the catalogue as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import file_name

#: The catalogue of a bundle; what is null is left out of its JSON.
CATALOGUE = (
    "command array<string>, working_directory string, input struct<absolute: string, relative: string, page_range: array<int>>, "
    "history array<struct<event: string, timestamp: string>>, "
    "stages map<string, struct<description: string, outputs: array<string>, source_checksums: map<string, string>>>"
)


def source_problem(path: Column, exists: Column, suffixes: list[str]) -> Column:
    """``missing`` or ``format`` for a source that can't be read, else null. Suffixes count in either case; a hidden file has none."""
    suffix = F.lower(F.regexp_extract(file_name(path), r"(?<=.)\.[^.]+$", 0))
    return F.when(~F.coalesce(exists, F.lit(False)), "missing").when(~suffix.isin(suffixes), "format")


def chosen_sources(exported: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """``keys path is_given``: the file given for a bundle, where there is none the exported one. Both inputs: keys, path, one row a bundle."""
    both = exported.select(*keys, F.col("path").alias("_own")).join(given.select(*keys, F.col("path").alias("_given")), keys, "full_outer")
    return both.select(*keys, F.coalesce("_given", "_own").alias("path"), F.col("_given").isNotNull().alias("is_given"))


def picks(outputs: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    """``keys least first``: a stage's outputs by the two rules that later stages go by, least path and first recorded."""
    return outputs.groupBy(*keys).agg(F.min("path").alias("least"), F.min_by("path", F.struct(ord, "path")).alias("first"))


def after_forcing(artifacts: DataFrame, recorded: DataFrame, given: DataFrame, keys: list[str], stage: str = "musicxml") -> DataFrame:
    """``artifacts`` without the recorded outputs of ``stage`` in the bundles of ``given``, so that the stage runs again.

    ``recorded``: keys, stage, outputs. Paths that no longer exist do no harm.
    """
    undone = recorded.where(F.col("stage") == stage).join(given.select(*keys).distinct(), keys, "left_semi")
    return artifacts.join(undone.select(*keys, F.explode("outputs").alias("path")).distinct(), [*keys, "path"], "left_anti")


def completed(stage: Column) -> Column:
    return F.concat(F.lit("stage-"), stage, F.lit("-completed"))


def appended(log: DataFrame, events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows ``keys seq event ts`` that ``events`` (keys, event, ts, the columns of ``order``) add to ``log``.

    Numbers go on from each bundle's last one, from 0 where it has none; the log
    itself isn't written again. Only its last number for each bundle is read.
    """
    last = log.groupBy(*keys).agg(F.max("seq").alias("_last"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = events.withColumn("_place", place).join(last, keys, "left")
    return numbered.select(*keys, (F.coalesce("_last", F.lit(-1)) + F.col("_place")).cast("long").alias("seq"), "event", "ts")


def to_json(bundles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys json`` of bundles that have the columns of ``CATALOGUE``."""
    return bundles.select(*keys, F.to_json(F.struct("command", "working_directory", "input", "history", "stages")).alias("json"))


def from_json(rows: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """``keys`` and the columns of ``CATALOGUE``; all are null where the text is no JSON."""
    return rows.select(*keys, F.from_json(json, CATALOGUE).alias("_read")).select(*keys, "_read.*")
