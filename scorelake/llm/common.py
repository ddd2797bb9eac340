"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources.tables import materialize

#: Bytes of rows that go to a Python worker at a time while a result is kept.
BATCH_BYTES = 4 << 20
#: White space of the word patterns: space, and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    Cuts the lineage: later stages don't run what came before once more, and a
    lost executor takes nothing of it along. Rows with long texts or arrays reach
    Python in batches bounded by bytes, not by their number.
    """
    return materialize(df, BATCH_BYTES)


def tidy(task):
    """``task``, after which its worker gives unused memory back: workers outlive their tasks, and other stages need it."""

    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


class Shared:
    """A value that tasks read, broadcast as bytes with its classes, so that workers need no path to this package."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        """The value: once a task."""
        return cloudpickle.loads(self._bytes.value)

    def unpersist(self):
        self._bytes.unpersist()


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def row_key(doc_id: str, text: str) -> list[Column]:
    """Columns that tell rows apart by what they hold, equal on every run.

    Rows that repeat an id with another text stay apart; exact repeats of a row
    share the key, and every decision about them is the same.
    """
    return [
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.col(doc_id).cast("string"), text_of(text)).alias("_key"),
    ]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["_key"] == b["_key"]) & a["_id"].eqNullSafe(b["_id"])


def sized_broadcast(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` (narrow) rows; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= most else df
