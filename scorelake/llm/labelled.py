"""Bounded, seeded samples of labelled documents, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import Shared, keep, text_of, tidy


def remainder(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, allowed: Column | None = None,
    doc_id: str = "doc_id", text: str = "text", seed: int = 29,
) -> DataFrame:
    """``y weight luck text``: at most ``most`` labelled documents of each class (kept).

    The least seeded hashes of the ids are taken, so reruns agree. A document
    with several labels counts once, by their mean (0.5 and up is 1), and one with
    several rows by one of them: the text of the least hash. weight: the class's
    labelled documents for each one taken.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    known = known.withColumn("luck", F.xxhash64(F.lit(seed), F.col("_id").cast("string")))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = None
    for y, n in sorted(sizes.items()):
        part = known.where(F.col("y") == y).orderBy("luck", "_id").limit(most)
        part = part.withColumn("weight", F.lit(n / min(n, most)))
        taken = part if taken is None else taken.unionByName(part)
    if taken is None:
        taken = known.withColumn("weight", F.lit(1.0))
    # 2 * most ids at most: a proven bound for the broadcast
    rows = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("text")).join(F.broadcast(taken), "_id")
    # partial aggregation leaves one row of an id in each task, so repeats of one id don't gather in one
    one = rows.groupBy("_id", "y", "weight", "luck").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return keep(one.select("y", "weight", "luck", "text"))


def scored(
    docs: DataFrame, model, score: Callable, cache: Callable, text: str = "text", name: str = "score",
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (default: all) and ``score(texts, model, cache)``, from Arrow batches; one of that name is replaced.

    ``model`` travels as a broadcast; its size is bounded by its own parameters.
    ``cache(model)`` makes what a task keeps between its batches.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != name.lower()]
    held = Shared(docs.sparkSession, model)
    place, columns = docs.columns.index(text), [docs.columns.index(c) for c in carry]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(name, T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]):
        loaded = held.load()
        own = cache(loaded)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                texts = [x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()]
                value = pa.array(np.asarray(score(texts, loaded, own), np.float64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), value], names=schema.names)

    return docs.mapInArrow(tidy(task), schema)
