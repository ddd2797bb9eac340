"""The corpus pipeline over ``documents``: each stage is written as Parquet and read by the next.

Stages, in order: toxic documents go; cross-site boilerplate lines go; one
document of each group of near duplicates stays; benchmark passages are cut out
(a document of nothing else goes); what is left is mixed to source weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from scorelake.llm.common import columns_of, fresh, keep
from scorelake.llm.labelled import remainder


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, for the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    allowed = remainder("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT
    (name,) = fresh(docs, "_toxicity")
    scored = toxicity.score(docs, labels, "toxic", allowed, name=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    aside = dict(zip(counts, fresh(docs, *counts), strict=True))  # the operator's own columns take these names
    done = line_dedup.clean(docs.withColumnsRenamed(aside), by_texts=True).drop("n_lines", "n_removed")
    return _measured(done.withColumnsRenamed({new: old for old, new in aside.items()}).select(*columns_of(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_words, spans, items = names = fresh(docs, *decontaminate.NAMES)
    found = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove=True, names=tuple(names))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    left = found.where((F.size(spans) == 0) | (hit < F.col(n_words)))
    return _measured(left.select(*columns_of(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", cut_benchmark),
    ("mix_sources", mix_sources),
]
#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
