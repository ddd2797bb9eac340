"""Score information: extraction, precedence, merging, header blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import HEADER_FIELDS, answered, header_block, preferred, without_doctype

#: Where a score document has its fields. Subtitle and tagline are never extracted.
PLACES = {
    "title": "/score-partwise/movement-title/text()",
    "work_number": "/score-partwise/work/work-number/text()",
    "composer": '(/score-partwise/identification/creator[@type="composer"])[1]/text()',
    "copyright": "/score-partwise/identification/rights/text()",
}
#: Parts fields that are read together; no document can hold it.
PART = "\uffff"


def extract(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """``documents`` with ``info``: a struct of the six fields, trimmed, empty where a document has none."""
    # a document is parsed for each path, so all fields are one
    path = f"concat({f", '{PART}', ".join(PLACES.values())})"
    found = F.split(F.xpath_string(without_doctype(F.col(xml)), F.lit(path)), PART)
    read = lambda f: F.coalesce(F.trim(F.get("_found", F.lit(list(PLACES).index(f)))), F.lit(""))
    info = F.struct(*((read(f) if f in PLACES else F.lit("")).alias(f) for f in HEADER_FIELDS))
    return documents.withColumn("_found", found).withColumn("info", info).drop("_found")


def merge(rows: DataFrame, given: str = "given", extracted: str = "info", answers: str | None = None) -> DataFrame:
    """``rows`` with ``merged``: a struct of ``text confirmed`` for each field, from what was given and extracted.

    ``answers`` (a struct of strings) stands for what an interactive user said about fields not given.
    """
    def field(f: str):
        a, b = F.col(f"{given}.{f}"), F.col(f"{extracted}.{f}")
        return preferred(a, b) if answers is None else answered(a, b, F.col(f"{answers}.{f}"))

    return rows.withColumn("merged", F.struct(*(field(f).alias(f) for f in HEADER_FIELDS)))


def with_block(rows: DataFrame, merged: str = "merged") -> DataFrame:
    return rows.withColumn("header", header_block({f: F.col(f"{merged}.{f}.text") for f in HEADER_FIELDS}))
