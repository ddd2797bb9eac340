"""Names, paths, header blocks and versions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header fields in their order, and the names they have in an engraving header.
HEADER_FIELDS = {
    "title": "title",
    "subtitle": "subtitle",
    "composer": "composer",
    "work_number": "opus",
    "copyright": "copyright",
    "tagline": "tagline",
}
DOCTYPE = r"<!DOCTYPE[^>]+>"


def escaped(text: Column) -> Column:
    """A quoted string's content: backslashes first, then quotes."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def header_block(fields: dict[str, Column]) -> Column:
    """The header block; empty or null fields are left out, an empty tagline is switched off."""
    lines = [F.lit("\\header {")]
    for field, name in HEADER_FIELDS.items():
        text = F.coalesce(fields.get(field, F.lit(None)).cast("string"), F.lit(""))
        full = F.concat(F.lit(f'  {name} = "'), escaped(text), F.lit('"'))
        lines.append(F.when(text != "", full).otherwise(F.lit("  tagline = ##f") if field == "tagline" else F.lit(None)))
    return F.array_join(F.array(*lines, F.lit("}")), "\n")


def preferred(given: Column, extracted: Column) -> Column:
    """``STRUCT<text, confirmed>``: '-' clears, a given text wins, otherwise what was extracted."""
    given, extracted = (F.coalesce(x, F.lit("")) for x in (given, extracted))
    return F.struct(
        F.when(given == "-", "").when(given != "", given).otherwise(extracted).alias("text"),
        (given != "").alias("confirmed"),
    )


def answered(given: Column, extracted: Column, answer: Column) -> Column:
    """As :func:`preferred`, where what wasn't given was asked: '-' clears, empty keeps what was extracted."""
    asked = F.trim(F.coalesce(answer, F.lit("")))
    open_ = F.coalesce(given, F.lit("")) == ""
    return F.struct(
        F.when(~open_, preferred(given, extracted)["text"]).when(asked == "-", "").when(asked != "", asked)
        .otherwise(F.coalesce(extracted, F.lit(""))).alias("text"),
        F.lit(True).alias("confirmed"),
    )


def doctype(xml: Column) -> Column:
    """The first document type declaration, or null."""
    return F.nullif(F.regexp_extract(xml, DOCTYPE, 0), F.lit(""))


def without_doctype(xml: Column) -> Column:
    """For ``xpath``, which would fetch what a declaration names."""
    return F.regexp_replace(xml, DOCTYPE, "")


def numbered(stem: str, number: Column, suffix: str) -> Column:
    """``stem_0042suffix``: names that sort as their numbers do."""
    return F.format_string(f"{stem}_%04d{suffix}", number.cast("long"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """A path's last name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def trailing_number(path: Column) -> Column:
    """What follows the last underscore of the stem, as a number; null if it is none."""
    return F.element_at(F.split(stem(path), "_"), -1).try_cast("int")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit(""))


def artifact_kind(path: Column) -> Column:
    """What a recognised file is by its place: ``book``, ``page``, ``system`` or ``other``."""
    return (
        F.when(file_name(path) == "book.omr", "book")
        .when(parent_name(path) == "pages", "page")
        .when(parent_name(path) == "systems", "system")
        .otherwise("other")
    )


def relative_to(path: Column, base: Column) -> Column:
    """``path`` as seen from the folder ``base``, walking up where needed (both absolute, normal)."""
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    a, b = parts(path), parts(base)
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))),
            lambda i: (F.least(F.size(a), F.size(b)) >= i) & (F.slice(a, 1, i) == F.slice(b, 1, i)),
        )
    )
    up = F.array_repeat(F.lit(".."), F.size(b) - shared)
    steps = F.concat(up, F.slice(a, shared + 1, F.greatest(F.lit(1), F.size(a))))
    return F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))


def version_warning(version: Column, tested: int) -> Column:
    """Null for the tested major version, otherwise ``unknown`` (none), ``unreadable`` or ``other``."""
    major = F.split_part(version, F.lit("."), F.lit(1)).try_cast("int")
    return (
        F.when(version.isNull(), "unknown").when(major.isNull(), "unreadable").when(major != tested, "other")
    )


def page_range(text: Column) -> Column:
    """``STRUCT<first, last, error>`` of 'S-E', 1-based and inclusive; ``error`` is null if it holds."""
    first, last = (F.get(F.split(text, "-", 2), F.lit(i)).try_cast("int") for i in (0, 1))
    error = (
        F.when(text.isNull() | ~text.contains("-"), "form")
        .when(first.isNull() | last.isNull(), "number")
        .when(first < 1, "start")
        .when(last < first, "end")
    )
    return F.struct(
        F.when(error.isNull(), first).alias("first"), F.when(error.isNull(), last).alias("last"), error.alias("error")
    )


def fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))
