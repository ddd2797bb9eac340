"""Engraving text: preambles without headers, instrument names, merged files."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.sources.tables import materialize

#: Lines of a document that are scanned together.
BLOCK = 4096
# The line forms of the engraving format.
VERSION = r'^\\version\s+"([^"]+)"'
DEFINITION = r"^\w+ ="
COMMENT = r"^% automatically converted by musicxml2ly .+"
HEADER = r"\\header\b"
INSTRUMENT = r"(?m)^[ \t]*\\set\s+\w+\.instrumentName\s*=.*(?:\n|$)"
SHORT_INSTRUMENT = r"(?m)^[ \t]*\\set\s+\w+\.shortInstrumentName\s*=.*(?:\n|$)"


def lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: ``line_no`` from 0 and ``line``, without its break."""
    return documents.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).drop(text)


def braces(line: Column) -> Column:
    """Opening less closing braces."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return count("{") - count("}")


def block_function(net: list[int], header: list[bool]) -> tuple[list[int], list[int], int, int]:
    """What a block of lines does to a depth: ``floors ends total zero``.

    From depth 0 the block ends at ``zero``. From a depth d above it, the block ends at ``ends[i]``, i being the
    first with ``floors[i] >= d``: there the depth has come to 0 once, and what follows is the way of 0
    from there; where no floor is as high, the block ends at ``d + total``. Linear: a stack of
    least sums tells for each header where its braces are closed.
    """
    n, sums, s = len(net), [0], 0
    for x in net:
        s += x
        sums.append(s)
    after = [0] * (n + 1)  # the end from depth 0 before each line
    low, place = [], []  # sums after lines to come, rising towards the nearest, and the lines after these
    for i in range(n - 1, -1, -1):
        while low and low[-1] >= sums[i + 1]:
            low.pop()
            place.pop()
        low.append(sums[i + 1])
        place.append(i + 1)
        if header[i]:
            k = bisect_right(low, sums[i]) - 1
            after[i] = after[place[k]] if k >= 0 else sums[n] - sums[i]
        else:
            after[i] = after[i + 1]
    floors, ends, least = [], [], 0
    for i in range(n):
        if sums[i + 1] < least:
            least = sums[i + 1]
            floors.append(-least)
            ends.append(after[i + 1])
    return floors, ends, s, after[0]


def depth_after(depth: int, floors: list[int], ends: list[int], total: int, zero: int) -> int:
    """Where a block that begins at this depth ends."""
    if not depth:
        return zero
    i = bisect_left(floors, depth)
    return ends[i] if i < len(floors) else depth + total


def kept_lines(depth: int, net: list[int], header: list[bool]) -> list[bool]:
    """Which lines of a block that begins at this depth stand outside header blocks."""
    out = []
    for b, h in zip(net, header, strict=True):
        inside = h or depth > 0
        out.append(not inside)
        depth = max(0, depth + b) if inside else 0
    return out


def split_documents(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys preamble rest`` of each document.

    The rest starts with the first definition line. Of what stands before, comment
    lines of the converter and header blocks go. A block ends with the line that
    brings its brace depth to 0 or less; a header line that opens no brace goes alone.

    A scan in two passes over blocks of ``BLOCK`` lines: each block's effect on a depth, then, from the
    depths at which blocks begin, the lines of each. Work is linear, and a document of very many lines is many
    tasks' but for one step for each of its blocks. A null text is empty; ``keys`` tell documents apart.
    """
    each = lines(documents.select(*keys, F.coalesce(text, F.lit("")).alias("_text")), "_text")
    first = each.where(F.col("line").rlike(DEFINITION)).groupBy(*keys).agg(F.min("line_no").alias("_first"))
    each = each.join(first, keys, "left").withColumn("_rest", F.coalesce(F.col("line_no") >= F.col("_first"), F.lit(False)))
    each = each.withColumn("_block", F.floor(F.col("line_no") / BLOCK).cast("int"))
    comment = F.col("line").rlike(COMMENT)
    one = F.struct("line_no", "line", F.when(comment, 0).otherwise(braces(F.col("line"))).alias("net"), (F.col("line").rlike(HEADER) & ~comment).alias("header"), comment.alias("comment"))
    packed = materialize(each.groupBy(*keys, "_block", "_rest").agg(F.array_sort(F.collect_list(one)).alias("ls")))
    top = packed.where("NOT _rest").select(*keys, "_block", "ls")
    fields = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys)
    n, own = len(keys), [*keys, "_block"]

    def batch_of(row, names, *columns):
        return pa.RecordBatch.from_arrays([*(row.column(i) for i in range(n)), *columns], names=[*keys, *names])

    def functions(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                floors, ends, total, zero = block_function(row.column(n + 1)[0].as_py(), row.column(n + 2)[0].as_py())
                many = pa.list_(pa.int64())
                yield batch_of(row, ["_block", "floors", "ends", "total", "zero"], row.column(n), pa.array([floors], many), pa.array([ends], many), pa.array([total], pa.int64()), pa.array([zero], pa.int64()))

    made = top.select(*own, F.col("ls.net"), F.col("ls.header")).mapInArrow(functions, f"{fields}, _block int, floors array<long>, ends array<long>, total long, zero long")
    of_document = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "floors", "ends", "total", "zero"))).alias("b"))

    def entries(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, depth, at = batch.slice(i, 1), 0, []
                for b in row.column(n)[0].as_py():
                    at.append((b["_block"], depth))
                    depth = depth_after(depth, b["floors"], b["ends"], b["total"], b["zero"])
                same = pa.array([0] * len(at), pa.int32())
                block, depths = zip(*at, strict=True)
                yield pa.RecordBatch.from_arrays([*(row.column(j).take(same) for j in range(n)), pa.array(block, pa.int32()), pa.array(depths, pa.int64())], names=[*own, "depth"])

    begun = of_document.mapInArrow(entries, f"{fields}, _block int, depth long")

    def kept(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ls, depth = row.column(n + 1)[0].as_py(), row.column(n + 2)[0].as_py()
                outside = kept_lines(depth, [x["net"] for x in ls], [x["header"] for x in ls])
                left = [x["line"] for x, ok in zip(ls, outside, strict=True) if ok and not x["comment"]]
                yield batch_of(row, ["_block", "part"], row.column(n), pa.array(["\n".join(left) if left else None], pa.string()))

    parts = top.join(begun, own).select(*own, "ls", "depth").mapInArrow(kept, f"{fields}, _block int, part string")
    rest = packed.where("_rest").select(*own, F.array_join("ls.line", "\n").alias("part"))
    whole = lambda df, name: df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("_block", "part")))), lambda x: x["part"]), "\n").alias(name))
    preamble = whole(parts, "preamble").withColumn("preamble", F.regexp_replace("preamble", r"\n+\z", ""))
    every = documents.select(*keys).distinct().join(preamble, keys, "left").join(whole(rest, "rest"), keys, "left")
    return every.select(*keys, *(F.coalesce(c, F.lit("")).alias(c) for c in ("preamble", "rest")))


def without_instruments(text: Column) -> Column:
    """Lines that set instrument names go, unless there are two or more of either kind."""
    few = (F.regexp_count(text, F.lit(INSTRUMENT)) <= 1) & (F.regexp_count(text, F.lit(SHORT_INSTRUMENT)) <= 1)
    return F.when(few, F.regexp_replace(F.regexp_replace(text, INSTRUMENT, ""), SHORT_INSTRUMENT, "")).otherwise(text)


def converter_version(text: Column) -> Column:
    """The version that the first version line states, or null."""
    return F.nullif(F.regexp_extract(text, "(?m)" + VERSION, 1), F.lit(""))


def merged(documents: DataFrame, keys: list[str], text: str = "text", header: str = "header") -> DataFrame:
    """``keys merged``: each file as preamble, header block (a column of ``documents``), and rest."""
    split = split_documents(documents, keys, text).join(documents.select(*keys, F.col(header).alias("_header")), keys)
    return split.select(*keys, F.concat("preamble", F.lit("\n\n"), "_header", F.lit("\n\n"), without_instruments(F.col("rest"))).alias("merged"))
