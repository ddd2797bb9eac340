"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source. A source's target is met by
whole passes over it, an even share of each length, and bounded-knapsack dynamic
programming over what remains; then documents are picked by length count in
seeded order. No document is taken more than ``max_repeats`` times.

Only counts by (source, length) reach the knapsack, one source at a time, and
their number is bounded by the longest text, not by the rows. Documents are
ranked within (source, length, hash bucket), so that a length which a third of
all rows share is spread over many tasks. Defined results: a null text has size
0 and is taken 0 times; a null source is a source of its own, ordered last;
rows that repeat an id are ranked side by side, by their texts; an empty table
gives an empty mix; extra columns are ignored or pass through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import SPACE, columns_of, fresh, keep, text_of

WEIGHTS = (3.0, 1.0, 2.0)
BUCKETS = 1024
#: Bits of the knapsack's table: the remaining budget is worked off by length until it fits.
MOST_BITS = 1 << 22
#: Bytes of kept tables.
TABLE_BYTES = 1 << 28


def _sizes(doc_id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    """src: 's' + source, 'n' for null. luck and bucket: seeded, by the id; tie: by the text, for rows of one id."""
    luck = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"))
    tie = F.xxhash64(F.lit(seed), text_of(text))
    return {
        "src": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")),
        "size": F.regexp_count(text_of(text), F.lit(f"[^{SPACE}]+")).cast("long"),
        "bucket": F.pmod(luck, F.lit(BUCKETS)).cast("int"),
        "luck": luck,
        "tie": tie,
    }


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """``doc_id src size bucket luck tie`` (kept, text-free)."""
    return keep(docs.select(F.col(doc_id).alias("doc_id"), *(c.alias(k) for k, c in _sizes(doc_id, text, source, seed).items())))


def targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``src source_size target``: ``share`` of all sizes by weight, capped at ``cap`` times a source's size.

    The excess of capped sources is shared anew by weight until none is above.
    That point is found in closed form: in order of cap / weight, the first
    source whose cap exceeds its part of what the capped ones before it leave.
    """
    by_source = docs.groupBy("src").agg(F.sum("size").alias("source_size"))
    # one row for each source: its null flag and code points order the weights
    rank = F.row_number().over(Window.orderBy((F.col("src") == "n").cast("int"), F.encode("src", "UTF-8"))) - 1
    ws = F.array(*(F.lit(float(w)) for w in weights))
    s = by_source.withColumn("w", F.get(ws, (rank % len(weights)).cast("int"))).withColumn("top", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("top") / F.col("w"), F.encode("src", "UTF-8"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        s.withColumn("budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("top").over(upto), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("level", F.when(F.col("top") * F.col("w_left") > F.col("left") * F.col("w"), F.col("left") / F.col("w_left")))
    )
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select(
        "src", "source_size", F.least("top", F.coalesce(F.col("w") * F.col("level"), F.col("top"))).alias("target")
    )


def fit(sizes, counts, budget: int):
    """How many of each size to take so that their sum is near to ``budget``, not above.

    sizes: ascending, positive. An even share of each size first, then sizes from
    the largest down until the rest fits the table, then exact subset sums by
    bounded knapsack over a bit set: of what is left then, none comes nearer. Tables
    beyond ``TABLE_BYTES`` are made anew from the last one kept, not given up.
    """
    sizes, counts = [int(x) for x in sizes], [int(x) for x in counts]
    whole = sum(a * b for a, b in zip(sizes, counts, strict=True))
    if budget >= whole:
        return counts
    take = [b * budget // whole for b in counts] if whole else [0] * len(sizes)
    rest = budget - sum(a * b for a, b in zip(sizes, take, strict=True))
    most = min(max(4 * max(sizes, default=0), 4096), MOST_BITS)
    for i in range(len(sizes) - 1, -1, -1):
        if rest <= most:
            break
        k = min(counts[i] - take[i], (rest - most // 2) // sizes[i])
        if k > 0:
            take[i] += k
            rest -= k * sizes[i]
    # parts of 1, 2, 4, ... copies of a size; bit s of ``reach`` says that the sum s can be made of the parts so far
    parts = []
    for i, a in enumerate(sizes):
        spare, part = min(counts[i] - take[i], rest // a), 1
        while spare > 0:
            part = min(part, spare)
            parts.append((i, part))
            spare -= part
            part *= 2
    mask = (1 << (rest + 1)) - 1

    def with_part(reach: int, k: int) -> int:
        i, part = parts[k]
        return reach | (reach << (sizes[i] * part)) & mask

    gap = max(1, -(-len(parts) * (rest // 8 + 1) // TABLE_BYTES))
    kept, reach, done = {0: 1}, 1, len(parts)
    for k in range(len(parts)):
        if reach >> rest & 1:
            done = k
            break
        reach = with_part(reach, k)
        if (k + 1) % gap == 0:
            kept[k + 1] = reach
    at = reach.bit_length() - 1
    for start in range((done - 1) // gap * gap, -1, -gap) if done else ():
        tables = [kept[start]]
        for k in range(start, min(start + gap, done) - 1):
            tables.append(with_part(tables[-1], k))
        for k in range(min(start + gap, done) - 1, start - 1, -1):
            if not tables[k - start] >> at & 1:
                i, part = parts[k]
                take[i] += part
                at -= sizes[i] * part
    return take


def plan(docs: DataFrame, goal: DataFrame, max_repeats: int = 2) -> DataFrame:
    """``src size base extra``: each document of that source and length is taken ``base`` times, ``extra`` of them once more."""
    counts = docs.where("size > 0").groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))

    def of_source(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        target, whole = int(round(pdf["target"].iloc[0])), int(pdf["source_size"].iloc[0])
        base = min(target // whole, max_repeats)
        extra = fit(pdf["size"], pdf["n"], target - base * whole) if base < max_repeats else [0] * len(pdf)
        return pd.DataFrame({"src": pdf["src"], "size": pdf["size"], "base": base, "extra": extra})

    return counts.join(goal, "src").groupBy("src").applyInPandas(of_source, "src string, size long, base long, extra long")


def _times(rows: DataFrame, cells: DataFrame, src: str, size: str, bucket: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with the times each is taken: by its rank within its cell and the cell's quota."""
    own = ("c_src", "c_size", "c_bucket", "c_base", "c_quota")
    rank, *inner = fresh(rows, "_rank", *own)
    cells = cells.select(*(F.col(c).alias(n) for c, n in zip(own, inner, strict=True)))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(src, size, bucket).orderBy(*order)))
    on = (ranked[src] == cells[inner[0]]) & (ranked[size] == cells[inner[1]]) & (ranked[bucket] == cells[inner[2]])
    times = F.coalesce(F.col(inner[3]) + (F.col(rank) <= F.col(inner[4])).cast("long"), F.lit(0))
    return ranked.join(cells, on, "left").withColumn(name, times).drop(*inner, rank)


def _decide(each: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Targets by source, and base and quota by (source, length, bucket)."""
    goal = keep(targets(each, weights, share, cap))
    how = keep(plan(each, goal, int(cap)))
    cells = each.where("size > 0").groupBy("src", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(how, ["src", "size"]).select(
        F.col("src").alias("c_src"), F.col("size").alias("c_size"), F.col("bucket").alias("c_bucket"), F.col("base").alias("c_base"),
        (F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("c_quota"),
    )
    return goal, cells


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17,
) -> DataFrame:
    """``doc_id src size source_size target taken`` for every row; taken counts words, repeats included."""
    each = sized(docs, doc_id, text, source, seed)
    goal, cells = _decide(each, weights, share, cap)
    done = _times(each, cells, "src", "size", "bucket", ["luck", "doc_id", "tie"], "times")
    return done.join(goal, "src").select(
        "doc_id", "src", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken")
    )


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17,
) -> DataFrame:
    """The documents that the mix takes, with ``copies``: how often (a column of that name is replaced). Moves the texts once."""
    _, cells = _decide(sized(docs, doc_id, text, source, seed), weights, share, cap)
    sizes = _sizes(doc_id, text, source, seed)
    kept = [c for c in docs.columns if c.lower() != "copies"]
    names = dict(zip(sizes, fresh(docs, *(f"_{k}" for k in sizes)), strict=True))
    rows = docs.select(*columns_of(docs, kept), *(c.alias(names[k]) for k, c in sizes.items()))
    done = _times(rows, cells, names["src"], names["size"], names["bucket"], [names["luck"], doc_id, names["tie"]], "copies")
    return done.where("copies > 0").select(*columns_of(docs, kept), "copies")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, weights 3, 1, 2 over the sources in turn, 150 % of all words."""
    done = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """What each document of op2's mix measures, and its source's target: the part that SQL can express."""
    each = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return each.join(targets(each), "src").select("doc_id", "size", "source_size", "target")


#: Shares by weight, gives what is above a cap to the others, and so on until none is above.
MIX_TARGETS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS top, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), lv(i, level) AS (
  SELECT 0, sum(source_size) * 1.5::DOUBLE / sum(w) FROM s
  UNION ALL
  SELECT i + 1, (sum(source_size) * 1.5::DOUBLE - coalesce(sum(top) FILTER (top < w * level), 0)) / nullif(sum(w) FILTER (top >= w * level), 0)
  FROM lv, s WHERE i < (SELECT count(*) FROM s) AND level IS NOT NULL GROUP BY i, level
), final AS (SELECT level FROM lv ORDER BY i DESC LIMIT 1)
SELECT doc_id, size, source_size, least(top, coalesce(w * level, top)) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, final"""
