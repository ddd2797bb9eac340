"""Line dedup by distinct-site spread (native).

Each line is hashed. Per hash, HyperLogLog sketches of the sites that show it
and of the lines around it merge by aggregation; lines whose estimates lie near
a threshold get exact distinct counts. A line is boilerplate if at least
``min_sites`` sites show it and its surroundings differ: lines that always stand
between the same neighbours belong to copies of a whole document, which are the
near-duplicate stage's to judge. All occurrences of boilerplate lines go, but a
document is never emptied: one made of boilerplate alone stays as it is.

There are two rules for that. ``OP9_SQL``'s, which ``op9_line_dedup`` has to meet,
takes the lines before and after and asks for a share of the occurrences; it keeps
inner lines of fixed blocks. With ``by_texts`` (the pipeline) ``min_sites`` sites have
to show the line in different texts. Text of a document's own is what stands outside
widely shown lines. A text counts if no text before it (in the order of a hash) has
``DIFFERENT`` percent of the ``SKETCH`` least hashes of its word passages, so copies,
exact or edited, weigh about one however many they are; documents with less than
``MIN_OWN`` percent of own text are copies and don't count.

Two hashes (128 bits) stand for a line; no Python runs on the executors, and only
the last join moves text. Defined results: a null text has no lines and stays
null; blank lines are never boilerplate; a null site is one site of its own;
repeated rows are cleaned alike; empty tables give empty tables; extra columns pass
through, but ``n_lines`` and ``n_removed`` of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import columns_of, fresh, keep, row_key, same_row, text_of

MIN_SITES = 8
#: Share of a line's occurrences with surroundings of their own, in percent.
MIN_CONTEXTS = 50
#: By texts: percent of a document's characters outside widely shown lines, for it to count.
MIN_OWN = 20
#: Words of a passage, and passages' hashes that stand for a text.
PASSAGE, SKETCH = 5, 16
#: Percent of these that no text before has, for a text to be a different one.
DIFFERENT = 75
#: Estimates this near to a threshold (in percent of it) are counted exactly.
NEAR = 20


def _lines(docs: DataFrame, doc_id: str, text: str, site: str, min_chars: int) -> DataFrame:
    """``_id _key site pos h1 h2 around`` for each line that may be boilerplate."""
    whole = docs.select(
        *row_key(doc_id, text),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"),
        F.split(text_of(text), "\n").alias("lines"),
    )
    hashes = F.transform("lines", lambda x: F.xxhash64(F.trim(x)))
    whole = whole.withColumn("hs", hashes)
    one = whole.select(
        "_id", "_key", "site",
        F.posexplode(
            F.transform(
                "lines",
                lambda x, i: F.struct(
                    F.length(F.trim(x)).alias("n"),
                    F.xxhash64(F.trim(x)).alias("h1"),
                    F.xxhash64(F.lit("line"), F.trim(x)).alias("h2"),
                    F.xxhash64(F.get("hs", i - 1), F.get("hs", i + 1), F.size("hs") == 1).alias("around"),
                ),
            )
        ),
    )
    return one.where(F.col("col.n") >= min_chars).select("_id", "_key", "site", "pos", "col.h1", "col.h2", "col.around")


def _spread(n, sites, contexts, min_sites: int, min_contexts: int, near: int = 0):
    """At or over both thresholds, lowered by ``near`` percent (raised, if negative)."""
    return (sites * 100 >= min_sites * (100 - near)) & (contexts * 10000 >= n * min_contexts * (100 - near))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``h1 h2`` of the boilerplate lines."""
    rough = keep(
        lines.groupBy("h1", "h2")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.hll_sketch_estimate(F.hll_sketch_agg("site", 12)).alias("sites"),
            F.hll_sketch_estimate(F.hll_sketch_agg("around", 12)).alias("contexts"),
        )
        .where((F.col("n") >= min_sites) & _spread(F.col("n"), F.col("sites"), F.col("contexts"), min_sites, min_contexts, NEAR))
    )
    sure = _spread(F.col("n"), F.col("sites"), F.col("contexts"), min_sites, min_contexts, -NEAR)
    at_edge = lines.join(rough.where(~sure).select("h1", "h2"), ["h1", "h2"], "left_semi")
    # distinct counts by two aggregations each, so that one hot line is summed up before it moves
    exact = None
    for name, col in (("sites", "site"), ("contexts", "around")):
        part = at_edge.groupBy("h1", "h2", col).agg(F.count(F.lit(1)).alias("n")).groupBy("h1", "h2")
        part = part.agg(F.count(F.lit(1)).alias(name), F.sum("n").alias(f"n_{name}"))
        exact = part if exact is None else exact.join(part, ["h1", "h2"])
    exact = exact.where(_spread(F.col("n_sites"), F.col("sites"), F.col("contexts"), min_sites, min_contexts))
    return rough.where(sure).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def _least(hashes):
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)


def _passages(line):
    """The least hashes of a line's word passages; a shorter line is one."""

    def least(words):
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - PASSAGE, F.lit(0)))
        return _least(F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(PASSAGE)))))

    # an array of one, so that the words are split once and not for each passage
    return F.get(F.transform(F.array(F.split(line, " +")), least), 0)


def boilerplate_by_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
    min_sites: int = MIN_SITES, min_chars: int = 10,
) -> DataFrame:
    """``h1 h2`` of the lines that ``min_sites`` sites show in different texts.

    Widely shown lines of any length are no own text; those of ``min_chars`` and more are judged.
    """
    lines = _lines(docs, doc_id, text, site, 1)
    wide = keep(boilerplate(lines, min_sites, 0))
    # exact repeats of a row share the key, the set holds each place once
    shown = lines.join(wide, ["h1", "h2"], "left_semi").groupBy("_id", "_key").agg(
        F.collect_set(F.struct("pos", "h1", "h2")).alias("shown")
    )
    # lengths and hashes move, not text
    trimmed = F.transform(F.split(text_of(text), "\n"), F.trim)
    short = docs.select(
        *row_key(doc_id, text),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"),
        F.xxhash64(text_of(text)).alias("class"),
        F.transform(trimmed, lambda x: F.struct(F.length(x).alias("n"), F.when(F.length(x) > 0, _passages(x)).alias("least"))).alias("ls"),
    )
    held = short.join(shown, same_row(short, shown)).drop(shown["_id"]).drop(shown["_key"])
    own = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("shown.pos"))
    held = held.withColumn("own", F.transform(own, lambda i: F.get("ls", i)))

    def chars(of):
        return F.aggregate(of, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])

    held = held.where(chars(F.col("own")) * 100 >= chars(F.col("ls")) * MIN_OWN)
    held = held.withColumn("least", _least(F.flatten(F.filter(F.col("own.least"), lambda x: x.isNotNull()))))
    at = F.transform("shown", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), F.get("ls", x["pos"])["n"].alias("n")))
    one = F.struct("class", "site", F.size("least").alias("k"))
    seen = held.select(one.alias("one"), "least", F.explode(at).alias("x")).where(F.col("x.n") >= min_chars)
    # of the texts that share a passage the first has it
    led = seen.select("x.h1", "x.h2", "one", F.explode("least").alias("v")).groupBy("h1", "h2", "v").agg(F.min("one").alias("one"))
    first = led.groupBy("h1", "h2", "one").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 100 >= F.col("one.k") * DIFFERENT)
    sites = first.groupBy("h1", "h2", F.col("one.site").alias("site")).agg(F.lit(1).alias("n"))
    return sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")


def clean(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
    min_sites: int = MIN_SITES, min_contexts: int = MIN_CONTEXTS, min_chars: int = 10, by_texts: bool = False,
) -> DataFrame:
    """The input's columns with cleaned text, plus ``n_lines`` and ``n_removed``.

    ``n_lines`` counts all lines of the text. Removed lines take their line
    break along; nothing else of the text changes. ``by_texts`` leaves ``min_contexts`` out.
    """
    lines = _lines(docs, doc_id, text, site, min_chars)
    bad = keep(boilerplate_by_texts(docs, doc_id, text, site, min_sites, min_chars) if by_texts else boilerplate(lines, min_sites, min_contexts))
    own_id, key, gone, kept, cut = fresh(docs, "_id", "_key", "_gone", "_kept", "_cut")
    hits = (
        lines.join(bad, ["h1", "h2"], "left_semi")
        .groupBy(F.col("_id").alias(own_id), F.col("_key").alias(key))
        .agg(F.collect_set("pos").alias(gone))
    )
    whole = docs.select("*", *(c.alias(n) for c, n in zip(row_key(doc_id, text), (own_id, key), strict=True)))
    joined = whole.join(hits, (whole[key] == hits[key]) & whole[own_id].eqNullSafe(hits[own_id]), "left").drop(hits[own_id]).drop(hits[key])
    split = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    # a document is never emptied
    done = joined.withColumn(kept, F.when(F.col(gone).isNotNull(), F.transform(left, lambda i: F.get(split, i)))).withColumn(
        cut, F.coalesce(F.exists(kept, lambda x: F.length(F.trim(x)) > 0), F.lit(False))
    )
    new = F.when(F.col(cut), F.array_join(kept, "\n")).otherwise(F.col(text)).alias(text)
    counts = ("n_lines", "n_removed")
    return done.select(
        *(new if c == text else x for c, x in zip(docs.columns, columns_of(docs), strict=True) if c.lower() not in counts),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col(cut), F.size(gone)).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: cleaned text, lines before, lines removed."""
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "text")


OP9_SQL = f"""
WITH l AS (
  SELECT doc_id, source, generate_subscripts(a, 1) AS pos, unnest(a) AS line, len(a) AS n, a
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), o AS (
  SELECT doc_id, pos, trim(line, ' ') AS line, coalesce(source, '') AS site, n = 1 AS alone,
         trim(CASE WHEN pos > 1 THEN a[pos - 1] END, ' ') AS prev, trim(a[pos + 1], ' ') AS next
  FROM l
), bad AS (
  SELECT line FROM o WHERE length(line) >= 10 GROUP BY line
  HAVING count(DISTINCT site) >= {MIN_SITES}
     AND count(DISTINCT (prev, next, alone)) * 100 >= count(*) * {MIN_CONTEXTS}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, l.n, b.line IS NOT NULL AS gone
  FROM l LEFT JOIN bad b ON trim(l.line, ' ') = b.line
), done AS (
  SELECT doc_id, any_value(n) AS n, count(*) FILTER (gone) AS cut,
         bool_or(NOT gone AND length(trim(line, ' ')) > 0) AS full_,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS rest
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE done.n END AS BIGINT) AS n_lines,
       CAST(CASE WHEN full_ THEN cut ELSE 0 END AS BIGINT) AS n_removed,
       CASE WHEN full_ AND cut > 0 THEN rest ELSE d.text END AS text
FROM documents d JOIN done USING (doc_id)
"""
