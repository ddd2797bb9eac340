"""Source divergence audit: DuckDB aggregates shards of terms, Spark merges sums and rankings.

1. Tasks count the terms of each (lang, source) group, each of its batches of text
   once; what leaves a task is one row for a group's term, so a frequent term
   of a large source has as many rows as there are tasks, not occurrences.
2. These rows are sharded by the hash of lang and term. A shard is sorted by them
   and read in blocks; DuckDB sums counts and documents and keeps the terms of
   ``least_docs`` documents of the language. A block that ends inside a term hands
   that term's sums on to the next, so no term has to fit into a block.
3. Totals by group follow, and with them every smoothed share
   ``p = 1 + floor(SCALE * (count + 1) / (total + terms))``.
4. Shards again: DuckDB sums, over the terms that two groups share, by how much
   ``f = floor((p - q)^2 / q)`` differs from what it is where a count is 0, counts the
   terms of each share in each group, and keeps the best ranks of each group's terms.
5. Spark adds up. A sum over all kept terms is that of two groups without any term,
   corrected for the terms that one of them has (by its counted shares) and for those
   that both have; so nothing grows with terms times groups.

All arithmetic is on integers; sums are decimals of 38 digits.
Pairs of groups come out by contract; a language's groups meet each other in that number.

Defined results: null text, lang and source are empty; each row is a document of its
own, repeated ones too; a group without terms has counts of 0; a language without kept
terms has pairs of value 0 and no terms; an empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import keep, sized_broadcast, text_of, tidy

LEAST_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
#: A group's terms that a task holds before it hands them on, and rows of a shard that DuckDB gets at a time.
HELD, BLOCK = 400_000, 1 << 18
#: What isn't a letter or beyond ASCII parts terms; A-Z are lower-cased.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
SUM = "decimal(38,0)"
PARTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
CELLS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("n_lang", pa.int64()), ("head", pa.int64())])
FOUND = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("p", pa.int64()), ("value", pa.decimal128(38, 0))])


def _ddl(schema: pa.Schema) -> str:
    name = {pa.string(): "string", pa.int64(): "long", pa.decimal128(38, 0): SUM}
    return ", ".join(f"{f.name} {name[f.type]}" for f in schema)


def _database():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def partial_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """``lang term source n docs``: sums of a task's documents. The empty term stands for the group itself."""
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))

    def made(counts: dict, docs_of: dict):
        for (la, so), n in counts.items():
            terms, d = list(n), docs_of[la, so]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([la] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([so] * len(terms), pa.string()),
                    pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in terms], pa.int64()),
                ],
                schema=PARTS,
            )

    def task(batches):
        counts, docs_of, size = {}, {}, 0
        for batch in batches:
            for la, so, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = t.as_buffer().to_pybytes().translate(TERM).split()
                n = counts.get((la, so))
                if n is None:
                    n, docs_of[la, so] = counts.setdefault((la, so), Counter({b"": 0})), Counter()
                before = len(n)
                n.update(terms)
                docs_of[la, so].update(set(terms))
                size += len(n) - before
                if size >= HELD:
                    yield from made(counts, docs_of)
                    counts, docs_of, size = {}, {}, 0
        yield from made(counts, docs_of)

    return rows.mapInArrow(tidy(task), _ddl(PARTS))


def sharded(rows: DataFrame) -> DataFrame:
    """A shard's terms stand together, so that it is read in blocks whatever its size."""
    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term")


def _blocks(batches, schema: pa.Schema, whole: bool):
    """Tables of ``BLOCK`` rows or so; ``whole``: those of one term are never parted."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if not held or (batch is not None and size < BLOCK):
            continue
        t = pa.Table.from_batches(held, schema)
        cut = size
        if batch is not None and whole:
            la, te = t.column("lang").combine_chunks(), t.column("term").combine_chunks()
            cut = size - 1
            # the last term may go on in the next batch
            while cut and te[cut - 1] == te[size - 1] and la[cut - 1] == la[size - 1]:
                cut -= 1
            if not cut:
                continue
        yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
        size -= cut


def kept_cells(parts: DataFrame, least_docs: int) -> DataFrame:
    """``lang term source n n_lang head``: counts of the kept terms; head is 1 once a term. Groups keep their empty term."""
    schema = PARTS

    def task(batches):
        con = _database()
        con.sql("CREATE TABLE sums (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")

        def out(where: str):
            t = con.execute(f"""
                SELECT lang, term, source, n, CAST(sum(n) OVER w AS BIGINT) AS n_lang, CAST(row_number() OVER w = 1 AND term <> '' AS BIGINT) AS head
                FROM sums WHERE {where} WINDOW w AS (PARTITION BY lang, term)
                QUALIFY term = '' OR sum(docs) OVER (PARTITION BY lang, term) >= {least_docs}
            """).to_arrow_table()
            yield from t.cast(CELLS).to_batches()

        for block in _blocks(batches, schema, False):
            con.register("block", block)
            con.execute("CREATE OR REPLACE TABLE sums AS SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM (FROM block UNION ALL FROM sums) GROUP BY ALL")
            con.unregister("block")
            last = [block.column(c)[block.num_rows - 1].as_py().replace("'", "''") for c in ("lang", "term")]
            ends = f"(lang = '{last[0]}' AND term = '{last[1]}')"
            yield from out(f"NOT {ends}")
            con.execute(f"DELETE FROM sums WHERE NOT {ends}")
        yield from out("true")
        con.close()

    return sharded(parts).mapInArrow(tidy(task), _ddl(CELLS))


def found_in_shards(cells: DataFrame, ranks: int) -> DataFrame:
    """``kind lang source item p value``: sums over terms that two groups share, terms by share, best terms."""
    columns = ["lang", "term", "source", "p", "p0", "q"]
    schema = pa.schema([(c, pa.string()) for c in columns[:3]] + [(c, pa.int64()) for c in columns[3:]])
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // {q})"

    def task(batches):
        con = _database()
        con.sql("CREATE TABLE found (kind VARCHAR, lang VARCHAR, source VARCHAR, item VARCHAR, p BIGINT, value HUGEINT)")
        con.sql("CREATE TABLE more AS FROM found")

        def merged():
            """What a shard holds is at most a row for each pair of groups, share of a group, and rank."""
            con.execute("CREATE OR REPLACE TABLE found AS SELECT kind, lang, source, item, p, sum(value) AS value FROM (FROM found UNION ALL FROM more) WHERE kind <> 'term' GROUP BY ALL "
                        "UNION ALL SELECT * FROM (FROM found UNION ALL FROM more) WHERE kind = 'term' "
                        f"QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {ranks}")  # fmt: skip
            con.execute("DELETE FROM more")

        for block in _blocks(batches, schema, True):
            con.register("block", block)
            con.execute("CREATE OR REPLACE TABLE t AS FROM block")
            con.unregister("block")
            con.execute(f"""
                INSERT INTO more SELECT 'both', a.lang, a.source, b.source, 0, sum({f('a.p', 'b.p')} - {f('a.p', 'b.p0')} - {f('a.p0', 'b.p')} + {f('a.p0', 'b.p0')})
                FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
            """)
            con.execute("INSERT INTO more SELECT 'share', lang, source, '', p, count(*) FROM t GROUP BY ALL")
            con.execute(f"INSERT INTO more SELECT 'term', lang, source, term, 0, {f('p', 'q')} AS v FROM t WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY v DESC, term) <= {ranks}")
            merged()
        t = con.execute("SELECT * REPLACE (CAST(value AS DECIMAL(38, 0)) AS value) FROM found").to_arrow_table()
        yield from t.cast(FOUND).to_batches(max_chunksize=100_000)
        con.close()

    return sharded(cells.select(*columns)).mapInArrow(tidy(task), _ddl(FOUND))


def _share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact at any count; null where both are 0."""
    return F.expr(f"1 + (cast({SCALE} as decimal(18,0)) * (cast({n} as decimal(19,0)) + 1)) div nullif({total} + {terms}, 0)")


def _f(p: str, q: str):
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS,
) -> DataFrame:
    """``lang source part item value rank``: for each group the other sources by divergence, and its own terms."""
    cells = keep(kept_cells(partial_counts(docs, lang, source, text), least_docs))
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    groups = keep(groups)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"))
    groups = groups.join(F.broadcast(langs) if langs.count() <= 100_000 else langs, "lang")
    groups = keep(groups.select("lang", "source", "total", "lang_total", "terms", _share("0", "total", "terms").alias("p0")))

    own = cells.where("term != ''").join(sized_broadcast(groups), ["lang", "source"])
    own = own.withColumns({"p": _share("n", "total", "terms"), "q": _share("n_lang", "lang_total", "terms")})
    found = keep(found_in_shards(own, ranks))

    ends = sized_broadcast(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    base = groups.select("lang", "source", "p0", "terms").join(ends, "lang").where("source != item")
    base = base.select("lang", "source", "item", F.expr(f"coalesce(cast(terms as decimal(19,0)) * {_f('p0', 'q0')}, 0)").cast(SUM).alias("value"))
    shares = found.where("kind = 'share'").groupBy("lang", "source", "p").agg(F.sum("value").alias("k"))
    shares = shares.join(sized_broadcast(groups.select("lang", "source", "p0")), ["lang", "source"]).join(ends, "lang").where("source != item")
    times = lambda x: F.expr(f"cast(k as decimal(19,0)) * ({x})").cast(SUM)
    one = shares.select(
        "lang",
        F.explode(
            F.array(
                F.struct("source", "item", times(f"{_f('p', 'q0')} - {_f('p0', 'q0')}").alias("value")),
                F.struct(F.col("item").alias("source"), F.col("source").alias("item"), times(f"{_f('q0', 'p')} - {_f('q0', 'p0')}").alias("value")),
            )
        ).alias("x"),
    ).select("lang", "x.*")
    both = found.where("kind = 'both'").select("lang", "source", "item", "value")
    pairs = base.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    terms = found.where("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents: every group's distance to the other sources of its language, and the terms it is rich in."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
t AS (SELECT lang, source, row, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
n AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(s.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS total FROM n GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n.c, 0) AS c,
    CAST(1 + CAST({SCALE} AS HUGEINT) * (coalesce(n.c, 0) + 1) // (g.total + v) AS BIGINT) AS p, CAST(1 + CAST({SCALE} AS HUGEINT) * (kept.c + 1) // (v.total + v) AS BIGINT) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b USING (lang) WHERE a.source <> b.source AND lang NOT IN (SELECT lang FROM kept)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= {RANKS}
"""
