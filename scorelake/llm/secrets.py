"""Secret scans by corpus-wide ownership frequency (native).

Patterns find candidates in whole texts. Their values are hashed and counted
over the corpus by distinct repositories and owners: a value that many owners
or repositories hold is a widely copied example, one that few hold and that looks
random is treated as live. No Python runs on the executors.

Only text-free rows (kind, gap lengths, matches) leave the scan, so no text is
shuffled. Defined results: a null or empty text has no spans; a null owner or
repository counts as one value of its own; rows that repeat are reported each
time; extra columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import keep, text_of

ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
#: Kind, pattern, group that holds the value, least length of the value.
BASE = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Found besides the base kinds. A generic value counts only where one owner holds it.
MORE = (
    ("vendor", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-)[A-Za-z0-9_-]{20,}", 0, 20),
    (
        "generic",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])"
        r"[A-Za-z0-9+/_-]{32,}",
        0,
        32,
    ),
)
KINDS = BASE + MORE
#: Characters of different kinds that a value must hold to look random, by its kind; and repositories of a shared example.
VARIED, WIDE_REPOS = {"assign": 5, "access": 8, "hex": 8, "vendor": 8, "generic": 12}, 20
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567|(.)\1{5}"


def _pieces(text: Column, kind: tuple) -> Column:
    """Lengths of what lies before each match, and the matches themselves.

    A pattern of long runs is first tried with its least length, which is
    cheaper and finds nothing exactly where no run is long enough.
    """
    name, pattern, _, least = kind
    test = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}.get(name, pattern)
    long_runs = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(name, pattern)
    found = F.struct(
        F.lit(name).alias("kind"),
        F.transform(F.split(text, long_runs), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(long_runs), F.lit(0)).alias("matches"),
    )
    return F.when(text.rlike(test), found)


def candidates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
    repo: str | None = None,
) -> DataFrame:
    """One row per document: ``_row doc_id owner repo pieces`` (kept, text-free)."""
    whole = text_of(text)
    return keep(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(doc_id).alias("doc_id"),
            F.col(owner).cast("string").alias("owner"),
            F.col(repo or doc_id).cast("string").alias("repo"),
            F.filter(F.array(*(_pieces(whole, k) for k in KINDS)), lambda x: x.isNotNull()).alias("pieces"),
        )
    )


def spans(found: DataFrame) -> DataFrame:
    """One row per match that holds: ``_row owner repo kind start end value``.

    Offsets are in code points, from running sums of gap and match lengths.
    """
    one = found.select("_row", "owner", "repo", F.explode("pieces").alias("p")).select(
        "_row", "owner", "repo", "p.kind", F.posexplode(F.arrays_zip("p.gaps", "p.matches"))
    )
    one = one.select("_row", "owner", "repo", "kind", "pos", F.col("col.gaps").alias("gap"), F.col("col.matches").alias("match"))
    before = Window.partitionBy("_row", "kind").orderBy("pos")
    size = F.coalesce(F.length("match"), F.lit(0)).cast("long")
    end = F.sum(F.col("gap").cast("long") + size).over(before)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", "^" + ASSIGN, 2)).otherwise(F.col("match"))
    least = F.element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k[0], k[3]))), F.col("kind"))
    return (
        one.select("*", (end - size).alias("start"), end.alias("end"), value.alias("value"))
        .where(F.col("match").isNotNull() & (F.length("value") >= least))
        .select("_row", "owner", "repo", "kind", "start", "end", "value")
    )


def ownership(found_spans: DataFrame) -> DataFrame:
    """``hash n_repos n_owners n_found``: over all spans, pre-aggregated by owner and repository."""
    by_repo = found_spans.groupBy(
        F.sha2("value", 256).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")
    ).agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_found")
    )


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
    repo: str | None = None, wide_owners: int = 3,
) -> DataFrame:
    """Every document with its spans and the corpus-wide standing of their values.

    Returns ``doc_id spans`` where ``spans`` is an array, by start and kind, of
    ``start ord kind end hash n_repos n_owners standing``; standing is
    ``example`` (held by ``wide_owners`` or more owners or ``WIDE_REPOS`` or more
    repositories, a placeholder, or of too few different characters to be random)
    or ``live``. Generic values stay only if a single owner holds them.
    """
    found = candidates(docs, doc_id, text, owner, repo)
    each = keep(spans(found))
    order = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k[0], i))), F.col("kind"))
    varied = F.element_at(F.create_map(*(F.lit(x) for k, n in VARIED.items() for x in (k, n))), F.col("kind"))
    random = (F.size(F.array_distinct(F.split("value", ""))) >= varied) & F.col("value").rlike("[0-9]")
    few = (F.col("n_owners") < wide_owners) & (F.col("n_repos") < WIDE_REPOS)
    live = few & random & ~F.col("value").rlike(PLACEHOLDER)
    told = (
        each.withColumn("hash", F.sha2("value", 256))
        .join(ownership(each), "hash")
        .where((F.col("kind") != "generic") | ((F.col("n_owners") == 1) & live))
        .select(
            "_row",
            F.struct(
                "start", order.alias("ord"), "kind", "end", "hash", "n_repos", "n_owners",
                F.when(live, "live").otherwise("example").alias("standing"),
            ).alias("s"),
        )
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list("s")).alias("spans"))
    )
    none = F.array().cast(told.schema["spans"].dataType)
    return found.select("_row", "doc_id").join(told, "_row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents; the owner is the source and each document a repository."""
    done = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [k[0] for k in BASE]
    joined = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return done.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["standing"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: x["standing"] == "example")).cast("long").alias("n_example"),
    )


def secret_base(spark, sf_dir: str) -> DataFrame:
    """The columns of ``op1_secret_scan`` that SQL can express: the base kinds."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _sql_kind(ord_: int, name: str, pattern: str, value: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{name}' AS kind, {ord_} AS ord, list_sum(list_transform(gaps[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : k - 1], lambda x: length(x))), 0) AS a, length(ms[k]) AS n
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {value}) AS vs FROM d))
WHERE length(vs[k]) >= {least}"""


SECRET_BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_sql_kind(i, *k) for i, k in enumerate(BASE))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, ord) AS s FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
