"""Timing, carrying and slicing over the driver's tables, which stand in for scores.

Events: a user is a part, a day a measure; errors are backups, purchases forwards,
signups carry attributes, the rest are notes. These test what operators mean, not music.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import carry, slicing, timing


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.col("event_type")
    return e.select(
        F.col("user_id").alias("part_id"), F.col("ts").cast("date").alias("measure"), F.col("event_id").alias("ord"), k.alias("k"), t.alias("event_type"), "value",
        F.when(t == "error", "backup").when(t == "purchase", "forward").when(t == "signup", "attributes").otherwise("note").alias("kind"),
        F.when(k % 11 != 0, (F.floor("value") % 9).cast("string")).alias("duration"),
        ((t == "click") & (k % 5 == 0)).alias("has_chord"),
    )


EVENTS = """ev AS (
  SELECT user_id AS part_id, CAST(ts AS DATE) AS measure, event_id AS ord, k, event_type, value,
         CASE event_type WHEN 'error' THEN 'backup' WHEN 'purchase' THEN 'forward' WHEN 'signup' THEN 'attributes' ELSE 'note' END AS kind,
         CASE WHEN k % 11 <> 0 THEN CAST(floor(value) AS BIGINT) % 9 ELSE 0 END AS dur, event_type = 'click' AND k % 5 = 0 AS chord
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def _spans(keys: str) -> str:
    return f"""{EVENTS}, st AS (
  SELECT {keys}, ord, sum(CASE WHEN kind = 'backup' THEN -dur WHEN kind = 'forward' OR kind = 'note' AND NOT chord THEN dur ELSE 0 END)
         OVER (PARTITION BY {keys} ORDER BY ord) AS s FROM ev
), pos AS (SELECT {keys}, s - least(0, min(s) OVER (PARTITION BY {keys} ORDER BY ord)) AS p FROM st),
spans AS (SELECT {keys}, CAST(greatest(0, max(p)) AS BIGINT) AS span FROM pos GROUP BY ALL)"""


def measure_span(spark, sf_dir):
    return timing.measure_span(_events(spark, sf_dir), ["part_id", "measure"], ["ord"]).drop("n_bad")


MEASURE_SPAN = f"WITH {_spans('part_id, measure')} SELECT part_id, measure, span FROM spans"


def _facts(ev, keys):
    first = lambda c, w: F.min_by(F.when(w, c), F.when(w, F.col("ord")))
    signup = F.col("event_type") == "signup"
    hint = signup & (F.col("k") >= 20)
    facts = ev.groupBy(*keys).agg(
        first(F.when(F.col("k") % 8 == 0, 4).otherwise(8), signup & (F.col("k") % 4 == 0)).alias("divisions"),
        first(F.col("k") % 5 + 2, hint).alias("beats"), first(F.pow(F.lit(2), F.col("k") % 3 + 1).cast("long"), hint).alias("beat_type"),
    )
    return facts.join(timing.measure_span(ev, keys, ["ord"]).drop("n_bad"), keys)


def effective_timesig_changes(spark, sf_dir):
    keys = ["part_id", "measure"]
    sig = timing.effective_signatures(_facts(_events(spark, sf_dir), keys), ["part_id"], ["measure"])
    return timing.changes(sig, ["part_id"], ["measure"]).select("part_id", "measure", "span", "sig_beats", "sig_beat_type")


def _signatures(keys: str, part: str, source: str = "") -> str:
    """The signature in force, told by which measures set a new one: an independent form of the operator's."""
    return f"""{_spans(keys)}, facts AS (
  SELECT {keys}, arg_min(CASE WHEN k % 8 = 0 THEN 4 ELSE 8 END, ord) FILTER (event_type = 'signup' AND k % 4 = 0) AS divisions,
         arg_min(k % 5 + 2, ord) FILTER (event_type = 'signup' AND k >= 20) AS b,
         arg_min(CAST(2 ** (k % 3 + 1) AS BIGINT), ord) FILTER (event_type = 'signup' AND k >= 20) AS t
  FROM ev {source} GROUP BY ALL
), m AS (
  SELECT *, coalesce(last_value(divisions IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY measure), 1) AS div FROM facts JOIN spans USING ({keys})
), r AS (
  SELECT *, CASE WHEN span > 0 THEN (span // gcd(span, div)) || '/' || (div // gcd(span, div)) END AS own,
         CASE WHEN b IS NOT NULL THEN (4 * b // gcd(4 * b, t)) || '/' || (t // gcd(4 * b, t)) END AS hint,
         CASE WHEN span > 0 THEN {{'b': span // gcd(span, div), 't': 4 * (div // gcd(span, div))}} END AS simple,
         CASE WHEN b IS NOT NULL THEN {{'b': b, 't': t}} END AS hinted FROM m
), p AS (
  SELECT *, last_value(coalesce(own, hint) IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM r
), n AS (
  SELECT *, CASE WHEN own IS NULL THEN hinted WHEN hint IS NOT NULL THEN CASE WHEN hint = own THEN hinted ELSE simple END
                 WHEN past IS DISTINCT FROM own THEN simple END AS new_sig FROM p
), eff AS (SELECT *, last_value(new_sig IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY measure) AS sig FROM n)"""


TIMESIG = f"""WITH {_signatures('part_id, measure', 'part_id')}, c AS (
  SELECT *, lag(sig) OVER (PARTITION BY part_id ORDER BY measure) AS prev FROM eff
)
SELECT part_id, measure, span, CAST(sig.b AS BIGINT) AS sig_beats, CAST(sig.t AS BIGINT) AS sig_beat_type
FROM c WHERE sig IS NOT NULL AND sig IS DISTINCT FROM prev"""


def position_join_fallback(spark, sf_dir):
    """A user is a score of three parts; the first one's signatures hold for all by ordinal."""
    ev = _events(spark, sf_dir).withColumn("score_id", F.col("part_id")).withColumn("part_id", F.col("ord") % 3)
    keys = ["score_id", "part_id", "measure"]
    lead = timing.effective_signatures(_facts(ev.where("part_id = 0"), keys), ["score_id"], ["measure"])
    every = ev.select(*keys).distinct()
    return timing.by_position(every, lead, ["score_id"], ["part_id"], ["measure"])


_LEAD = _signatures("score_id, part_id, measure", "score_id", "WHERE part_id = 0").replace(
    "user_id AS part_id", "user_id AS score_id, event_id % 3 AS part_id"
)
POSITION = f"""WITH {_LEAD}, lead_ AS (
  SELECT score_id, sig, true AS here, row_number() OVER (PARTITION BY score_id ORDER BY measure) AS i FROM eff
), last_ AS (SELECT score_id, arg_max(sig, i) AS sig FROM (SELECT score_id, i, {{'s': sig}} AS sig FROM lead_) GROUP BY 1
), every AS (
  SELECT *, row_number() OVER (PARTITION BY score_id, part_id ORDER BY measure) AS i FROM (SELECT DISTINCT score_id, part_id, measure FROM ev)
)
SELECT e.score_id, e.part_id, e.measure, CAST(CASE WHEN here THEN l.sig.b ELSE z.sig.s.b END AS BIGINT) AS sig_beats, CAST(CASE WHEN here THEN l.sig.t ELSE z.sig.s.t END AS BIGINT) AS sig_beat_type
FROM every e LEFT JOIN lead_ l USING (score_id, i) LEFT JOIN last_ z USING (score_id)"""


def carry_forward_last(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("value", F.when(F.col("k") % 3 == 0, F.col("value")))
    return carry.carry_last(ev, ["part_id", "event_type"], ["ord"], ["value"]).select("part_id", "event_type", "ord", "carried_value")


CARRY_LAST = f"""WITH {EVENTS} SELECT part_id, event_type, ord, last_value(CASE WHEN k % 3 = 0 THEN value END IGNORE NULLS)
  OVER (PARTITION BY part_id, event_type ORDER BY ord) AS carried_value FROM ev"""


def _systems(ev):
    """Systems of five days up to a part's last; attributes are signups and clicks, with a number that is null for every third."""
    system = (F.floor(F.datediff("measure", F.lit("2024-01-01").cast("date")) / 5) + 1).cast("int")
    return ev.select(
        "part_id", F.col("event_type").alias("tag"), F.nullif(F.col("k") % 3, F.lit(0)).alias("number"), "ord",
        system.alias("system"), F.max(system).over(Window.partitionBy("part_id")).alias("n_systems"),
    ).where(F.col("tag").isin("signup", "click"))


def carry_keyed_asof(spark, sf_dir):
    """What is in force at the start of each system, by part, tag and number."""
    a = _systems(_events(spark, sf_dir))
    return carry.in_force(a, ["part_id"], ["tag", "number"], "system", ["ord"], "ord", "n_systems")


CARRY_ASOF = f"""WITH {EVENTS}, a AS (
  SELECT part_id, event_type AS tag, nullif(k % 3, 0) AS number, ord, CAST(floor((measure - DATE '2024-01-01') / 5) AS INT) + 1 AS system
  FROM ev WHERE event_type IN ('signup', 'click')
), s AS (
  SELECT part_id, unnest(range(1, max(CAST(floor((measure - DATE '2024-01-01') / 5) AS INT) + 2))) AS system FROM ev GROUP BY 1
), g AS (
  SELECT a.part_id, CAST(s.system AS INT) AS system, a.tag, a.number, max(a.ord) AS ord, min(a.ord) AS seen
  FROM s JOIN a ON a.part_id = s.part_id AND a.system < s.system GROUP BY ALL
)
SELECT part_id, system, tag, number, ord, CAST(row_number() OVER (PARTITION BY part_id, system ORDER BY seen) AS INT) AS key_order FROM g"""


def range_slice_last_wins(spark, sf_dir):
    """An order is a system that expects five line numbers; of lines with one number the last counts."""
    systems = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("first"), (F.col("o_orderkey") % 3 + 5).cast("int").alias("last")
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return slicing.slice_measures(systems, lines, ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey", "l_extendedprice"])


RANGE_SLICE = """WITH s AS (SELECT o_orderkey AS l_orderkey, CAST(o_orderkey % 3 + 1 AS INT) AS first, CAST(o_orderkey % 3 + 5 AS INT) AS last FROM orders),
x AS (SELECT *, CAST(unnest(range(first, last + 1)) AS INT) AS l_linenumber FROM s),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) OVER w AS n_same,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
SELECT x.*, m.r IS NOT NULL AS found, coalesce(n_same, 0) AS n_same, l_partkey, l_suppkey, l_extendedprice
FROM x LEFT JOIN m ON m.l_orderkey = x.l_orderkey AND m.l_linenumber = x.l_linenumber AND m.r = 1"""


def contiguity_check(spark, sf_dir):
    return slicing.contiguity(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey"], "l_linenumber")


CONTIGUITY = """SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n,
  list_sort(list(l_linenumber)) = list_transform(range(min(l_linenumber), max(l_linenumber) + 1), lambda x: CAST(x AS INT)) AS contiguous
FROM lineitem GROUP BY 1"""


def gap_check(spark, sf_dir):
    """A customer's orders are systems of one to three measures."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    systems = o.select("o_custkey", F.col("o_orderkey").alias("system_id"), (F.col("o_orderkey") % 97).alias("first"), (F.col("o_orderkey") % 97 + F.col("o_orderkey") % 3).alias("last"))
    return slicing.gaps(systems, ["o_custkey"])


GAPS = """SELECT * FROM (SELECT o_custkey, o_orderkey AS system_id, o_orderkey % 97 AS first, o_orderkey % 97 + o_orderkey % 3 AS last,
  lag(o_orderkey % 97 + o_orderkey % 3) OVER w AS prev_last, lag(o_orderkey) OVER w AS prev_system FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey % 97, o_orderkey % 97 + o_orderkey % 3, o_orderkey))
WHERE prev_last IS NOT NULL AND first <> prev_last + 1"""


def _attributes(spark, sf_dir):
    """Conversations: a turn's measure has its role and, by length, a key with or without number."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length("text")
    tag = F.when(n % 4 == 0, "divisions").when(n % 4 == 1, "key").otherwise("clef")
    return c.select("conv_id", F.floor(F.col("turn") / 2).alias("measure"), tag.alias("tag"), F.nullif(n % 3, F.lit(0)).alias("number"), F.col("turn").alias("ord"))


def inject_missing(spark, sf_dir):
    """Each measure's attributes after what the measures before it have and it lacks was put in."""
    a = _attributes(spark, sf_dir)
    system = F.col("measure").cast("int") + 1
    sized = a.withColumns({"system": system, "n": F.max(system).over(Window.partitionBy("conv_id"))})
    carried = carry.in_force(sized, ["conv_id"], ["tag", "number"], "system", ["ord"], "ord", "n")
    carried = carried.withColumn("measure", F.col("system").cast("long") - 1).join(a.select("conv_id", "measure").distinct(), ["conv_id", "measure"], "left_semi")
    return carry.inject(a, carried.drop("ord"), ["conv_id", "measure"], ["tag", "number"], "ord")


INJECT = """WITH a AS (
  SELECT conv_id, CAST(floor(turn / 2) AS BIGINT) AS measure, turn AS o, CAST(nullif(length(text) % 3, 0) AS INT) AS number,
         CASE length(text) % 4 WHEN 0 THEN 'divisions' WHEN 1 THEN 'key' ELSE 'clef' END AS tag FROM conversations
), g AS (SELECT b.conv_id, b.measure, a.tag, a.number, min(a.o) AS seen FROM (SELECT DISTINCT conv_id, measure FROM a) b
         JOIN a ON a.conv_id = b.conv_id AND a.measure < b.measure GROUP BY ALL),
put AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = g.conv_id AND a.measure = g.measure AND a.tag = g.tag AND a.number IS NOT DISTINCT FROM g.number)),
own AS (SELECT *, min(CASE WHEN tag = 'divisions' THEN o END) OVER (PARTITION BY conv_id, measure) AS d FROM a),
every AS (SELECT conv_id, measure, tag, number, CASE WHEN o <= d THEN 0 ELSE 2 END AS band, o AS at_, false AS injected FROM own
          UNION ALL SELECT conv_id, measure, tag, number, 1, seen, true FROM put)
SELECT conv_id, measure, tag, number, injected, CAST(row_number() OVER (PARTITION BY conv_id, measure ORDER BY band, at_) AS INT) AS ord FROM every"""

QUERIES = {
    "measure_span": (measure_span, MEASURE_SPAN),
    "effective_timesig_changes": (effective_timesig_changes, TIMESIG),
    "position_join_fallback": (position_join_fallback, POSITION),
    "carry_forward_last": (carry_forward_last, CARRY_LAST),
    "carry_keyed_asof": (carry_keyed_asof, CARRY_ASOF),
    "range_slice_last_wins": (range_slice_last_wins, RANGE_SLICE),
    "contiguity_check": (contiguity_check, CONTIGUITY),
    "gap_check": (gap_check, GAPS),
    "inject_missing": (inject_missing, INJECT),
}
