"""Bundles over the driver's tables: customers are bundles, orders their files and stages, events their log."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import artifacts, bundles, catalogues
from scorelake.plans.document_queries import _D, _N


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("k"), "o_orderdate", "o_orderstatus")


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("bundle"), "c_name", "c_acctbal")


def source_choice(spark, sf_dir):
    """Every customer has a file for each order, the first of which is exported; every fourth customer gives one."""
    o = _orders(spark, sf_dir).withColumn("path", F.concat(F.lit("m/"), F.col("k").cast("string"), F.lit(".xml")))
    two = bundles.picks(o.withColumn("ord", F.struct("o_orderdate", "k")), ["bundle"])
    n = F.col("bundle")
    given = _customers(spark, sf_dir).where(n % 4 == 0).select("bundle", F.concat("c_name", F.element_at(F.array(*map(F.lit, (".xml", ".XML", ".mxl"))), (n % 3 + 1).cast("int"))).alias("path"))
    chosen = bundles.chosen_sources(two.select("bundle", F.col("first").alias("path")), given, ["bundle"])
    return chosen.join(two, "bundle", "left").select("*", bundles.source_problem(F.col("path"), n % 5 != 0, [".xml"]).alias("problem"))


CHOICE = """WITH two AS (SELECT o_custkey AS bundle, min('m/' || o_orderkey || '.xml') AS least, arg_min('m/' || o_orderkey || '.xml', (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1),
given AS (SELECT c_custkey AS bundle, c_name || ['.xml', '.XML', '.mxl'][c_custkey % 3 + 1] AS path FROM customer WHERE c_custkey % 4 = 0)
SELECT *, CASE WHEN bundle % 5 = 0 THEN 'missing' WHEN lower(path) NOT LIKE '%.xml' THEN 'format' END AS problem FROM (
  SELECT coalesce(given.bundle, two.bundle) AS bundle, coalesce(given.path, two.first) AS path, given.path IS NOT NULL AS is_given, least, first
  FROM two FULL JOIN given ON two.bundle = given.bundle)"""


def _recorded(spark, sf_dir):
    """Each order completes a stage of its customer's bundle, with a file; open orders leave none."""
    stage = F.get(F.array(*map(F.lit, artifacts.STAGES)), (F.col("k") % len(artifacts.STAGES)).cast("int"))
    path = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("f/"), F.col("k").cast("string")))
    return _orders(spark, sf_dir).groupBy("bundle", stage.alias("stage")).agg(F.collect_set(path).alias("outputs"))


def forced_stage(spark, sf_dir):
    """What exists once a given source has undone the music stage of every third bundle."""
    recorded = _recorded(spark, sf_dir)
    existing = recorded.select("bundle", F.explode("outputs").alias("path"))
    return bundles.after_forcing(existing, recorded, _customers(spark, sf_dir).where(F.col("bundle") % 3 == 0), ["bundle"])


FORCED = f"""SELECT o_custkey AS bundle, 'f/' || o_orderkey AS path FROM orders
WHERE o_orderstatus <> 'O' AND NOT (o_custkey % 3 = 0 AND o_orderkey % 12 = {list(artifacts.STAGES).index('musicxml')} AND o_custkey IN (SELECT c_custkey FROM customer))"""


def incomplete_stages(spark, sf_dir):
    """The stages of all bundles with what they read that no order has completed."""
    edges = [(d, s) for s, deps in artifacts.STAGES.items() for d in deps]
    graph = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(d).alias("dep")) for d, s in edges))).alias("e")
    wanted = _customers(spark, sf_dir).select("bundle", graph).select("bundle", "e.*")
    return artifacts.incomplete(_recorded(spark, sf_dir), wanted, ["bundle"])


INCOMPLETE = f"""WITH n(names) AS (SELECT [{_N}]), edges(dep, stage) AS (VALUES {_D}),
done AS (SELECT DISTINCT o_custkey AS bundle, names[o_orderkey % 12 + 1] AS dep FROM orders, n WHERE o_orderstatus <> 'O')
SELECT c_custkey AS bundle, stage, dep FROM customer, edges WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.bundle = c_custkey AND done.dep = edges.dep)"""


def history_append(spark, sf_dir):
    """Events are a user's log, purchases come later and are added to it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    later = F.col("event_type") == "purchase"
    logged = lambda rows: rows.withColumn("event", bundles.completed(F.col("event_type")))
    empty = spark.createDataFrame([], "user_id long, seq long")
    log = bundles.appended(empty, logged(e.where(~later)), ["user_id"], ["ts", "event_id"])
    return log.unionByName(bundles.appended(log, logged(e.where(later)), ["user_id"], ["ts", "event_id"]))


HISTORY = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase', ts, event_id) - 1 AS seq, 'stage-' || event_type || '-completed' AS event, ts FROM events
WHERE event_type IS NOT NULL"""


def catalogue_json(spark, sf_dir):
    """Customers as catalogues: written as JSON, read back, and written once more, which must change nothing."""
    n, name = F.col("bundle"), F.col("c_name")
    made = _customers(spark, sf_dir).select(
        "bundle", F.array(F.lit("new"), name).alias("command"), F.concat(F.lit("/w/"), n.cast("string")).alias("working_directory"),
        F.struct(F.concat(F.lit("/in/"), name).alias("absolute"), F.concat(F.lit("../in/"), name).alias("relative"), F.when(n % 2 == 0, F.array(F.lit(1), (n % 9 + 1).cast("int"))).alias("page_range")).alias("input"),
        F.array(F.struct(F.lit("created").alias("event"), F.lit("2024-01-01T00:00:00+00:00").alias("timestamp"))).alias("history"),
        F.create_map(F.lit("pages"), F.struct(F.lit("Pages").alias("description"), F.array(F.concat(F.lit("p/"), n.cast("string"))).alias("outputs"), F.create_map(F.lit("a"), F.sha2(name.cast("binary"), 256)).alias("source_checksums"))).alias("stages"),
    )
    read = bundles.from_json(bundles.to_json(made, ["bundle"]), ["bundle"])
    return bundles.to_json(read, ["bundle"]).join(read.select("bundle", F.get("input.page_range", F.lit(1)).alias("last_page"), F.col("stages")["pages"]["outputs"][0].alias("output")), "bundle")


CATALOGUE = """SELECT c_custkey AS bundle, '{"command":["new","' || c_name || '"],"working_directory":"/w/' || c_custkey || '","input":{"absolute":"/in/' || c_name || '","relative":"../in/' || c_name || '"'
  || CASE WHEN c_custkey % 2 = 0 THEN ',"page_range":[1,' || (c_custkey % 9 + 1) || ']' ELSE '' END || '},"history":[{"event":"created","timestamp":"2024-01-01T00:00:00+00:00"}],"stages":{"pages":{"description":"Pages","outputs":["p/'
  || c_custkey || '"],"source_checksums":{"a":"' || sha256(c_name) || '"}}}}' AS json, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 + 1 END AS INT) AS last_page, 'p/' || c_custkey AS output FROM customer"""


def page_selection(spark, sf_dir):
    """Lines are the pages of orders: those from 2 to 4 that were read without an error (returned ones were not)."""
    pages = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("ok"), F.col("l_returnflag").alias("error"))
    chosen = artifacts.pages_between(pages, ["l_orderkey"], "l_linenumber", F.lit(2), F.lit(4))
    return artifacts.succeeded(chosen, F.lit(False)).select("l_orderkey", "l_linenumber", "in_range")


SELECTION = """SELECT l_orderkey, l_linenumber, n >= 4 AS in_range FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
WHERE l_linenumber BETWEEN 2 AND 4 AND l_returnflag <> 'R'"""

def dependency_closure(spark, sf_dir):
    """A customer's orders are stages: each leads to the two of twice its number, every third to the next, and in every tenth bundle the last to the first."""
    o = _orders(spark, sf_dir)
    # a bundle's orders by place, so that a place is looked up without a join
    every = o.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "k")))["k"].alias("all"))
    i, n, k = F.col("i") + 1, F.size("all"), F.col("k")
    to = F.array(2 * i, 2 * i + 1, F.when(k % 3 == 0, i + 1), F.when((F.col("bundle") % 10 == 0) & (i == n), F.lit(1)))
    edges = every.select("bundle", "all", F.posexplode("all").alias("i", "k")).select("bundle", k.alias("dep"), "all", F.explode(to).alias("j"))
    edges = edges.select("bundle", F.get("all", F.col("j") - 1).alias("stage"), "dep").where("stage IS NOT NULL")
    return artifacts.invalidated(o.where("k % 7 = 0").select("bundle", F.col("k").alias("stage")), edges.select("bundle", "stage", "dep"), ["bundle"])


CLOSURE = """WITH RECURSIVE o AS (SELECT o_custkey AS bundle, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
j AS (SELECT bundle, k, unnest([2 * i, 2 * i + 1, CASE WHEN k % 3 = 0 THEN i + 1 END, CASE WHEN bundle % 10 = 0 AND i = n THEN 1 END]) AS j FROM o),
e AS (SELECT DISTINCT j.bundle, j.k AS up, o.k AS down FROM j JOIN o ON o.bundle = j.bundle AND o.i = j.j),
r(bundle, start, stage, n) AS (SELECT bundle, k, k, 0 FROM o WHERE k % 7 = 0 UNION SELECT r.bundle, start, down, r.n + 1 FROM r JOIN e ON e.bundle = r.bundle AND e.up = r.stage WHERE r.n < 25),
c(bundle, start, stage) AS (SELECT bundle, up, down FROM e UNION SELECT c.bundle, start, down FROM c JOIN e ON e.bundle = c.bundle AND e.up = c.stage),
l AS (SELECT DISTINCT bundle, start AS stage FROM c WHERE start = stage)
SELECT bundle, stage, arg_min(start, (n, start)) AS because, CAST(min(n) AS INT) AS distance, bool_or(l.stage IS NOT NULL) AS in_cycle FROM r LEFT JOIN l USING (bundle, stage) GROUP BY ALL"""

def catalogue_changes(spark, sf_dir):
    """Customers' catalogues with keys that no schema knows: read, changed at one to three paths by the customer's number, written."""
    n, of = F.col("bundle"), _customers(spark, sf_dir)
    number = n.cast("string")
    text = F.concat(F.lit('{"note":{"deep":[1,{"n":'), number, F.lit('}]},"stages":{"pages":{"outputs":["p/'), number, F.lit('"],"extra":true}},"command":["new"]}'))
    path = lambda *keys: F.array(*map(F.lit, keys))
    change = lambda when, where, value: of.where(when).select("bundle", where.alias("path"), F.parse_json(value).alias("value"))
    changes = change(n % 3 == 0, path("stages", "pages", "outputs"), F.concat(F.lit('["q/'), number, F.lit('"]')))
    changes = changes.unionByName(change(n % 4 == 0, path("input", "absolute"), F.concat(F.lit('"/in/'), F.col("c_name"), F.lit('"'))))
    changes = changes.unionByName(change(n % 5 == 0, path("note"), F.lit(None).cast("string")))
    read = catalogues.read(of.select("bundle", text.alias("json")), ["bundle"])
    return catalogues.write(catalogues.changed(read, changes, ["bundle"]), ["bundle"])


CHANGES = """SELECT c_custkey AS bundle, '{"command":["new"]' || CASE WHEN c_custkey % 4 = 0 THEN ',"input":{"absolute":"/in/' || c_name || '"}' ELSE '' END
  || CASE WHEN c_custkey % 5 <> 0 THEN ',"note":{"deep":[1,{"n":' || c_custkey || '}]}' ELSE '' END || ',"stages":{"pages":{"extra":true,"outputs":["' || CASE WHEN c_custkey % 3 = 0 THEN 'q/' ELSE 'p/' END || c_custkey || '"]}}}' AS json FROM customer"""

QUERIES = {
    "catalogue_changes": (catalogue_changes, CHANGES),
    "dependency_closure": (dependency_closure, CLOSURE),
    "source_choice": (source_choice, CHOICE),
    "forced_stage": (forced_stage, FORCED),
    "incomplete_stages": (incomplete_stages, INCOMPLETE),
    "history_append": (history_append, HISTORY),
    "catalogue_json": (catalogue_json, CATALOGUE),
    "page_selection": (page_selection, SELECTION),
}
