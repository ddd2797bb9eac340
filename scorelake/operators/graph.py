"""Graphs in tables: components, and what follows from what.

``keys`` tell graphs apart; nodes are columns of any type that can be ordered. Each round
of a loop is a join over tables that are kept, and no graph goes through the driver.
Where graphs are many and small, :func:`followed` takes each as a whole; large ones go by joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

from scorelake.sources.tables import materialize

#: Edges up to which a graph is followed by one task.
GATHERED = 50_000


def _are_stars(edges: DataFrame, keys: list[str]) -> bool:
    """Whether each ``u`` has one ``v``, and no ``v`` is a ``u``."""
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low")))).alias("e"))
    nodes = ends.groupBy(*keys, "e.x").agg(F.sum("e.low").alias("below"), F.min("e.low").alias("least"))
    return nodes.where("below > 1 OR (below = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys node root`` of all nodes with an edge ``u v``, root the least of its component.

    Alternating stars: neighbours are hung on the least that a node sees, the
    greater ones first, then the lesser. Minima are aggregated before they are joined back, so
    a node with very many edges is no task's alone; rounds grow with the logarithm of a component.
    """
    edges = materialize(edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    while not _are_stars(edges, keys):
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).where("u != v").distinct())
    roots = edges.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def reached(edges: DataFrame, keys: list[str], starts: DataFrame | None = None) -> DataFrame:
    """``keys node to n``: the nodes that each of ``starts`` (keys, node; default: all) comes to over edges ``up down``, itself included.

    ``n`` is the least number of edges on the way. Semi-naive: a round joins only the pairs that the round before found for the
    first time, so rounds are the longest of the shortest ways and cycles come to an end.
    """
    edges = edges.select(*keys, "up", "down").distinct()
    if starts is None:
        starts = edges.select(*keys, F.explode(F.array("up", "down")).alias("node"))
    new = materialize(starts.select(*keys, "node").distinct().select("*", F.col("node").alias("to"), F.lit(0).alias("n")))
    found, n = new, 0
    while True:
        n += 1
        step = new.join(edges.withColumnRenamed("up", "to"), [*keys, "to"]).select(*keys, "node", F.col("down").alias("to")).distinct()
        new = materialize(step.join(found.select(*keys, "node", "to"), [*keys, "node", "to"], "left_anti").withColumn("n", F.lit(n)))
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def cycles(reach: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys node``: the nodes of ``reached`` that come back to themselves over one edge or more."""
    back = edges.select(*keys, F.col("up").alias("to"), F.col("down").alias("node")).distinct()
    return reach.join(back, [*keys, "node", "to"], "left_semi").select(*keys, "node").distinct()


def _by_rounds(edges: DataFrame, keys: list[str], starts: DataFrame) -> DataFrame:
    """:func:`followed` by joins, for graphs of any size."""
    hit = reached(edges, keys, starts).groupBy(*keys, F.col("to").alias("_to")).agg(F.min(F.struct("n", "node")).alias("_c"))
    found = hit.select(*keys, F.col("_to").alias("node"), F.col("_c.node").alias("because"), F.col("_c.n").alias("n"))
    looped = cycles(reached(edges, keys, found.select(*keys, "node")), edges, keys).withColumn("in_cycle", F.lit(True))
    return found.join(looped, [*keys, "node"], "left").fillna({"in_cycle": False})


def _looped(below: dict) -> set:
    """The nodes of a graph that come back to themselves."""
    degree = dict.fromkeys(below, 0)
    for xs in below.values():
        for x in xs:
            degree[x] += 1
    todo = [x for x, d in degree.items() if not d]
    while todo:  # what no cycle leads to
        x = todo.pop()
        del degree[x]
        for y in below[x]:
            degree[y] -= 1
            if not degree[y]:
                todo.append(y)
    if not degree:
        return set()
    # Tarjan's strong components of the rest, without recursion
    found, index, low, path, on = set(), {}, {}, [], set()
    for root in degree:
        if root in index:
            continue
        work = [(root, iter(below[root]))]
        index[root] = low[root] = len(index)
        path.append(root)
        on.add(root)
        while work:
            x, rest = work[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    path.append(y)
                    on.add(y)
                    work.append((y, iter(below[y])))
                    break
                if y in on:
                    low[x] = min(low[x], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == index[x]:
                    part = []
                    while not part or part[-1] != x:
                        part.append(path.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or x in below[x]:
                        found.update(part)
    return found


def follow(edges, starts) -> list[tuple]:
    """``node because n in_cycle`` of a graph's pairs of nodes, level by level from the starts."""
    below: dict = {}
    for up, down in edges:
        if up is not None:
            below.setdefault(up, set()).add(down)
    found = {x: (x, 0) for x in starts}
    level, n = list(found), 0
    while level:
        n += 1
        step: dict = {}
        for x in level:
            because = found[x][0]
            for y in below.get(x, ()):
                if y not in found and (y not in step or because < step[y]):
                    step[y] = because
        found |= {y: (because, n) for y, because in step.items()}
        level = list(step)
    looped = _looped({x: below.get(x, ()) for x in found})
    return [(x, because, n, x in looped) for x, (because, n) in found.items()]


def followed(edges: DataFrame, keys: list[str], starts: DataFrame) -> DataFrame:
    """``keys node because n in_cycle``: every node that ``starts`` (keys, node) come to over edges ``up down``, themselves included.

    ``n`` edges lie on the way from the nearest start, ``because``, of equally near ones the least.
    ``in_cycle``: the node comes back to itself. A graph of ``GATHERED`` edges or fewer is followed by one task
    and takes no rounds; larger ones, and nodes that aren't whole numbers, texts or dates, go by joins.
    """
    edges = edges.select(*keys, "up", "down")
    kind, ends = starts.schema["node"].dataType, [edges.schema[c].dataType for c in ("up", "down")]
    if not keys or ends != [kind, kind] or not isinstance(kind, (IntegralType, StringType, DateType)):
        return _by_rounds(edges, keys, starts)
    edges = materialize(edges)
    large = materialize(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GATHERED).select(*keys))
    if large.isEmpty():
        few, begun, rest = edges, starts, None
    else:
        few, begun = edges.join(large, keys, "left_anti"), starts.join(large, keys, "left_anti")
        rest = _by_rounds(edges.join(large, keys, "left_semi"), keys, starts.join(large, keys, "left_semi"))
    n = len(keys)
    names = [*keys, "node", "because", "n", "in_cycle"]

    def task(batches):
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                up, down, first = (batch.column(n + k)[i].as_py() or () for k in range(3))
                got = follow(zip(up, down, strict=True), first)
                at += [i] * len(got)
                rows += got
            kinds = (batch.column(n + 2).type.value_type, batch.column(n + 2).type.value_type, pa.int32(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(at, pa.int32())) for j in range(n)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    # absent nodes stay in their lists
    pairs = few.groupBy(*keys).agg(F.collect_list(F.struct("up", "down")).alias("_e"))
    whole = begun.select(*keys, "node").groupBy(*keys).agg(F.collect_list(F.struct("node")).alias("_s")).join(pairs, keys, "left")
    whole = whole.select(*keys, F.col("_e.up").alias("_up"), F.col("_e.down").alias("_down"), F.col("_s.node").alias("_first"))
    own = "".join(f"`{k}` {starts.schema[k].dataType.simpleString()}, " for k in keys)
    found = whole.mapInArrow(task, f"{own}node {kind.simpleString()}, because {kind.simpleString()}, n int, in_cycle boolean")
    return found if rest is None else found.unionByName(rest)
