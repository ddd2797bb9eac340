"""Approximate nearest neighbours with a hash-prefix forest.

Each vector has a long hash string per tree (signs of random projections); a
tree is the sorted array of its strings. A query descends to its longest prefix
match in each tree, by binary search, and all trees then ascend together, one
bit at a time, until the rows under the common prefix length are enough
candidates. Those are ranked by the exact inner product in double precision.

Rows are dealt to shards by a hash of the vector; each shard sorts its own trees
and streams the queries, so memory is bounded by ``SHARD_ROWS``. Equal vectors are
one entry with its smallest ids, which is all that a top list can show. For
inner products of vectors of unequal length, a further component lifts all rows
of a shard to the same length. Defined results: vectors that are null, zero, of
another length than most, or hold null or non-finite components take no part;
rows with the query's own id are not its candidates; a repeated row counts once;
ties go to the smaller id; an empty table has no results; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import keep, tidy

SHARD_ROWS, LEAST_SHARDS = 16384, 6
TREES, BITS = 24, 24
#: Candidates (with repeats over trees) for each query: this share of a shard's rows times the trees, and a floor.
SHARE, LEAST = 0.06, 64
SEED = 11


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, share: float = SHARE, least: int = LEAST):
        self.vectors = vectors.astype(np.float64)
        n, d = vectors.shape
        self.trees, self.bits = trees, bits
        self.enough = min(n, max(least, int(share * n))) * trees
        self.planes = np.random.default_rng(SEED).standard_normal((d + 1, trees * bits))
        square = (self.vectors**2).sum(axis=1)
        lift = np.sqrt(np.maximum(square.max() - square, 0))
        strings = self._strings(np.column_stack([self.vectors, lift]))
        self.rows = np.argsort(strings, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(strings, self.rows.T.astype(np.int64), axis=0).T)

    def _strings(self, x: np.ndarray) -> np.ndarray:
        """One number of ``bits`` bits for each vector and tree."""
        signs = (x @ self.planes > 0).reshape(len(x), self.trees, self.bits)
        return signs @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def search(self, queries: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the indices of its best rows and their inner products.

        More than ``top`` come back where rows tie with the last.
        """
        q = queries.astype(np.float64)
        strings = self._strings(np.column_stack([q, np.zeros(len(q))]))
        level = np.full(len(q), self.bits)  # common prefix length of all trees
        open_ = np.arange(len(q))
        lo, hi = np.zeros((self.trees, len(q)), np.int64), np.zeros((self.trees, len(q)), np.int64)
        while len(open_):
            shift = self.bits - level[open_]
            for t in range(self.trees):
                prefix = strings[open_, t] >> shift
                lo[t, open_] = np.searchsorted(self.sorted[t], prefix << shift, "left")
                hi[t, open_] = np.searchsorted(self.sorted[t], (prefix + 1) << shift, "left")
            short = (hi[:, open_] - lo[:, open_]).sum(axis=0) < self.enough
            open_ = open_[short & (level[open_] > 0)]
            level[open_] -= 1
        out = []
        seen = np.zeros(len(self.vectors), bool)
        for i in range(len(q)):
            for t in range(self.trees):
                seen[self.rows[t, lo[t, i] : hi[t, i]]] = True
            rows = np.flatnonzero(seen)
            seen[rows] = False
            score = self.vectors[rows] @ q[i]
            if len(rows) > top:
                best = score >= np.partition(score, -top)[-top]
                rows, score = rows[best], score[best]
            out.append((rows, score))
        return out


def _usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    v = v.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    return v.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))


def nearest(rows: DataFrame, query: str = "vec_id % 20 = 0", top: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id rank vec_id score``: the ``top`` nearest found for each row that ``query`` (SQL over vec_id) picks."""
    usable = keep(_usable(rows, vec_id, vector))
    # the smallest ids of each vector; the limit holds before the shuffle already
    by_vector = Window.partitionBy("k1", "k2").orderBy("vec_id")
    least = usable.withColumn("r", F.dense_rank().over(by_vector)).where(F.col("r") <= top + 1)
    entries = keep(
        least.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    asked = usable.where(query).select("vec_id", "k1", "k2").distinct()
    wanted = asked.select("k1", "k2").distinct()
    shards = max(LEAST_SHARDS, -(-entries.count() // SHARD_ROWS))
    built = entries.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "k1", "k2", "v", "ids")
    sent = entries.join(wanted, ["k1", "k2"], "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "k1", "k2", "v",
        F.lit(None).cast("array<bigint>").alias("ids"),
    )

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def task(batches):
        shard, parts, ids, forest = None, [], [], None
        for batch in batches:
            where = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (kind[1:] != kind[:-1]), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if where[a] != shard:
                    shard, parts, ids, forest = where[a], [], [], None
                if kind[a] == 0:
                    parts.append(matrix(part.column(4)))
                    ids += part.column(5).to_pylist()
                    continue
                if not parts and forest is None:
                    continue
                if forest is None:
                    forest, parts = Forest(np.concatenate(parts)), []
                found = forest.search(matrix(part.column(4)), top + 1)
                k1, k2, vec, score = [], [], [], []
                for i, (rows_, scores) in enumerate(found):
                    named = sorted((-s, x) for r, s in zip(rows_.tolist(), scores.tolist(), strict=True) for x in ids[r])[: top + 1]
                    k1 += [part.column(2)[i].as_py()] * len(named)
                    k2 += [part.column(3)[i].as_py()] * len(named)
                    vec += [x for _, x in named]
                    score += [-s for s, _ in named]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                    names=["k1", "k2", "vec_id", "score"],
                )

    dealt = built.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(tidy(task), "k1 long, k2 long, vec_id long, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).drop("r")
    told = asked.withColumnRenamed("vec_id", "query_id").join(found, ["k1", "k2"]).where(F.col("vec_id") != F.col("query_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        told.withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20, against all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
