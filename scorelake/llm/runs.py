"""Periodic run detection: harmonic grid and prefix hashes.

A run is a stretch of consecutive words with least period q (words q apart are
identical), at least ``max(shortest, least * q)`` long, that no neighbouring word
extends. In a run of period p any two words p apart agree over at least
``(least - 1) * p`` places, so of the places 0, p, 2p, ... one at least starts a block
of p words that stands there twice in a row. All pairs of a period and such a place
(n log n of n words) are looked at as arrays: equal first words, then equal
hashes of the blocks. For the pairs that are left, how far the agreement goes on
to the right and to the left is found by binary searches over prefix hashes, all pairs
at once. What that gives for one stretch is one run, its least period the run's.
The words of each run are compared in the end; where hashes misled (they are
residues modulo a prime), the pair is followed word by word instead, so results are exact.

A document stays in its task and pairs are made in blocks of ``PAIRS``: memory
is bounded by the longest text. No shuffle.

Defined results: null, empty and blank texts have no words, no runs and an empty
collapsed text; repeated rows are treated alike; an empty table gives an empty one;
extra columns pass through, those with the results' names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import SPACE, columns_of, fresh, text_of, tidy

#: Words of the shortest run, and periods that a run holds at least.
SHORTEST, LEAST = 6, 4
#: Pairs of period and place made at a time.
PAIRS = 1 << 20
#: Bytes of collapsed texts in one batch.
BATCH = 4 << 20
PRIME, BASE = np.uint64((1 << 31) - 1), 1_103_515_245
NAMES = ("n_words", "runs", "collapsed")
RUN = "array<struct<start:long,length:long,period:long>>"


class Prefixes:
    """Hashes of all stretches of a sequence of numbers, from running sums modulo a prime."""

    power = np.ones(1, np.uint64)

    def __init__(self, w: np.ndarray):
        n = len(w)
        if len(Prefixes.power) <= n:
            p, step = Prefixes.power, np.uint64(pow(BASE, len(Prefixes.power), int(PRIME)))
            while len(p) <= n:  # twice as many powers each time
                p, step = np.concatenate([p, p * step % PRIME]), step * step % PRIME
            Prefixes.power = p
        self.power = Prefixes.power
        self.sums = np.zeros(n + 1, np.uint64)
        # scattered numbers, so that neighbouring ones are no neighbours as residues
        x = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        np.cumsum(((x ^ (x >> np.uint64(29))) % PRIME) * self.power[:n] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a and those from b (b >= a) have one hash."""
        x = (self.sums[a + n] + PRIME - self.sums[a]) % PRIME
        y = (self.sums[b + n] + PRIME - self.sums[b]) % PRIME
        return x * self.power[b - a] % PRIME == y


def farthest(ok, most: np.ndarray) -> np.ndarray:
    """For each place the greatest k <= most with ok(places, k), which holds up to some k: binary searches at once."""
    k = np.zeros(len(most), np.int64)
    step = 1 << int(most.max()).bit_length() if len(most) else 0
    while step:
        to = k + step
        at = np.flatnonzero(to <= most)
        at = at[ok(at, to[at])]
        k[at] = to[at]
        step >>= 1
    return k


def grid(n: int, least: int = LEAST):
    """Blocks ``(period, place)``: the multiples of each period after which two more periods fit."""
    p = 1
    while p * least <= n:
        upto = p
        size = 0
        while upto * least <= n and (size == 0 or size + n // upto <= PAIRS):
            size += n // upto
            upto += 1
        period = np.arange(p, upto)
        count = n // period - 1
        first = np.cumsum(count) - count
        every = np.repeat(period, count)
        yield every, (np.arange(len(every)) - np.repeat(first, count)) * every
        p = upto


def agree(w: np.ndarray, a: int, p: int) -> tuple[int, int]:
    """The longest stretch around a in which words p apart are identical, word by word."""
    lo, hi, step = a, a, 64
    while hi + p < len(w):
        end = min(hi + step, len(w) - p)
        bad = np.flatnonzero(w[hi:end] != w[hi + p : end + p])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = end, step * 2
    step = 64
    while lo > 0:
        end = max(0, lo - step)
        bad = np.flatnonzero(w[end:lo] != w[end + p : lo + p])
        if len(bad):
            lo = end + int(bad[-1]) + 1
            break
        lo, step = end, step * 2
    return lo, hi + p


def find(w: np.ndarray, shortest: int = SHORTEST, least: int = LEAST) -> np.ndarray:
    """``start end period`` of the runs of a sequence of numbers, by start, then period."""
    n, found = len(w), []
    if n < max(shortest, least):
        return np.zeros((0, 3), np.int64)
    hashes = None
    for p, a in grid(n, least):
        same = np.flatnonzero(w[a] == w[a + p])
        p, a = p[same], a[same]
        if not len(a):
            continue
        hashes = hashes or Prefixes(w)
        twice = hashes.equal(a, a + p, p)
        p, a = p[twice], a[twice]
        if not len(a):
            continue
        right = farthest(lambda at, k: hashes.equal(a[at], a[at] + p[at], k), n - a - p)  # noqa: B023
        left = farthest(lambda at, k: hashes.equal(a[at] - k, a[at] - k + p[at], k), a)  # noqa: B023
        found.append(np.stack([a - left, a + p + right, p, a], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    c = np.concatenate(found)
    c = c[c[:, 1] - c[:, 0] >= np.maximum(shortest, least * c[:, 2])]
    return verified(w, c[np.lexsort((c[:, 2], c[:, 1], c[:, 0]))], shortest, least)


def verified(w: np.ndarray, c: np.ndarray, shortest: int, least: int) -> np.ndarray:
    """Of candidates ``start end period place`` (sorted by start, end, period) the runs, their words compared."""
    runs: dict[tuple[int, int], int] = {}
    edges = np.flatnonzero(np.concatenate(([True], (c[1:, :3] != c[:-1, :3]).any(axis=1), [True]))) if len(c) else np.zeros(1, np.int64)
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        s, e, p = c[x, :3].tolist()
        if runs.get((s, e), p) < p:
            continue  # a stretch whose least period is known
        true = (w[s : e - p] == w[s + p : e]).all()
        for s, e in {(s, e)} if true else {agree(w, a, p) for a in c[x:y, 3].tolist()}:
            if e - s >= max(shortest, least * p):
                runs[s, e] = min(p, runs.get((s, e), p))
    out = np.array([(s, e, p) for (s, e), p in runs.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def words_of(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words and a number for each, the same for equal words."""
    words, number = text.split(), {}
    return words, np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))


def detect(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """The input's columns plus ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that a run repeats after its first
    period, its words joined by one space.
    """
    carry = [c for c in docs.columns if c.lower() not in NAMES]
    (whole,) = fresh(docs, "_whole")
    source = docs.select(*columns_of(docs, carry), text_of(text).alias(whole))
    long, run = T.LongType(), T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(c, t) for c, t in zip(NAMES, (long, run, T.StringType()), strict=True)])
    names = schema.names

    def made(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        runs = np.concatenate([r for _, r, _ in found])
        offsets = np.concatenate(([0], np.cumsum([len(r) for _, r, _ in found])))
        parts = [pa.array(x) for x in (runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
        left = pa.array([t for _, _, t in found], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n for n, _, _ in found], pa.int64()), lists, left], names=names)

    def task(batches):
        for batch in batches:
            found, first, size = [], 0, 0
            for k, t in enumerate(batch.column(batch.num_columns - 1)):
                words, w = words_of(t.as_buffer().to_pybytes())
                runs = find(w, shortest, least)
                if len(runs):
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(edge, runs[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                found.append((len(w), runs, b" ".join(words)))
                size += len(found[-1][2]) + 16 * len(runs)
                if size >= BATCH:
                    yield made(batch.slice(first, len(found)), found)
                    found, first, size = [], k + 1, 0
            if found:
                yield made(batch.slice(first, len(found)), found)

    return source.mapInArrow(tidy(task), schema)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated words in one document of ten, by the crc32 of the id; a null id counts as an empty one.

    From word ``a`` on such a document says the same ``p`` words again and again.
    """
    h, words, g, a, p = fresh(docs, "_h", "_words", "_g", "_a", "_p")
    hashed = docs.withColumn(h, F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")))
    split = F.filter(F.split(text_of(text), f"[{SPACE}]+"), lambda x: x != "")
    out = hashed.withColumn(words, F.when(F.col(h) % 10 == 0, split)).withColumn(g, F.floor(F.col(h) / 10))
    n = F.size(words)
    out = out.withColumn(a, F.when(n > 0, F.col(g) % n)).withColumn(p, F.lit(1) + F.floor((n - F.col(a)) / (3 + F.col(g) % 8)))
    again = F.transform(words, lambda x, i: F.when(i < F.col(a), x).otherwise(F.get(words, (F.col(a) + (i - F.col(a)) % F.col(p)).cast("int"))))
    return out.withColumn(text, F.when(F.col(a).isNotNull(), F.array_join(again, " ")).otherwise(F.col(text))).select(*columns_of(docs))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, one in ten with planted repeats: their runs, the one with most periods, and what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(planted(docs)).drop("text")
    # more periods first, exactly: length / period compared as products
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda acc, x: F.when(acc.isNull() | (more(x, acc) > 0), x).otherwise(acc),
    )
    row = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(row, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
