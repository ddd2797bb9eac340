"""MinHash near-dedup with HyperMinHash registers.

A document's set of word shingles is hashed ``SHUFFLES`` times. Each time the hashes
fall into ``BUCKETS``; of a bucket's least hash the register stores the number of leading
zeros (6 bits) and the ``MANTISSA`` bits after the first one: 16 bits, 256 bytes a set.

1. ``BAND`` registers in a row are a band; sets with an equal band meet. A register is
   equal with a chance of the Jaccard similarity J at least (empty in both
   counts as equal), so of pairs with J = 0.85 one in 10^10 has no equal band.
2. Of two sets that meet, the estimate of J counts equal registers among those that
   one of them fills, less the equal ones that chance makes from different hashes
   (two different least hashes share their leading zeros and mantissa in one of some 6,000
   cases, and the byte of a register that travels in one of 255). Below 0.85 by more than ``SIGMAS`` standard deviations, the pair goes.
   Such a margin lets pairs down to 0.63 pass, which in a group of near copies are most of all its pairs. So parity
   bitmaps of ``ROOM`` bits a shingle travel along, whose differing bits bound an overlap from above: no link is lost
   by them, and what passes is within a few shingles of linking.
3. What is left is verified on the full sets: 100 * intersection >= 85 * union.

Sets that are equal are one class, which has registers once. The classes under a band are
compared with its least and greatest first; bands that still hold several components are
searched in tiles of two blocks, leaving out what one component holds; components come from
alternating stars over tables (``ngram_join``).

Defined results: null, empty and blank texts have no shingles, no registers and are linked
with nothing; a text of fewer words than a shingle is one shingle; rows that repeat an id
or a text are members of one class; a component's id is the least document id in it (nulls
aside); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import keep, tidy
from scorelake.llm.ngram_join import bitmap, common_tokens, folded, grouped, may_link, mixed, named, profiles, representatives, shared_shingles

PERCENT = 85
SHUFFLES, BUCKETS, BAND, MANTISSA = 16, 8, 4, 10
#: Standard deviations by which an estimate may fall short.
SIGMAS = 7.0
#: Bits of a parity bitmap for each shingle, at least.
ROOM = 2
#: Hashes of a set that are shuffled at a time.
CHUNK = 1 << 14


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes; 0 is an empty bucket."""
    seeds = mixed(np.arange(1, SHUFFLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    bits = np.uint64(BUCKETS.bit_length() - 1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(SHUFFLES * BUCKETS, none)
    for a in range(0, len(s), CHUNK):
        h = mixed(s[a : a + CHUNK] ^ seeds)
        at = (h >> (np.uint64(64) - bits)) + np.arange(SHUFFLES, dtype=np.uint64)[:, None] * np.uint64(BUCKETS)
        np.minimum.at(least, at.ravel().astype(np.int64), (h << bits).ravel())
    # as a float, a hash is its leading zeros (exponent) and what follows the first one
    part, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = 64 - exponent.astype(np.int64)
    rest = ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    found = (np.clip(zeros, 0, 62) + 1) << MANTISSA | rest
    return np.where(least == none, 0, found).astype(np.uint16)


def bands(r: np.ndarray) -> np.ndarray:
    """One key for each band that isn't empty throughout."""
    words = r.reshape(-1, BAND).astype(np.uint64)
    key, used = np.zeros(len(words), np.uint64), words.any(axis=1)
    for k in range(BAND):
        key = mixed(key ^ (words[:, k] + np.uint64(k << 32)))
    key = mixed(key ^ (np.arange(len(words), dtype=np.uint64) << np.uint64(40)))
    return key[used]


def chance(n, m):
    """How often buckets with different least hashes get equal registers, for sets of sizes n and m.

    Least hashes fall off as exponentials of rates n and m; a cell of the register
    is 2^-MANTISSA of its power of two wide, 1 / (2 ln 2) of its place on average.
    """
    n, m = np.asarray(n, np.float64), np.asarray(m, np.float64)
    return 2.0**-MANTISSA / (2 * np.log(2)) * n * m / (n + m) ** 2


def short(r: np.ndarray) -> np.ndarray:
    """A byte for each register, 0 for an empty one: what travels to compare sets. Different registers share theirs in one of 255 cases."""
    return np.where(r > 0, 1 + mixed(r.astype(np.uint64)) % np.uint64(255), 0).astype(np.uint8)


def estimate(equal, used, n, m):
    """Jaccard similarity from equal and used registers (:func:`short`), corrected for collisions of both kinds."""
    c = chance(n, m) + 1 / 255
    return (equal / np.maximum(used, 1) - c) / (1 - c)


def least_estimate(used):
    p = PERCENT / 100
    return p - SIGMAS * np.sqrt(p * (1 - p) / np.maximum(used, 1))


class Registers:
    """Signatures of sets: their registers, then their parity bitmaps; once :func:`shortened`, a byte a register."""

    percent, width = PERCENT, SHUFFLES * BUCKETS
    #: A class has few bands, which are all listed: no pair is reported twice, and what tiles read is joined once.
    listed, tiled = SHUFFLES * BUCKETS // BAND, False

    def __init__(self):
        self._last = None, None

    def _of(self, s: np.ndarray) -> np.ndarray:
        if self._last[0] is not s:
            self._last = s, registers(s)
        return self._last[1]

    def sign(self, s: np.ndarray) -> bytes:
        return self._of(s).tobytes() + bitmap(s, ROOM).tobytes()

    def keys(self, s: np.ndarray) -> np.ndarray:
        """What is counted to tell which tokens are common: the bands."""
        return np.unique(bands(self._of(s)))

    def stack(self, raw: list[np.ndarray]) -> np.ndarray:
        """Signatures as rows that can be compared, all of the first one's size."""
        size = len(raw[0]) - self.width
        return np.stack([x if len(x) == self.width + size else np.concatenate([x[: self.width], folded(x[self.width :], size)]) for x in raw])

    def compare(self, signs: np.ndarray, i: int, j: np.ndarray, n: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether row i (a set of size n) may link with the rows j (sizes m), and how far they are."""
        maps = signs[:, self.width :].view(np.uint64)
        differing = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1).astype(np.int64)
        ok = may_link(differing, n, m, self.percent)
        near = np.flatnonzero(ok)
        mine, theirs = signs[i, : self.width], signs[j[near], : self.width]
        used = ((theirs > 0) | (mine > 0)).sum(axis=1)
        equal = ((theirs == mine) & (mine > 0)).sum(axis=1)
        ok[near] = estimate(equal, used, n, m[near]) >= least_estimate(used)
        return ok, differing

    def bound(self, x: bytes, ys: list[bytes]) -> list[bool]:
        """The same for signatures after their sets' sizes in eight bytes."""
        size = lambda y: int.from_bytes(y[:8], "big")
        signs, out = [np.frombuffer(y, np.uint8)[8:] for y in (x, *ys)], np.zeros(len(ys), bool)
        at = np.array([len(s) for s in signs[1:]])
        # of two bitmaps the larger is folded
        for least in np.unique(np.minimum(at, len(signs[0]))):
            part = np.flatnonzero(np.minimum(at, len(signs[0])) == least)
            rows = self.stack([np.zeros(least, np.uint8), signs[0], *(signs[1 + k] for k in part)])[1:]
            out[part] = self.compare(rows, 0, np.arange(1, len(rows)), size(x), np.array([size(ys[k]) for k in part]))[0]
        return out.tolist()


def banded(classes: DataFrame, common: list[int]) -> DataFrame:
    """``token often class n``: the bands of each class."""
    held = np.sort(np.array(common, np.int64))
    last = classes.sparkSession.sparkContext.broadcast(held.tobytes())

    def task(batches):
        late = np.frombuffer(last.value, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = [bands(np.frombuffer(x, np.uint16, SHUFFLES * BUCKETS)).view(np.int64) for x in batch.column(2).to_pylist()]
                count = [len(k) for k in keys]
                token = np.concatenate(keys)
                often = np.isin(token, late)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(often), *(pa.array(np.repeat(batch.column(c).to_numpy(), count)) for c in range(2))], names=["token", "often", "class", "n"]
                )

    return classes.select("class", "n", "bits").mapInArrow(tidy(task), "token long, often boolean, class long, n long")


def shortened(classes: DataFrame) -> DataFrame:
    """``classes`` (kept) with their registers shortened."""

    def task(batches):
        long = 2 * SHUFFLES * BUCKETS
        for batch in batches:
            signs = batch.column(3).to_pylist()
            r = short(np.frombuffer(b"".join(x[:long] for x in signs), np.uint16)).reshape(len(signs), -1)
            bits = pa.array([a.tobytes() + x[long:] for a, x in zip(r, signs, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), bits], names=["class", "rep", "n", "bits"])

    rows = classes.select("class", "rep", "n", "bits")
    return keep(rows.mapInArrow(tidy(task), rows.schema))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id n_shingles class component_id`` for each row."""
    how = Registers()
    rows, counted = profiles(docs, doc_id, text, how)
    rows, classes, renamed = named(rows)
    shared = shared_shingles(banded(classes, common_tokens(counted, classes)))
    return grouped(docs, doc_id, text, rows, shortened(classes), shared, lambda comps: shared.select("token", "class", "n"), renamed, how)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id (rows without shingles all stay)."""
    return representatives(docs, doc_id, text, join)


def op13_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with the size of their sets, their components, and whether they stay."""
    found = join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
