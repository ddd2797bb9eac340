"""Benchmark decontamination with an FM-index per training shard.

A shard is what one task holds of the documents at a time. Its words become
integers over the benchmark's vocabulary; a run of such words that is shorter
than every window can't hold one and isn't indexed (exact, as a window has
benchmark words only). Over the rest stands an FM-index: the Burrows-Wheeler
transform in a wavelet matrix, searched backward for all windows at once, with
every ``SAMPLE``-th suffix position kept to locate the occurrences. Occurrences
of all windows merge into removal spans.

Documents aren't shuffled. The benchmark passes the driver in blocks of at most
``BLOCK_BYTES`` of text or one item, as flat arrays of word numbers; each block is one
broadcast and one pass, so neither the driver nor a worker holds two of them.
Defined results: null or wordless texts have no hits; null items are skipped and
a null item id is the empty string; repeated items and rows count as they stand;
empty tables give no hits; extra columns pass through untouched, but those of a
result's name are replaced.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import Shared, keep, text_of, tidy

WINDOW = 10
SAMPLE = 16
BLOCK_BYTES = 32 << 20
#: Bytes of text at which a shard is closed.
SHARD_BYTES = 4 << 20
#: Windows searched, and occurrences located, at a time.
CHUNK = 1 << 16
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased; digits, letters and all beyond ASCII."""
    return text.translate(TABLE).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling. The last symbol is 0 and the only 0."""
    n, k, rank = len(s), 1, s.astype(np.int64)
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[sa[-1]] == n - 1:
            return sa
        k *= 2


class Bits:
    """A bit vector with rank by popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    def __init__(self, s: np.ndarray):
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.depth = max(1, int(s.max()).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=1 << self.depth))))
        self.levels, self.zeros = [], []
        row = bwt
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        kept = sa % SAMPLE == 0
        self.kept, self.positions = Bits(kept), sa[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i of the transform."""
        start = np.zeros_like(i)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.depth - 1 - level)) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def back(self, i: np.ndarray) -> np.ndarray:
        """From each row to the row of the suffix that starts one symbol earlier."""
        symbol, at = np.zeros_like(i), i
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit = bits.get(at).astype(np.int64)
            symbol = symbol * 2 + bit
            ones = bits.rank(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
        return self.before[symbol] + self.rank(symbol, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (one a row, equally long), by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.before[-1])
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j]
            # a symbol beyond the index's depth doesn't occur
            out = c >> self.depth != 0
            c = np.where(out, 0, c)
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            hi = np.where(out, lo, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back to the next kept one."""
        found, steps, at, open_ = np.empty(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(open_):
            here = self.kept.get(at) == 1
            found[open_[here]] = self.positions[self.kept.rank(at[here])] + steps
            at, open_ = at[~here], open_[~here]
            if len(open_):
                at = self.back(at)
            steps += 1
        return found


class Block:
    """Items as word numbers, one after another: a window is a place among them."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names, owner = np.unique(np.array([i for i, _ in items], object), return_inverse=True)
        add = self.vocabulary.setdefault  # 0 ends a shard, 1 parts runs
        words = [np.array([add(x, len(self.vocabulary) + 2) for x in words_of(t)], np.int32) for _, t in items]
        size = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([*words, np.zeros(0, np.int32)])
        start = np.cumsum(size) - size
        #: Places and owners of the windows by length.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        length = np.minimum(size, WINDOW)
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            count = size[own] - n + 1
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            self.windows[n] = (np.repeat(start[own], count) + inner, np.repeat(owner[own], count).astype(np.int32))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(1)), np.int32, len(words))


def blocks_of(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark's items, at most ``BLOCK_BYTES`` of text or one item at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    items, held = [], 0
    for r in rows.toLocalIterator():
        t = r["t"].encode()
        if items and held + len(t) > BLOCK_BYTES:
            yield items
            items, held = [], 0
        items.append((r["i"], t))
        held += len(t)
    yield items


def find(docs: list[np.ndarray], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's documents (word numbers): where each starts among all words, which words are hit, and document and item pairs."""
    size = np.array([len(w) for w in docs], np.int64)
    base = np.cumsum(size + 1) - size - 1  # a gap between documents
    edges = np.zeros(int((size + 1).sum()) + 1, np.int32)
    pairs = np.zeros(0, np.int64)
    if not block.windows:
        return base, edges[:-1] > 0, pairs
    least = min(block.windows)
    whole = np.concatenate([x for w in docs for x in (w, np.ones(1, np.int32))] or [np.zeros(0, np.int32)])
    parts = np.flatnonzero(np.concatenate(([True], whole == 1)))  # runs lie between these
    length = np.diff(parts) - 1
    first, length = parts[:-1][length >= least], length[length >= least]
    if not len(first):
        return base, edges[:-1] > 0, pairs
    run_at = np.cumsum(length + 1) - length - 1
    inner = np.arange(int((length + 1).sum())) - np.repeat(run_at, length + 1)
    text = np.concatenate([whole[np.repeat(first, length + 1) + inner], np.zeros(1, np.int32)])  # each run with what ends it
    index = FMIndex(text.astype(np.int64))
    for n, (places, owners) in block.windows.items():
        for a in range(0, len(places), CHUNK):
            at = places[a : a + CHUNK]
            lo, hi = index.search(block.words[at[:, None] + np.arange(n)].astype(np.int64))
            found = np.flatnonzero(hi > lo)
            upto = np.cumsum(hi[found] - lo[found])
            for z in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):
                k = np.arange(z, min(z + CHUNK, int(upto[-1])))
                which = np.searchsorted(upto, k, "right")
                position = index.locate(hi[found[which]] - (upto[which] - k))
                run = np.searchsorted(run_at, position, "right") - 1
                word = first[run] + position - run_at[run]
                np.add.at(edges, word, 1)
                np.add.at(edges, word + n, -1)
                doc = np.searchsorted(base, word, "right") - 1
                pairs = np.union1d(pairs, doc * len(block.names) + owners[a + found[which]])
    return base, np.cumsum(edges[:-1]) > 0, pairs


def runs_of(hit: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each run of words that are hit."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(base, start, "right") - 1
    return doc, start - base[doc], end - base[doc]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words of those spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


NAMES = ("_n_words", "_spans", "_items")


def annotate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", remove: bool = False,
    carry: list[str] | None = None, names: tuple[str, str, str] = NAMES,
) -> DataFrame:
    """The columns ``carry`` (default: all) plus ``names``: words, spans, items; with ``remove``, text is cut.

    Spans: merged word spans (start, end) of the hits; items: ids, sorted.
    """
    taken = {n.lower() for n in names}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    source = docs.select(*(f"`{c}`" for c in dict.fromkeys([*carry, text])))
    before, held = None, None
    for items in blocks_of(benchmark, item_id, item_text):
        if before is not None:  # another block: what the one before found is kept with the rows
            source = keep(_pass(source, held, text, source.columns, names, before, False))
            held.unpersist()
            before = names
        held = Shared(docs.sparkSession, Block(items))
        before = before or ()
    return _pass(source, held, text, carry, names, before, remove)


def _pass(docs: DataFrame, held, text: str, carry: list[str], names: tuple[str, str, str], before: tuple[str, ...], remove: bool) -> DataFrame:
    """One block's hits, joined to those of the blocks ``before``."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    carry = [c for c in carry if c not in names]
    own = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), span, T.ArrayType(T.StringType())), strict=True)]
    schema = T.StructType([docs.schema[c] for c in carry] + own)
    place, columns = docs.columns.index(text), [docs.columns.index(c) for c in carry]
    past = [docs.columns.index(c) for c in before]

    def lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)

    def done(batches: list[pa.RecordBatch], words: list[np.ndarray], block: Block):
        base, hit, pairs = find(words, block)
        size = np.array([len(w) for w in words], np.int64)
        at = 0
        for batch in batches:
            n = batch.num_rows
            if past:  # the spans of blocks before count as hits
                old = batch.column(past[1])
                doc = np.repeat(np.arange(n), np.diff(old.offsets.to_numpy()))
                flat = old.flatten()
                for k, a, b in zip(doc.tolist(), flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True):
                    hit[base[at + k] + a : base[at + k] + b] = True
            first, last = base[at], base[at + n - 1] + size[at + n - 1]
            doc, start, end = runs_of(hit[first:last], base[at : at + n] - first)
            spans = lists(doc, n, pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
            mine = pairs[(pairs >= at * len(block.names)) & (pairs < (at + n) * len(block.names))] if len(block.names) else pairs
            owner = mine // max(1, len(block.names)) - at
            items = lists(owner, n, pa.array(block.names[mine % max(1, len(block.names))].tolist() if len(mine) else [], pa.string()))
            if past:
                items = pa.array([sorted({*a, *b}) for a, b in zip(items.to_pylist(), batch.column(past[2]).to_pylist(), strict=True)], pa.list_(pa.string()))
            cols = [batch.column(c) for c in columns]
            if remove and len(doc):
                texts = batch.column(place).to_pylist()
                edges = np.searchsorted(doc, np.arange(n + 1))
                for k in np.unique(doc).tolist():
                    own = slice(edges[k], edges[k + 1])
                    texts[k] = cut(texts[k], list(zip(start[own].tolist(), end[own].tolist(), strict=True)))
                new = pa.array(texts, batch.column(place).type)
                cols = [new if c == place else x for c, x in zip(columns, cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size[at : at + n]), spans, items], names=schema.names)
            at += n

    def task(batches):
        block: Block = held.load()
        waiting, words, size = [], [], 0
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = [x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()]
                waiting.append(batch)
                words += [block.numbers(words_of(x)) for x in texts]
                size += sum(map(len, texts))
                if size >= SHARD_BYTES:
                    yield from done(waiting, words, block)
                    waiting, words, size = [], [], 0
        if waiting:
            yield from done(waiting, words, block)

    return docs.mapInArrow(tidy(task), schema)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
win AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i WHERE n > 0)),
at_ AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item FROM at_ JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
