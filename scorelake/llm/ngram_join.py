"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document is its set of distinct word shingles (64-bit hashes). Two documents
link if 100 * intersection >= 75 * union. Documents with equal sets are one
class and linked at once, so copies never form pairs. Of classes that differ:

1. Candidates share a shingle among the first ``n - ceil(0.75 n) + 1`` of each,
   in one order for all sets: by hash, but shingles that many documents share
   come last. Any order loses no link; this one keeps common passages out.
2. Classes under one shingle are first compared with two leaders (the least and
   the greatest of them), which joins groups of copies without all their pairs.
3. Shingles that still hold several components become tiles: all their classes,
   sorted by size, so that a class meets only the band of sizes that may link;
   large groups are split into pairs of blocks, leaving out what one component
   holds on both sides. Bitmaps of a bit and more a shingle bound each
   overlap from above: a pair differs in as many shingles at least as its parity
   bitmaps differ in bits. A pair is reported under the least shingle it shares.
4. What passes is decided by intersecting the sorted arrays. The class that has more
   pairs sends its array once for a block of partners.

First come the tiles of a few shingles of each class, which report each row's nearest
pair: that joins most of what links. Then all tiles are searched that still hold several
components, and again those that held pairs back, first for some pairs of each two
components, without limit in the end: nothing is capped.
A class has 128 bits: sets that share the first 64 get classes of their own.
Components come from alternating stars over edge tables. No sets, links or
components go through the driver.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; a text of fewer words than a shingle is one shingle; rows that
repeat an id or a text are members of one class; a component's id is the least
document id in it (nulls aside); empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import fresh, keep, row_key, sized_broadcast, text_of, tidy
from scorelake.sources.tables import remove

WORDS, PERCENT = 5, 75
#: A-Z in lower case, white space as spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Bytes of text hashed at a time.
CHUNK = 1 << 18
#: A shingle is common if one of so many classes has it. A task reports those that one in so many of its own classes has,
#: twice at least, so one that stays unreported has fewer rows than tasks and common classes together.
COMMON_SHARE, LOCAL_COMMON = 1000, 2
#: Shingles whose repeats a task counts at a time, beyond which the rarest go.
COUNTED = 1 << 20
#: Rows of a tile's side, partners of one copy of a value.
BLOCK = 2048
PARTNERS = 512
#: Parts of a common shingle's rows.
SALTS = 64
#: Shingles of each class whose tiles are searched first.
FIRST = 3
#: What a tile reports in each round: pairs nearest to each row, or of each two components; None: all.
ROUNDS = ((1, None), (None, 8), (None, 512), (None, None))
#: Shingles of a class that travel along, so that a pair is reported under the least of those it shares; classes with more report again.
LISTED = 24
#: Blocks of eight bytes of a word that are mixed here; longer words are digested whole.
LONG = 8
#: Shingles of a text that is named by 128 bits of each.
FEW = 16


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all of them."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def joined(w: np.ndarray, words: int) -> np.ndarray:
    """The hash of each stretch of so many words, from the words' hashes, one after the other."""
    n = len(w) - words + 1
    h = w[:n]
    for k in range(1, words):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[k : k + n]
    return mixed(h + np.uint64(words))


def word_hashes(text: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of a text's words (places and bytes), mixed block by block of eight bytes; 64 bytes have to follow the text."""
    h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))  # the eight bytes from each place on
    at = np.flatnonzero(size > 0)
    for k in range(0, 8 * LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        block = eight[start[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[at] = mixed((h[at] ^ block) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
    for i in np.flatnonzero(size > 8 * LONG).tolist():
        digest = hashlib.blake2b(memoryview(text)[start[i] : start[i] + size[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = np.uint64(int.from_bytes(digest, "little"))
    return h


class Shingler:
    """Shingle hashes of UTF-8 texts, many texts at a time.

    A word's hash is mixed from its bytes and a shingle's from its words', one after the other and
    not linearly. Sets are compared by 64 bits; a set of few shingles, which differs from others
    in few of them, is named by 128 bits of each.
    """

    def __init__(self, words: int = WORDS):
        self.words = words

    def sets(self, texts: list[bytes]):
        """The sorted distinct hashes of each text and 128 bits that name the set, in order."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            held.append(t.translate(PLAIN))
            size += len(t)
            if size >= CHUNK:
                yield from self._hash(held)
                held, size = [], 0
        yield from self._hash(held)

    def _hash(self, texts: list[bytes]):
        whole = b"\n".join(texts) + b"\n" + b" " * 64
        b = np.frombuffer(whole, np.uint8)
        edges = np.diff(((b != 32) & (b != 10)).astype(np.int8), prepend=0)
        start = np.flatnonzero(edges == 1)
        size = np.flatnonzero(edges == -1) - start
        # words before the end of each text
        upto = np.searchsorted(start, np.flatnonzero(b == 10)).tolist()
        w = word_hashes(whole, start, size, 1)
        full = joined(w, self.words) if len(w) >= self.words else w[:0]
        at = 0
        for end in upto[: len(texts)]:
            n = end - at
            if not n:
                yield np.zeros(0, np.uint64), b""
                continue
            s = full[at : end - self.words + 1] if n >= self.words else joined(w[at:end], n)
            if len(s) > FEW:
                s = np.sort(s)
                s = name = s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                again = joined(word_hashes(whole, start[at:end], size[at:end], 2), min(n, self.words))
                s, name = np.unique(s), np.unique(np.stack([s, again], axis=1), axis=0)
            at = end
            yield s, hashlib.blake2b(name.tobytes(), digest_size=16).digest()


def bitmap(s: np.ndarray, room: int = 1) -> np.ndarray:
    """Parity bitmap: each shingle flips a bit. At least ``room`` bits (a power of two) for each shingle, a power of two in all.

    Two unrelated sets of n then differ in about n / 2 bits, where linked ones differ in 2 n / 7 at most.
    """
    bits = max(64, room << int(len(s) - 1).bit_length())
    at = (s >> np.uint64(20)) & np.uint64(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(b: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set in fewer bytes: its halves are added until it fits."""
    while len(b) > size:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


class Bitmaps:
    """Signatures of sets: bitmaps whose differing bits bound an overlap from above."""

    #: tiled: only tokens that have tiles are listed; a class has very many others.
    percent, listed, tiled = PERCENT, LISTED, True

    def sign(self, s: np.ndarray) -> bytes:
        return bitmap(s).tobytes()

    def keys(self, s: np.ndarray) -> np.ndarray:
        """What is counted to tell which tokens are common."""
        return s

    def stack(self, raw: list[np.ndarray]) -> np.ndarray:
        """Signatures as rows that can be compared, all of the first one's size."""
        size = len(raw[0])
        signs = np.stack([folded(x, size) for x in raw])
        return signs.view(np.uint64) if size % 8 == 0 else signs

    def compare(self, signs: np.ndarray, i: int, j: np.ndarray, n: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether row i (a set of size n) may link with the rows j (sizes m), and how far they are."""
        differing = np.bitwise_count(signs[j] ^ signs[i]).sum(axis=1).astype(np.int64)
        return may_link(differing, n, m), differing

    def bound(self, x: bytes, ys: list[bytes]) -> list[bool]:
        """The same for signatures after their sets' sizes in eight bytes."""
        m, x, out = int.from_bytes(x[:8], "big"), np.frombuffer(x, np.uint8)[8:], []
        for y in ys:
            n, y = int.from_bytes(y[:8], "big"), np.frombuffer(y, np.uint8)[8:]
            size = min(len(x), len(y))
            out.append(bool(may_link(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()), m, n)))
        return out


def compatible(a, b, percent: int = PERCENT):
    """Whether sets of sizes a and b may link at all."""
    small, large = F.least(a, b), F.greatest(a, b)
    return small * 100 >= large * percent


def _binary(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [x or b"" for x in batch.column(i).cast(pa.binary()).to_pylist()]


def digests(d: bytes) -> tuple[int, int]:
    """The two halves of a set's name: its class, and what tells sets of one class apart."""
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Namer:
    """The class of a set; sets whose first 64 bits are equal have got classes of their own."""

    def __init__(self, renamed: dict[tuple[int, int], int]):
        self.renamed = renamed

    def __call__(self, name: bytes) -> int:
        d = digests(name)
        return self.renamed.get(d, d[0]) if self.renamed else d[0]


def clashes(rows: DataFrame) -> dict[tuple[int, int], int]:
    """New classes for unequal sets of one class; about N^2 / 2^65 of N sets, so few at any size."""
    lo = rows.where("n > 0").groupBy("class").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo != hi")
    found = rows.join(lo.select("class"), "class", "left_semi").select("class", "check").distinct().collect()
    again = lambda r: hashlib.blake2b(f"{r['class']} {r['check']}".encode(), digest_size=8).digest()
    return {(r["class"], r["check"]): int.from_bytes(again(r), "little", signed=True) for r in found}


class Repeats:
    """How many of a task's sets hold each shingle that more than one of them holds, within bounded memory."""

    def __init__(self):
        self.token, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.part: list[np.ndarray] = []
        self.held, self.lost = 0, 0

    def add(self, s: np.ndarray) -> None:
        self.part.append(s)
        self.held += len(s)
        if self.held >= COUNTED:
            self.fold()

    def fold(self) -> None:
        token, n = np.unique(np.concatenate([*self.part, np.zeros(0, np.uint64)]), return_counts=True)
        known = np.isin(token, self.token, assume_unique=True)
        token, n = token[(n > 1) | known], n[(n > 1) | known]
        both, inverse = np.unique(np.concatenate([self.token, token]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([self.n, n]), len(both)).astype(np.int64)
        if len(both) > COUNTED:
            least = int(np.partition(n, len(n) - COUNTED)[len(n) - COUNTED])
            both, n, self.lost = both[n > least], n[n > least], self.lost + least
        self.token, self.n, self.part, self.held = both, n, [], 0

    def often(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        ok = self.n + self.lost >= least
        return self.token[ok], self.n[ok]


def profiles(docs: DataFrame, doc_id: str, text: str, how: Bitmaps) -> tuple[DataFrame, DataFrame]:
    """``doc_id n class check bits`` for each row, and the common tokens ``token n``, from one scan (kept)."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n", "class", "check", "bits", "tokens", "counts"]
    schema = f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, n long, class long, check long, bits binary, tokens array<long>, counts array<long>"

    def task(batches):
        shingler, seen, repeats, out_type = Shingler(), set(), Repeats(), None
        for whole_ in batches:
            for at in range(0, whole_.num_rows, 1000):
                batch = whole_.slice(at, 1000)
                size, out_type = batch.num_rows, batch.schema.field(0).type
                n, cl, check, bits = [], [], [], []
                for s, name in shingler.sets(_binary(batch, 1)):
                    d = digests(name) if len(s) else (0, 0)
                    n.append(len(s)), cl.append(d[0]), check.append(d[1])
                    if len(s) and d not in seen:
                        seen.add(d)
                        bits.append(how.sign(s))
                        repeats.add(how.keys(s))
                    else:
                        bits.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(n, pa.int64()), pa.array(cl, pa.int64()), pa.array(check, pa.int64()), pa.array(bits, pa.binary()),
                        pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.list_(pa.int64())),
                    ],
                    names=names,
                )
        if out_type is not None:
            token, count = repeats.often(max(LOCAL_COMMON, len(seen) // COMMON_SHARE))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, out_type), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), one(token.view(np.int64)), one(count)],
                names=names,
            )

    table = keep(whole.mapInArrow(tidy(task), schema))
    common = table.where("n = -1").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    return (
        table.where("n >= 0").select("doc_id", "n", "class", "check", "bits"),
        common.groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.counts").alias("n")),
    )


def prefixes(docs: DataFrame, text: str, common: list[int], renamed: dict) -> DataFrame:
    """``token often class n``: the prefix of each class in each task."""
    last = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(common, np.int64).view(np.uint64)))

    def task(batches):
        shingler, seen, late, name = Shingler(), set(), last.value, Namer(renamed)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                tokens, often, cl, size = [], [], [], []
                for s, d in shingler.sets(_binary(whole.slice(at, 1000), 0)):
                    if not len(s) or (c := name(d)) in seen:
                        continue
                    seen.add(c)
                    n = len(s)
                    p = n - -(-PERCENT * n // 100) + 1
                    if len(late):
                        is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                        s = np.concatenate([s[~is_late], s[is_late]])
                        often.append(np.arange(p) >= n - int(is_late.sum()))
                    else:
                        often.append(np.zeros(p, bool))
                    tokens.append(s[:p])
                    cl.append(np.full(p, c, np.int64))
                    size.append(np.full(p, n, np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(often)), pa.array(np.concatenate(cl)), pa.array(np.concatenate(size))],
                        names=["token", "often", "class", "n"],
                    )

    return docs.select(text).mapInArrow(tidy(task), "token long, often boolean, class long, n long")


def compared(pairs: DataFrame, values: DataFrame, decide) -> DataFrame:
    """Of the distinct pairs ``a b`` those for which ``decide(x, ys)`` holds on their ``values`` (class, value).

    The class with more pairs sends its value once for ``PARTNERS`` partners, which
    are dealt over tasks, so no class gathers in one and none is copied for each pair.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("k"))
    sized = pairs.select("a", "b")
    for end in ("a", "b"):
        sized = sized.join(ends.select(F.col("class").alias(end), F.col("k").alias(f"k{end}")), end)
    swap = F.col("ka") < F.col("kb")
    hub, other = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    block = F.pmod(F.xxhash64(other), F.ceil(F.greatest("ka", "kb") / PARTNERS)).cast("int")
    sized = sized.select(hub.alias("hub"), other.alias("other"), block.alias("block"))
    own = sized.groupBy("hub", "block").agg(F.lit(None).cast("long").alias("other")).join(values, F.col("hub") == F.col("class"))
    rest = sized.join(values, F.col("other") == F.col("class"))
    columns = ["hub", "block", "other", "value"]
    dealt = own.select(*columns).unionByName(rest.select(*columns)).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("other").asc_nulls_first())

    def task(batches):
        at, x = None, None
        for batch in batches:
            hub, block, other = (batch.column(i).to_pylist() for i in range(3))
            value = batch.column(3)
            a, b, start = [], [], 0
            for i in range(batch.num_rows + 1):
                if i < batch.num_rows and other[i] is not None:
                    continue
                if i > start:  # partners of the value before
                    ok = decide(x, value.slice(start, i - start).to_pylist())
                    a += [at] * sum(ok)
                    b += [o for o, good in zip(other[start:i], ok, strict=True) if good]
                if i < batch.num_rows:
                    at, x = hub[i], value[i].as_py()
                start = i + 1
            if a:
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.mapInArrow(tidy(task), "a long, b long")


def _intersect(x: bytes, ys: list[bytes], percent: int = PERCENT) -> list[bool]:
    """Whether sorted arrays link, by their intersection."""
    x, out = np.frombuffer(x, np.uint64), []
    for y in ys:
        y = np.frombuffer(y, np.uint64)
        small, large = (x, y) if len(x) < len(y) else (y, x)
        common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        out.append(100 * common >= percent * (len(x) + len(y) - common))
    return out


def exact(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, classes: DataFrame, renamed: dict, percent: int = PERCENT) -> DataFrame:
    """Of ``a b`` those that link (kept), by the sorted arrays of their shingles."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    chosen = keep(classes.join(wanted, "class", "left_semi").select("class", F.col("rep").alias("_rep")))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    texts = texts.join(sized_broadcast(chosen.select("_rep").distinct()), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")

    def task(batches):
        shingler, name, seen = Shingler(), Namer(renamed), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                found = {c: s for s, d in shingler.sets(_binary(whole.slice(at, 500), 0)) if len(s) and (c := name(d)) not in seen}
                seen.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], names=["class", "value"])

    # a repeated id brings texts of other classes along, a repeated row its class twice
    sets = keep(texts.mapInArrow(tidy(task), "class long, value binary").join(chosen.select("class"), "class", "left_semi"))
    found = keep(compared(pairs, sets, partial(_intersect, percent=percent)).distinct())
    remove(sets, chosen)
    return found


def bounded(pairs: DataFrame, classes: DataFrame, how: Bitmaps) -> DataFrame:
    """Of ``a b`` those that their signatures allow to link."""
    size = F.unhex(F.lpad(F.hex("n"), 16, "0"))
    return compared(pairs, classes.select("class", F.concat(size, F.col("bits")).alias("value")), how.bound)


def may_link(differing, m, n, percent: int = PERCENT):
    """A pair's overlap is at most (m + n - differing bits) / 2."""
    most = (m + n - differing) // 2
    return 100 * most >= percent * (m + n - most)


def are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v``, and no ``v`` is a ``u``: then every ``v`` is the least of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.low").alias("below"), F.min("e.low").alias("least"))
    return nodes.where("below > 1 OR (below = 1 AND least = 0)").isEmpty()


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` with more links: those are followed between the roots alone, the rest is renamed."""
    of = comps.select(F.col("class").alias("_class"), F.col("root").alias("_root"))
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(of, F.col(end) == F.col("_class"), "left").withColumn(end, F.coalesce("_root", end)).select("a", "b")
    roots = keep(components(ends))
    moved = comps.join(roots.select(F.col("class").alias("root"), F.col("root").alias("to")), "root", "left")
    fresh = roots.join(comps.select("class"), "class", "left_anti").select("class", "root")
    return moved.select("class", F.coalesce("to", "root").alias("root")).unionByName(fresh)


def components(links: DataFrame) -> DataFrame:
    """``class root`` of all linked classes, root the least of its component: alternating stars.

    Minima are aggregated before they are joined back, so a class with very many
    links is no task's alone.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not are_stars(edges):
        # large star: the greater neighbours of u get the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large)
        # small star: u and its lesser neighbours get the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    return edges.select(F.col("u").alias("class"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("class"), F.col("v").alias("root")).distinct()
    )


def among_first(keys: np.ndarray, n: int) -> np.ndarray:
    """Marks the first n occurrences of each key."""
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    rank = np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))
    out = np.zeros(len(keys), bool)
    out[order] = rank < n
    return out


def earlier(lists: list) -> np.ndarray | None:
    """Bits for the shingles of each row's list that another row has too; None where there are none."""
    row = np.repeat(np.arange(len(lists)), [len(x) if x is not None else 0 for x in lists])
    if not len(row):
        return None
    _, at, n = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists if x is not None]), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    shared = n[at] > 1
    if not shared.any():
        return None
    out = np.zeros((len(lists), int(column[-1]) // 64 + 1), np.uint64)
    c = column[at[shared]]
    np.bitwise_or.at(out, (row[shared], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
    return out


def tile_pairs(n: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: list[bytes], lists: list, near: int | None, most: int | None, how: Bitmaps):
    """Pairs (i, j) of one tile that may link and stand in two components; whether any were held back.

    side: rows of side 0 and 1 meet those of the other only, rows of side 2 all.
    lists: shingles before this one; a pair that shares one of them is another tile's.
    near: only what is among the nearest so many of either row; most: only so many
    of each two components, the nearest first.
    """
    order = np.argsort(n, kind="stable")
    raw = [np.frombuffer(bits[i], np.uint8) for i in order]
    n_, comp_, side_ = n[order], comp[order], side[order]
    before = earlier([lists[i] for i in order])
    found: list[tuple] = []
    a = 0
    while a < len(order) - 1:
        # a band: the rows of one signature size, against all up to the largest that may link
        size = len(raw[a])
        z = a
        while z < len(order) and len(raw[z]) == size:
            z += 1
        end = int(np.searchsorted(n_, n_[z - 1] * 100 // how.percent, "right"))
        signs = how.stack(raw[a:end])
        for i in range(a, z):
            stop = int(np.searchsorted(n_, n_[i] * 100 // how.percent, "right"))
            if stop <= i + 1:
                continue
            j = np.arange(i + 1, stop)
            j = j[(comp_[j] != comp_[i]) & ((side_[j] != side_[i]) | (side_[i] == 2))]
            if not len(j):
                continue
            ok, differing = how.compare(signs, i - a, j - a, n_[i], n_[j])
            if before is not None and ok.any():
                ok[ok] = ~(before[j[ok]] & before[i]).any(axis=1)
            if ok.any():
                found.append((np.full(int(ok.sum()), i), j[ok], differing[ok]))
        a = z
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, False
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    nearest = np.argsort(d, kind="stable")
    i, j = i[nearest], j[nearest]
    kept = np.ones(len(i), bool)
    if near is not None:
        kept = among_first(i, near) | among_first(j, near)
    elif most is not None:
        _, c = np.unique(comp_, return_inverse=True)
        kept = among_first(np.minimum(c[i], c[j]) * len(c) + np.maximum(c[i], c[j]), most)
    return order[i[kept]], order[j[kept]], not kept.all()


def tiles(shared: DataFrame, comps: DataFrame, classes: DataFrame, near: int | None, most: int | None, how: Bitmaps) -> DataFrame:
    """``a b``: pairs of classes in two components that tiles let pass; b is null where the tiles of shingle a held some back."""
    rows = shared.join(comps, "class", "left").select("token", "class", "n", F.coalesce("root", "class").alias("comp"))
    by_comp = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    groups = by_comp.groupBy("token").agg(
        F.count(F.lit(1)).alias("comps"), F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top")
    )
    # two leaders have met all others: of three classes all pairs are decided
    groups = groups.where("comps > 1 AND m > 3").select(
        "token", F.col("m"), F.col("top.comp").alias("giant"),
        F.ceil((F.col("m") - F.col("top.m")) / BLOCK).cast("int").alias("rest_blocks"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("giant_blocks"),
    )
    rows = rows.join(groups, "token")
    # what shares a token that has no tile is one component or has been decided, so all tokens of a class may be listed
    lists = (rows if how.tiled else shared).groupBy("class").agg(F.when(F.count(F.lit(1)) <= how.listed, F.collect_list("token")).alias("tokens"))
    is_giant = F.col("comp") == F.col("giant")
    block = lambda of: F.pmod(F.xxhash64("class"), F.col(of)).cast("int")
    upto = lambda a, b: F.when(F.lit(a) < F.lit(b), F.sequence(F.lit(a), F.lit(b) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    rows = rows.withColumn("own", F.when(is_giant, block("giant_blocks")).otherwise(block("rest_blocks")))
    own, zero = F.col("own"), F.lit(0)
    # a block meets itself in one tile and each other block in one; the blocks of the largest component meet the rest alone
    where = (
        F.when(F.col("m") <= BLOCK, F.array(tile(0, zero, zero, 2)))
        .when(is_giant, F.transform(upto(zero, F.col("rest_blocks")), lambda i: tile(2, i, own, 1)))
        .otherwise(
            F.concat(
                F.array(tile(1, own, own, 2)),
                F.transform(upto(zero, own), lambda i: tile(1, i, own, 1)),
                F.transform(upto(own + 1, F.col("rest_blocks")), lambda j: tile(1, own, j, 0)),
                F.transform(upto(zero, F.col("giant_blocks")), lambda j: tile(2, own, j, 0)),
            )
        )
    )
    rows = rows.select("token", "class", "n", "comp", F.explode(where).alias("t")).select("token", "t.kind", "t.i", "t.j", "t.side", "class", "n", "comp")
    rows = rows.join(classes.select("class", "bits"), "class").join(lists, "class")
    key = ["token", "kind", "i", "j"]
    before = F.filter("tokens", lambda x: x < F.col("token")).alias("before")
    rows = rows.select(*key, "side", "class", "n", "comp", "bits", before).repartition(*key).sortWithinPartitions(*key)

    def search(t: pa.Table):
        cl, comp = t.column("class").to_numpy(), t.column("comp").to_numpy()
        if len(cl) < 2 or (comp == comp[0]).all():
            return None
        i, j, held = tile_pairs(t.column("n").to_numpy(), comp, t.column("side").to_numpy(), t.column("bits").to_pylist(), t.column("before").to_pylist(), near, most, how)
        if not len(i):
            return None
        a, b = pa.array(np.minimum(cl[i], cl[j])), pa.array(np.maximum(cl[i], cl[j]))
        if held:
            a = pa.concat_arrays([a, pa.array([t.column("token")[0].as_py()], pa.int64())])
            b = pa.concat_arrays([b, pa.nulls(1, pa.int64())])
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    def task(batches):
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            new = np.zeros(t.num_rows - 1, bool)
            for k in key:
                x = t.column(k).to_numpy()
                new |= x[1:] != x[:-1]
            edges = np.concatenate(([0], np.flatnonzero(new) + 1))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (got := search(t.slice(x, y - x))) is not None:
                    yield got
            rest = t.slice(int(edges[-1]))
        if rest is not None and (got := search(rest)) is not None:
            yield got

    return rows.mapInArrow(tidy(task), "a long, b long").distinct()


def shared_shingles(each: DataFrame) -> DataFrame:
    """``token class n lo hi`` (kept) of the shingles that two classes or more have in their prefixes; lo and hi are two leaders.

    The shingles of one passage have the same classes: one of them stands for all.
    One exchange serves distinct rows, leaders and digests alike: shingles that aren't
    common have few rows, and the common ones are dealt by their classes as well.
    """
    told = ["lo", "hi", "m", "h1", "h2"]
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("class"), F.lit(SALTS))).otherwise(-1).cast("int")
    rows = each.withColumn("salt", salt).repartition("token", "salt").dropDuplicates(["token", "salt", "class"])
    part = Window.partitionBy("token", "salt")
    rows = rows.select(
        "token", "salt", "class", "n", F.min("class").over(part).alias("lo"), F.max("class").over(part).alias("hi"), F.count(F.lit(1)).over(part).alias("m"),
        F.bit_xor(F.xxhash64("class")).over(part).alias("h1"), F.bit_xor(F.xxhash64(F.lit("set"), "class")).over(part).alias("h2"),
    )
    rows = keep(rows.where("lo != hi OR salt >= 0"))
    hot = rows.where("salt >= 0")
    whole = hot.where("class = lo").groupBy("token").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")
    )
    hot = hot.drop(*told).join(whole.where("lo != hi"), "token")
    rows = rows.where("salt < 0").select("token", "class", "n", *told).unionByName(hot.select("token", "class", "n", *told))
    lead = rows.where("class = lo").groupBy("m", "h1", "h2").agg(F.min("token").alias("token"))
    return keep(rows.select("token", "class", "n", "lo", "hi").join(lead.select("token"), "token", "left_semi"))


def named(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """The rows of :func:`profiles` with their final classes, the classes ``class rep n bits`` (kept), and what was renamed."""
    renamed = clashes(rows)
    if renamed:
        names = F.create_map(*(F.lit(x) for (c, k), to in renamed.items() for x in (f"{c} {k}", to)))
        rows = rows.withColumn("class", F.coalesce(F.try_element_at(names, F.concat_ws(" ", "class", "check")), "class"))
    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    return rows, keep(classes), renamed


def common_tokens(counted: DataFrame, classes: DataFrame) -> list[int]:
    """Tokens of very many classes: at most ``COMMON_SHARE`` times the mean number that a class has."""
    often = counted.where(F.col("n") >= F.lit(max(LOCAL_COMMON, classes.count() // COMMON_SHARE)))
    return [r["token"] for r in often.select("token").collect()]


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id n_shingles class component_id`` for each row."""
    how = Bitmaps()
    rows, counted = profiles(docs, doc_id, text, how)
    rows, classes, renamed = named(rows)
    shared = shared_shingles(prefixes(docs, text, common_tokens(counted, classes), renamed))
    return grouped(docs, doc_id, text, rows, classes, shared, lambda comps: shared.select("token", "class", "n"), renamed, how)


def grouped(docs: DataFrame, doc_id: str, text: str, rows: DataFrame, classes: DataFrame, leaders: DataFrame, rest, renamed: dict, how: Bitmaps) -> DataFrame:
    """The result of a join: components of the classes that tokens bring together and whose sets link.

    ``leaders``: class, lo, hi, which are compared first. ``rest`` makes of the components that follow
    the rows ``token class n`` that are still to be searched.
    """
    led = leaders.select("class", F.explode(F.array("lo", "hi")).alias("l")).where(F.col("class") != F.col("l"))
    led = led.select(F.least("class", "l").alias("a"), F.greatest("class", "l").alias("b")).distinct()
    sizes = classes.select("class", "n")
    for end in ("a", "b"):
        led = led.join(sizes.select(F.col("class").alias(end), F.col("n").alias(f"n{end}")), end)
    tested = keep(bounded(led.where(compatible(F.col("na"), F.col("nb"), how.percent)).select("a", "b"), classes, how))
    comps = keep(components(exact(tested, docs, doc_id, text, classes, renamed, how.percent)))
    shared = rest(comps)
    first = shared.groupBy("class", "n").agg(F.slice(F.array_sort(F.collect_list("token")), 1, FIRST).alias("ts"))
    searched = first.select(F.explode("ts").alias("token"), "class", "n")
    for k, (near, most) in enumerate(ROUNDS):
        passed = keep(tiles(searched, comps, classes, near, most, how))
        new = keep(passed.where("b IS NOT NULL").join(tested, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            more = exact(new, docs, doc_id, text, classes, renamed, how.percent)
            tested = tested.unionByName(new)
            if not more.isEmpty():
                comps = keep(merged(comps, more))
        if k == 0:
            searched = shared
            continue
        held = passed.where("b IS NULL").select(F.col("a").alias("token"))
        if held.isEmpty():
            break
        searched = searched.join(held, "token", "left_semi")

    of_class = classes.join(comps, "class", "left").select("class", "rep", F.coalesce("root", "class").alias("root"))
    roots = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(roots, "root").select("class", "component_id")
    full = rows.where("n > 0").join(of_class, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), "class", "component_id")
    bare = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "class", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", joined=join) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id (rows without shingles all stay)."""
    own_id, key = fresh(docs, "_id", "_key")
    named = [c.alias(n) for c, n in zip(row_key(doc_id, text), (own_id, key), strict=True)]
    keyed = docs.select("*", *named)
    # the join reads rows under their keys, so that rows with one id but two texts stay apart
    found = keep(joined(docs.select(F.struct(*(c.alias(n) for c, n in zip(row_key(doc_id, text), ("_id", "_key"), strict=True))).alias("_row"), F.col(text).alias("_text")), "_row", "_text"))
    gone = found.where("n_shingles > 0 AND doc_id != component_id").select(F.col("doc_id._id").alias(own_id), F.col("doc_id._key").alias(key)).distinct()
    gone = sized_broadcast(keep(gone))
    stay = keyed.join(gone, (keyed[key] == gone[key]) & keyed[own_id].eqNullSafe(gone[own_id]), "left_anti")
    again = found.where("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():  # a row that stays stands there more than once
        bare = F.trim(F.regexp_replace(text_of(text), r"[\x09-\x0D]", " ")) == ""
        stay = stay.where(~bare).dropDuplicates([own_id, key]).unionByName(stay.where(bare))
    return stay.drop(own_id, key)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents with the size of their sets and their components."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + {WORDS - 1}], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
