"""Quality by supervised subword embeddings.

Hashed word and character n-gram vectors are averaged over a document and a
softmax over the average gives the class; vectors and softmax are trained by
stochastic gradient descent in numpy, on a bounded sample of labelled documents.
As the model is linear after the average, a gram's vector counts in scoring by
its product with the softmax weights alone: a document is scored by adding one
number for each word, which a bounded cache keeps.

Grams: each word itself, its character n-grams of 3 and 4 with its ends marked, and
the same for the word's shape (letters by case, digits, marks); each two words in a
row; a word equal to the one before it adds the gram of a repeat. A step on a
document follows the gradient of its loss; the step on the vectors is divided by the
square length of the document's shares (as normalised least mean squares does), so
that it moves the document's average by as much whether the text is short or long.

Defined results: null and empty texts get the model's bias, and one class or none
gives every row its share; long texts are read whole, a slice of words at a time; a
document with several labels counts once, by their mean (a tie of 0.5 is class 1);
repeated rows score alike; an empty table gives an empty one; extra columns pass
through, one named as the score is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import tidy
from scorelake.llm.labelled import remainder, sample, scored

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Labelled documents of each class that are learned from, bytes of their bags (more are left out of the sample); buckets, width, passes.
MOST, MOST_BYTES, BUCKETS, WIDTH, EPOCHS = 1500, 256 << 20, 1 << 17, 12, 6
#: Words that a cache keeps, words of a text that are counted at a time (fewer, so that a slice fits in an empty cache).
CACHED, SLICE = 300_000, 100_000
#: New words whose grams are hashed at a time.
STEP = 10_000
SHAPE = bytes(
    88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256)
)
REPEAT = zlib.crc32(b"=") % BUCKETS
#: Repeat grams for each repeated word: about as many as a word has grams of its own, so that the mean shows them.
SHOWN = 8


def grams(word: bytes) -> list[int]:
    """Buckets of a word's grams, repeats included."""
    marked = b"<" + word + b">"
    found = [marked]
    found += [marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)]
    shape = b"<" + word.translate(SHAPE) + b">"
    found += [b"s" + shape[i : i + 3] for i in range(len(shape) - 2)]
    return [zlib.crc32(x) % BUCKETS for x in found]


def slices(text: bytes):
    """Words of a whole text a slice at a time, and the word before the slice (none before the first)."""
    words = text.split()
    for i in range(0, len(words), SLICE):
        yield words[i : i + SLICE], words[i - 1 : i] if i else []


def pairs(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Buckets of each two words in a row, and how many of them are one word twice."""
    a, b = hashes[:-1], hashes[1:]
    return (a * np.uint32(0x9E3779B1) + b) % np.uint32(BUCKETS), int(np.count_nonzero(a == b))


def bag(text: bytes, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's grams, and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for words, before in slices(text):
        parts = []
        for w in words:
            g = cache.get(w)
            if g is None:
                if len(cache) >= CACHED:
                    cache.clear()
                g = cache[w] = np.array(grams(w), np.int32)
            parts.append(g)
        two, same = pairs(np.array([zlib.crc32(w) for w in before + words], np.uint32))
        counts += np.bincount(np.concatenate(parts), minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
        counts[REPEAT] += same * SHOWN
    found = np.flatnonzero(counts)
    return found, counts[found]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None, most: int = MOST, doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> dict:
    """The model: a weight for each bucket, and the bias."""
    taken = sample(docs, labels, label, most, allowed, doc_id, text)

    def bags(batches):
        cache: dict = {}
        for batch in batches:
            found = [bag(x or b"", cache) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y"), batch.column("weight"), batch.column("luck"),
                    pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                    pa.array([b.astype("<i4").tobytes() for _, b in found], pa.binary()),
                ],
                names=["y", "weight", "luck", "grams", "counts"],
            )

    rows = taken.mapInArrow(tidy(bags), "y int, weight double, luck long, grams binary, counts binary").orderBy("luck", "grams")
    y, weight, docs_, held = [], [], [], 0
    for r in rows.toLocalIterator():
        held += 12 * len(r["grams"]) // 4
        if docs_ and held > MOST_BYTES:
            break
        c = np.frombuffer(r["counts"], "<i4").astype(np.float64)
        y.append(r["y"])
        weight.append(r["weight"])
        docs_.append((np.frombuffer(r["grams"], "<i4"), c / max(1.0, c.sum())))
    if len(set(y)) < 2:
        return {"weights": None, "share": float(np.mean(y)) if y else 0.0}
    weight = np.array(weight) / np.mean(weight)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    steps, total = 0, EPOCHS * len(docs_)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs_)):
            rate = 0.5 * (1 - steps / total)
            steps += 1
            g, share = docs_[k]
            if not len(g):
                continue
            h = share @ vectors[g]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            d = p * min(weight[k], 5.0) * rate
            step = out @ d
            out -= np.outer(h, d)
            bias -= d
            vectors[g] -= np.outer(share / (share @ share), step)
    weights = vectors @ (out[:, 1] - out[:, 0])
    return {"weights": weights, "bias": float(bias[1] - bias[0])}


def places(n: int, first: bytes = b"") -> np.ndarray:
    """CRC-32 of ``first`` and n bytes as the xor of a row for each byte: a checksum is linear in the bits, but for a constant."""
    none = zlib.crc32(first + bytes(n))
    rows = [[zlib.crc32(first + bytes(k) + bytes([c]) + bytes(n - 1 - k)) ^ none for c in range(256)] for k in range(n)]
    return np.array(rows, np.uint32) ^ np.array([[none if k == 0 else 0] for k in range(n)], np.uint32)


THREE, FOUR, SHAPED = places(3), places(4), places(3, b"s")
SHAPES = np.frombuffer(SHAPE, np.uint8)


def totals(words: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of its grams' weights and their number: what :func:`grams` lists, for many words at a time."""
    marked = [b"<" + w + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    text = np.frombuffer(b"".join(marked) + bytes(3), np.uint8)
    shape = SHAPES[text]

    def weight(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        crc = rows[0][of[: end[-1]]]
        for k in range(1, len(rows)):
            crc = crc ^ rows[k][of[k : k + end[-1]]]
        found = weights[crc % np.uint32(BUCKETS)]
        for k in range(1, len(rows)):  # these would reach beyond the word
            found[end - k] = 0
        return found

    value = weight(THREE, text) + weight(FOUR, text) + weight(SHAPED, shape)
    whole = weights[np.fromiter(map(zlib.crc32, marked), np.uint32, len(marked)) % np.uint32(BUCKETS)]
    return whole + np.add.reduceat(value, end - size), 1 + 2 * (size - 2) + np.maximum(size - 3, 0)


class Known:
    """Words met so far by number, with their hash, the sum of their grams' weights, and the number of those."""

    def __init__(self, model: dict):
        self.weights, self.number = model["weights"], {}
        self.hash, self.total, self.size = np.zeros(CACHED, np.uint32), np.zeros(CACHED), np.zeros(CACHED, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.number)
        if len(self.number) + len(new) > CACHED:
            self.number, new = {}, set(words)
        if new:
            self._add(list(new))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _add(self, new: list[bytes]) -> None:
        for at in range(0, len(new), STEP):
            part, i = new[at : at + STEP], len(self.number)
            self.number.update(zip(part, range(i, i + len(part))))
            self.hash[i : i + len(part)] = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
            self.total[i : i + len(part)], self.size[i : i + len(part)] = totals(part, self.weights)


def add_parts(parts: list, total: np.ndarray, n: np.ndarray, model: dict, known: Known) -> None:
    """Adds to ``total`` and ``n`` the weights and numbers of grams of ``parts``: text, words, whether one of the text before leads them."""
    length = np.array([len(words) for _, words, _ in parts])
    start = np.cumsum(length) - length
    at = known.numbers([w for _, words, _ in parts for w in words])
    value, count, hashes = known.total[at], known.size[at], known.hash[at]
    lead = start[[led for _, _, led in parts]]
    value[lead], count[lead] = 0, 0
    two = (hashes[:-1] * np.uint32(0x9E3779B1) + hashes[1:]) % np.uint32(BUCKETS)
    same = (hashes[:-1] == hashes[1:]) * SHOWN
    more = model["weights"][two] + same * model["weights"][REPEAT]
    inner = np.ones(len(at), bool)
    inner[start] = False  # the first word of a part has none before it
    value[1:] += np.where(inner[1:], more, 0)
    count[1:] += np.where(inner[1:], 1 + same, 0)
    of = np.array([i for i, _, _ in parts])
    np.add.at(total, of, np.add.reduceat(value, start))
    np.add.at(n, of, np.add.reduceat(count, start))


def score_texts(texts: list[bytes], model: dict, known: Known) -> np.ndarray:
    """Softmax of the averaged grams, class 1."""
    if model["weights"] is None:
        return np.full(len(texts), model["share"])
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    parts, held = [], 0
    for i, t in enumerate(texts):
        for words, before in slices(t):
            if parts and held + len(before) + len(words) > SLICE:
                add_parts(parts, total, n, model, known)
                parts, held = [], 0
            parts.append((i, before + words, bool(before)))
            held += len(before) + len(words)
    if parts:
        add_parts(parts, total, n, model, known)
    out = model["bias"] + total / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None, most: int = MOST, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``carry`` (default: all) and the score as ``name``, 0 to 1."""
    return scored(docs, train(docs, labels, label, allowed, most, doc_id, text), score_texts, Known, text, name, carry)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; labels only from rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, labels, "quality", remainder("doc_id", FOLDS) != HELD_OUT, carry=["doc_id"])
    return out.select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
