"""HyperMinHash: registers and estimates against plain forms, joins against all pairs by hand."""

import random

import numpy as np
import pytest

from scorelake.llm import hyperminhash as hmh
from scorelake.llm import ngram_join
from tests.llm import brute


def by_hand(docs, percent=85):
    sets = [brute.shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(docs)}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    docs, passage = [], [f"p{k}" for k in range(30)]
    for _ in range(25):
        n = rng.choice([1, 3, 5, 6, 11, 12, 40, 100, 400])
        base = [f"W{rng.randrange(rng.choice([4, 5000]))}" for _ in range(n)]
        docs += [" ".join(edited(base, rng, rng.randrange(1 + max(1, n // 60)))) for _ in range(rng.choice([1, 2, 8]))]
        if n > 90:
            docs.append(" ".join(base + passage))
            docs.append(" ".join(base[: int(n * rng.uniform(0.84, 0.9))]))
    chain = [f"c{k}" for k in range(300)]
    docs += [" ".join(chain[5 * k : 5 * k + 200]) for k in range(12)]
    rng.shuffle(docs)
    return [(100 + k * 7 % 997, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_join_matches_by_hand(spark, seed, monkeypatch):
    if seed:
        for name, x in {"LOCAL_COMMON": 3, "COMMON_SHARE": 10, "BLOCK": 4, "ROUNDS": ((1, None), (None, 1), (None, None))}.items():
            monkeypatch.setattr(ngram_join, name, x)
    docs = corpus(seed)
    got = hmh.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(docs)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = [(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "One two", 0), (5, "one TWO", 0), (6, text, 1), (6, text, 1), (7, text + " x", 2), (9, text.replace("w3 ", "y "), 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, CLASS int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in hmh.join(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 56, 6), (6, 56, 6), (7, 57, 6), (9, 56, 6 if brute_link(text) else 9)]
    kept = hmh.dedup(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect())[:4] == [1, 2, 3, 4]
    assert hmh.join(df.limit(0)).count() == 0


def brute_link(text):
    a, b = brute.shingles(text), brute.shingles(text.replace("w3 ", "y "))
    return 100 * len(a & b) >= 85 * len(a | b)


def test_registers_are_leading_zeros_and_mantissa():
    s = np.array([3, 1 << 40, 12345678901234567], np.uint64)
    got = hmh.registers(s)
    seeds = hmh.mixed(np.arange(1, hmh.SHUFFLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k, seed in enumerate(seeds):
        least = {}
        for h in hmh.mixed(s ^ seed).tolist():
            rest = f"{h:064b}"
            least[int(rest[:3], 2)] = min(rest[3:], least.get(int(rest[:3], 2), "2"))
        for b in range(hmh.BUCKETS):
            r = int(got[k * hmh.BUCKETS + b])
            if b not in least:
                assert r == 0
                continue
            zeros = len(least[b]) - len(least[b].lstrip("0"))
            # rounding to a float may move a mantissa's last bit
            assert abs(r - ((zeros + 1) << 10 | int(least[b][zeros + 1 : zeros + 11].ljust(10, "0"), 2))) <= 1


def test_long_sets_in_parts(monkeypatch):
    s = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64))
    whole = hmh.registers(s)
    monkeypatch.setattr(hmh, "CHUNK", 77)
    assert (hmh.registers(s) == whole).all()


def test_estimates_and_collisions(monkeypatch):
    """With four mantissa bits chance makes many registers equal; the correction takes them out."""
    monkeypatch.setattr(hmh, "MANTISSA", 4)
    rng = np.random.default_rng(5)
    found = {0.0: [], 0.5: [], 0.9: []}
    for j, out in found.items():
        for _ in range(120):
            x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
            n = int(2000 * (1 - j) / (1 + j))
            a, b = x[:2000], x[n : n + 2000]
            ra, rb = hmh.short(hmh.registers(a)), hmh.short(hmh.registers(b))
            out.append((hmh.estimate((ra == rb).sum(), (ra > 0).sum(), 2000, 2000), (ra == rb).mean()))
    for j, out in found.items():
        got, raw = np.mean(out, axis=0)
        assert abs(got - j) < 0.006, (j, got)
    assert np.mean(found[0.0], axis=0)[1] > 0.008  # uncorrected


def test_equal_bands_of_similar_sets():
    rng = np.random.default_rng(7)
    for n in (7, 20, 100, 1000):
        cut = int(n * 0.15)
        met = []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            a, b = hmh.bands(hmh.registers(x)), hmh.bands(hmh.registers(x[cut or 1 :]))
            met.append(len(np.intersect1d(a, b)))
        assert min(met) >= 1 and np.mean(met) > 8


def near_copies(rng, n, edits):
    """Two sets that share a base of n hashes, each with so many others of its own."""
    x = rng.integers(0, 1 << 63, n + 2 * edits).astype(np.uint64)
    return np.sort(x[: n + edits]), np.sort(np.concatenate([x[:n], x[n + edits :]]))


def signed(how, s):
    """A set's signature as it travels."""
    sign = how.sign(s)
    return hmh.short(np.frombuffer(sign, np.uint16, how.width)).tobytes() + sign[2 * how.width :]


@pytest.mark.parametrize("n", [60, 146, 250, 1000, 1020])
def test_signatures_part_near_copies_below_the_limit(n):
    """Registers alone let pairs down to 0.63 pass, so a large group of near copies had nearly all its pairs verified."""
    how, rng = hmh.Registers(), np.random.default_rng(n)
    size = lambda s: len(s).to_bytes(8, "big")
    for edits, links in ((n // 14, True), (n // 8, False)):
        passed = []
        for k in range(40):
            a, b = near_copies(rng, n, edits)
            b = b[k % 9 if links else 0 :]  # bitmaps of two sizes are met, too
            assert (100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))) == links or links
            if links and 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
                continue
            x, y = signed(how, a), signed(how, b)
            small, large = sorted((x, y), key=len)
            rows = how.stack([np.frombuffer(small, np.uint8), np.frombuffer(large, np.uint8)])
            both = how.compare(rows, 0, np.array([1]), len(a), np.array([len(b)]))[0].tolist()
            assert how.bound(size(a) + x, [size(b) + y, size(a) + x, size(b) + y]) == [*both, True, *both]
            passed += both
        assert all(passed) if links else sum(passed) <= 4, (edits, sum(passed))


def test_a_group_of_near_copies_is_searched_by_few_pairs(spark, monkeypatch):
    """Of copies that differ too much from each other hardly a pair is verified on full sets."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    docs = [(k, " ".join(edited(base, rng, 3))) for k in range(120)]
    verified, exact = [], ngram_join.exact

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return exact(pairs, *rest)

    monkeypatch.setattr(ngram_join, "exact", counted)
    got = hmh.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(docs)
    assert sum(verified) < 1000, verified  # of 7140 pairs


def test_thue_morse_words_are_told_apart(spark):
    """Polynomial hashes modulo 2^64 can't tell these two words apart, whatever their base."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rows = [(1, "p q r s " + word), (2, "p q r s " + other), (3, word), (4, other), (5, " ".join(word)), (6, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for join, percent in ((ngram_join.join, 75), (hmh.join, 85)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join(df).collect()}
        assert got == by_hand(rows, percent)
        assert got[1][1] == 1 and got[2][1] == 2 and got[4][1] == 4
