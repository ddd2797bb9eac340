"""Plain Python forms of the corpus operators, for small inputs."""

import hashlib
import re

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(docs):
    """[(id, text)] to {row index: least id}."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return {i: least[root(i)] for i in range(len(docs))}


def contaminated(text, items):
    """(words, hit words, items) of a text against [(id, text)]."""
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def line_dedup(docs, min_sites, min_contexts=50, min_chars=10):
    """[(id, text, site)] to [(id, cleaned, lines, removed)]."""
    seen = {}
    for _, text, site in docs:
        lines = [x.strip(" ") for x in (text or "").split("\n")]
        for i, x in enumerate(lines):
            around = (lines[i - 1] if i else None, lines[i + 1] if i + 1 < len(lines) else None, len(lines) == 1)
            seen.setdefault(x, []).append((site, around))
    bad = {
        x
        for x, n in seen.items()
        if len(x) >= min_chars and len({s for s, _ in n}) >= min_sites and len({a for _, a in n}) * 100 >= len(n) * min_contexts
    }
    out = []
    for d, text, _ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        cut = len(kept) < len(lines) and any(x.strip(" ") for x in kept)
        out.append((d, "\n".join(kept) if cut else text, 0 if text is None else len(lines), len(lines) - len(kept) if cut else 0))
    return out
