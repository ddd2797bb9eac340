"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. Each token scores the log odds of
standing inside the article rather than outside, as counted over labelled pages
(those that mark exactly one ``article``); words come out positive, the tags of
menus and the like negative. Where a page marks articles, what stands in them speaks
for a region and what stands beside them as much against it. One linear scan finds
the contiguous region of the greatest sum, whose blocks are the text.

Elements that hold no article text by their name, role, or a class or id made of
telling words only (menus, asides, forms, comments, adverts) are left out before
the scan: inside an article they neither end a region nor weigh in it. An element
that holds all articles of a page stays. Elements end as in HTML 5: by their tag,
by a tag that implies it, or with their parent; a left-out element that lacks an
end tag it needs covers its own words, or else its first child, and not the page.

Counts go through the driver: one row for each kind of token, whose number is
fixed by ``TAGS``. Pages are read one by one, whole. Defined results: null,
empty and wordless pages have the text ""; character references are decoded as
in HTML 5; a ``<`` that starts no tag is text; repeated rows each count; without
labelled pages fixed weights are used; an input column of the result's name is
replaced if carried; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import tidy

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
TAGS = BLOCKS | INLINE
#: Elements without article text, by name; a header only outside of articles.
DROPPED = frozenset("nav footer aside form button select fieldset menu dialog head iframe object svg audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that tell the same, and words that say nothing beside them.
MARKS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion sidebar comment comments respond disqus cookie cookies consent notice notices banner popup modal newsletter subscribe share sharing social related recommended menu nav navigation navbar breadcrumb breadcrumbs footer header masthead pagination pager toolbar widget search login".split()
)
FILLERS = frozenset(
    "area bar block bottom box buttons card container content footer for form header holder inner item items js left links list main message of outer page panel posts primary reader right row secondary section site slot the top unit user wrap wrapper".split()
)
#: Not parents of anything, so that no end tag is waited for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag of these ends, up to the elements that hold them.
CLOSES = {
    **dict.fromkeys(["li"], (("li",), ("ul", "ol", "menu"))),
    **dict.fromkeys(["dt", "dd"], (("dt", "dd"), ("dl",))),
    **dict.fromkeys(["td", "th"], (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(["tr"], (("td", "th", "tr"), ("table",))),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",))),
    **dict.fromkeys(["option", "optgroup"], (("option",), ("select",))),
}
ENDS_ITSELF = frozenset("p li dt dd td th tr tbody thead tfoot option optgroup body html head".split())
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|xmp|noembed|noframes)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?>\"[^\"]*\"|'[^']*')|[^>])*+)>"
    r"|<[/!?a-zA-Z][^>]*>?|(?:[^<]|<(?![a-zA-Z/!?]))+",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Weights without labelled pages: tags of running text weigh nothing.
FIXED = {"word": 1.0, "tag": -1.0} | {k + t: 0.0 for k in "</" for t in INLINE - {"a"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "article", "main"}}
#: Tags weigh this much at most, for or against.
MOST = 3.0
#: Levels of nesting that are followed.
DEPTH = 512
#: Where a token stands: on a page that marks no article, in one that the page marks, outside of those, in a left-out element.
IN, WITHIN, BESIDE, OUT = 0, 1, 2, 3


def tells(attributes: str) -> bool:
    """Whether a role says so, or all words of a class or id are telling ones, fillers or numbers, and one is telling."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            if not ROLES.isdisjoint(value.lower().split()):
                return True
            continue
        for each in value.split():
            words = [w.lower() for w in PARTS.findall(each)]
            if not MARKS.isdisjoint(words) and all(w in MARKS or w in FILLERS or w.isdigit() for w in words):
                return True
    return False


def parsed(page: str) -> list[list]:
    """``[kind, words, text, place]`` of each token. Kinds: ``word`` (a run of text, standing for its words), ``<tag``, ``/tag``.

    What is neither tag nor text (comments, scripts) is left out.
    """
    out: list[list] = []
    stack: list[tuple[str, int]] = []  # name and element
    elements: list[list] = []  # first token, end, name, may be left out, has its own end or needs none
    articles: list[int] = []

    def close(to: int, own: bool) -> None:
        for k in range(len(stack) - 1, to - 1, -1):
            name, e = stack[k]
            elements[e][1] = len(out)
            elements[e][4] = name in ENDS_ITSELF or own and k == to
        del stack[to:]

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if m[1] is None and (m[0][0] != "<" or m[0][1:2] not in "/!?" and not m[0][1:2].isalpha()):
                out.append(["word", len(m[0].split()), html.unescape(m[0]), IN])
            continue
        tag = tag.lower()
        name = tag if tag in TAGS or tag in DROPPED else "other"
        names = [n for n, _ in stack]
        if m[2]:
            if tag in names:
                at = len(names) - 1 - names[::-1].index(tag)
                if tag in BLOCKS or tag in DROPPED or BLOCKS.isdisjoint(names[at + 1 :]):
                    close(at, True)
                else:  # an inline end tag doesn't end blocks
                    elements[stack[at][1]][1], elements[stack[at][1]][4] = len(out), True
                    del stack[at]
            out.append(["/" + name, 0, None, IN])
            continue
        if tag in BLOCKS and "p" in names:
            at = len(names) - 1 - names[::-1].index("p")
            if {"td", "th", "table", "button", "object"}.isdisjoint(names[at + 1 :]):
                close(at, False)
        if tag in CLOSES:
            ends, holders = CLOSES[tag]
            at = len(stack)
            while at and stack[at - 1][0] not in holders:
                at -= 1
            first = next((k for k in range(at, len(stack)) if stack[k][0] in ends), None)
            if first is not None:
                close(first, False)
        if tag not in VOID and not m[4].endswith("/") and len(stack) < DEPTH:
            inside = any(n in ("article", "main") for n, _ in stack)
            drop = tag in DROPPED or tag == "header" and not inside or bool(m[4]) and tag not in ("html", "body") and tells(m[4])
            if tag in ("article", "main") and not drop:
                articles.append(len(elements))
            stack.append((tag, len(elements)))
            elements.append([len(out), len(page), tag, drop, tag in ENDS_ITSELF])
        out.append(["<" + name, 0, None, IN])
    close(0, False)

    n = len(out)
    for e in elements:
        e[1] = min(e[1], n)
    spans = []
    for first, end, name, drop, ended in elements:
        if not drop:
            continue
        if not ended:  # its own words, or else its first child
            k = first + 1
            while k < end and not _edge(out[k][0]):
                k += 1
            if not any(out[i][1] for i in range(first, k)):
                k = next((min(e[1] + 1, end) for e in elements if e[0] == k), k)
            end = k
        spans.append((first, end, name))
    # main articles: those that no left-out element holds, unless it holds all
    held = lambda a, s: s[0] < elements[a][0] < s[1]
    # an element may hold all articles of the page only if it isn't an aside, a menu or a footer
    whole = lambda s: bool(articles) and s[2] not in ("nav", "footer", "aside", "head") and all(held(a, s) for a in articles)
    spans = [s for s in spans if not whole(s)]
    marked = [elements[a] for a in articles if not any(held(a, s) for s in spans)]
    if marked:
        inside = [False] * n
        for first, end, *_ in marked:
            inside[first:end] = [True] * (end - first)
        for i in range(n):
            out[i][3] = WITHIN if inside[i] else BESIDE
    for first, end, _ in spans:
        for i in range(first, min(end + 1, n)):
            out[i][3] = OUT
    return out


def _edge(kind: str) -> bool:
    return kind[0] != "w" and kind[1:] in BLOCKS


def count(found: list[list]) -> Counter | None:
    """Tokens inside and outside of the page's one article; None where the page has no such label."""
    opens = [i for i, x in enumerate(found) if x[0] == "<article"]
    ends = [i for i, x in enumerate(found) if x[0] == "/article"]
    if len(opens) != 1 or len(ends) != 1 or ends[0] < opens[0]:
        return None
    n: Counter = Counter()
    for i, (kind, words, _, place) in enumerate(found):
        n[kind, opens[0] <= i < ends[0] and place != OUT] += words if kind == "word" else 1
    return n


def learn(pages: DataFrame, page: str = "html") -> dict[str, float]:
    """Log odds of each kind of token, from all labelled pages."""
    place = pages.columns.index(page)

    def each(batches):
        for batch in batches:
            total: Counter = Counter()
            for p in batch.column(place).to_pylist():
                total.update(count(parsed(p or "")) or {})
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
                    names=["kind", "inside", "n"],
                )

    counted = pages.mapInArrow(tidy(each), "kind string, inside boolean, n long").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")
    )
    rows = [(r["kind"], r["a"], r["b"]) for r in counted.collect()]
    inside, outside = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not inside:
        return FIXED
    odds = {k: log((a + 0.5) / (inside + 1)) - log((b + 0.5) / (outside + 1)) for k, a, b in rows}
    # words speak for an article by themselves, however the rest of the pages is filled
    return FIXED | odds | {"word": max(odds.get("word", 0.0), 0.1)}


def region(found: list[list], weights: dict[str, float]) -> tuple[int, int]:
    """The contiguous range of greatest sum: the first of the shortest such. What is left out weighs nothing."""
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    unknown, word = weights["tag"], weights["word"]
    for i, (kind, words, _, place) in enumerate(found):
        if place == OUT:
            continue
        w = word * words if kind == "word" else max(-MOST, min(MOST, weights.get(kind, unknown)))
        total += w if place == IN else abs(w) if place == WITHIN else -abs(w)
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_range = total, (start, i + 1)
    return best_range


def extract(page: str, weights: dict[str, float]) -> str:
    """The blocks of the page's region, joined by line breaks."""
    found = parsed(page)
    a, b = region(found, weights)
    # whole blocks: out to the next block tags
    while a > 0 and not _edge(found[a - 1][0]):
        a -= 1
    while 0 < b < len(found) and not _edge(found[b][0]):
        b += 1
    blocks, parts = [], []
    for kind, _, text, place in [*found[a:b], ["<p", 0, None, IN]]:
        if kind == "word":
            if place != OUT:
                parts.append(text)
        elif kind == "<br":
            parts.append(" ")
        elif _edge(kind):
            block = " ".join("".join(parts).split())
            if block:
                blocks.append(block)
            parts = []
    return "\n".join(blocks)


def main_text(pages: DataFrame, page: str = "html", weights: dict[str, float] | None = None, carry: list[str] | None = None, name: str = "text") -> DataFrame:
    """The columns ``carry`` (default: all) and the main text of each page."""
    weights = learn(pages, page) if weights is None else weights
    carry = [c for c in (pages.columns if carry is None else carry) if c.lower() != name.lower()]
    place, columns = pages.columns.index(page), [pages.columns.index(c) for c in carry]
    schema = T.StructType([pages.schema[c] for c in carry] + [T.StructField(name, T.StringType())])

    def task(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                text = pa.array([extract(p or "", weights) for p in batch.column(place).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), text], names=schema.names)

    return pages.mapInArrow(tidy(task), schema)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    """All pages, with weights counted over all labelled ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    done = main_text(pages, carry=["page_id", "url"])
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
