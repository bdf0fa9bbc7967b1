"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags.  Words score positive and tags
negative; the contiguous stretch with the greatest sum, found in one linear
scan, is the content region.  The weights come from labelled pages, those that
mark their text with one ``article`` or ``main`` element: a tag weighs the log
odds of standing outside the mark, a word the log odds of standing inside, by
the block it is in and whether it is link text.  Both start from a prior
(``FLOW``, ``BOUND``), so rare tags and pages without labels have weights.

The region is widened to whole blocks, and to the ``article``, ``main`` or
content-named element that holds it.  Inside, elements that are never content
(``NEVER``, ``ASIDE`` by name; ``HINTS`` by class, id or role; hidden ones) are
left out; their words score nothing in the scan.  A header inside an article
keeps its headings.  An ``article``, ``main`` or ``h1`` ends a wrapper left out
around it, such as a form or an unclosed menu, but not one of comments.
Character references are decoded, white space inside a block becomes one space
(``br`` and table cells are white space), blocks are trimmed and joined in page
order by two line feeds.

Each page is parsed in one pass, in time linear in its length, whole; nothing
is shuffled.  The weights are counted on ``sample`` pages chosen by hash and are
a table of tag names.

Defined cases.  Null and empty html, and pages without words, give the empty
text; a null url is carried.  Tags that are never closed end with their parent;
an unclosed comment or raw element runs to the end, as in browsers.  Repeated
rows are judged each by itself; an empty table gives an empty table.  Other
columns are not read.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: elements whose content is not text
RAW = frozenset("script style title textarea noscript template iframe svg math object audio video canvas select noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements left out by name: with all they hold, or unless an article begins inside
NEVER = frozenset("footer aside button dialog menu fieldset legend label datalist output".split()) | RAW
ASIDE = frozenset("nav form header".split())
BLOCK = frozenset(("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
                   "tfoot tr td th caption blockquote pre figure figcaption address form fieldset legend details summary dialog menu "
                   "center hr hgroup search").split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: tags that belong to running text, and those that part a page
FLOW = HEADING | frozenset("p br b i em strong u s sub sup small span code q cite abbr mark time blockquote pre wbr del ins kbd font".split())
BOUND = frozenset("html head body nav footer aside header form article main button input select iframe".split())
#: class, id and role words of elements that are not content; those of readers' comments and other pages stay shut
HINTS = frozenset(("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
                   "breadcrumb breadcrumbs sidebar masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter "
                   "subscribe subscription signup login share sharing social toolbar pagination pager paywall contentinfo "
                   "complementary search footer header").split())
SHUT = frozenset("comment comments disqus reply replies respond discussion related recommended recommendations sidebar widget footer".split())
CONTENT = frozenset("article content main post entry story body text".split())
#: words before a hint that make it a remark on the layout (``has-sidebar``)
REMARK = frozenset("has with no without show hide is".split())

ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")


def hint(attributes: str) -> str | None:
    """``hint``, ``shut`` or ``content`` by an element's attributes, else None."""
    found = None
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "shut"
        if name == "style":
            if "display:none" in re.sub(r"\s", "", value.lower()):
                return "shut"
        elif name != "aria-hidden":
            for one in value.split():
                said = [w.lower() for w in WORDS.findall(one)]
                if not REMARK.isdisjoint(said):
                    continue
                if not SHUT.isdisjoint(said):
                    return "shut"
                if not HINTS.isdisjoint(said):
                    found = "hint"
                elif found is None and not CONTENT.isdisjoint(said):
                    found = "content"
    return found


def tag_end(html: str, at: int, lost: set) -> int:
    """Where the tag whose name ends at ``at`` ends (its ``>``); -1: nowhere.

    ``lost`` keeps the quotes known to have no more partner, so that no
    stretch of the page is searched in vain twice."""
    i = at
    while m := STOP.search(html, i):
        if m[0] == ">":
            return m.start()
        close = -1 if m[0] in lost else html.find(m[0], m.end())
        if close < 0:
            lost.add(m[0])
            return html.find(">", at)
        i = close + 1
    return -1


class Page:
    """``items``: ``(class, words, text, block, left out, element)`` in page order;
    ``elements``: ``[name, parent, first item, last item, kind]``."""

    def __init__(self, html: str):
        self.items, self.elements = [], [["html", 0, 0, 0, None]]
        self.stack = [(0, "html", None)]     # element, name, why it is left out
        self.link, self.block, self.marks = False, 0, []
        self.within = {"article": 0, "main": 0}      # how many are open
        self.read(html)
        self.close(1)
        self.elements[0][3] = len(self.items)

    def close(self, depth: int):
        while len(self.stack) > depth:
            element, name, _ = self.stack.pop()
            self.elements[element][3] = len(self.items)
            if name in self.within:
                self.within[name] -= 1

    def text(self, raw: str):
        element, name, out = self.stack[-1]
        if "&" in raw:
            raw = unescape(raw)
        n = len(raw.split())
        kind = "a" if self.link else name
        self.items.append(("w " + kind, n, raw, self.block, out is not None, element))

    def open(self, name: str, attributes: str):
        self.items.append((name if name in KNOWN else "other", 1, None, self.block, False, self.stack[-1][0]))
        stack = self.stack
        kind = hint(attributes) if attributes and name not in ("html", "body") else None
        if name not in BLOCK and kind not in ("hint", "shut") and name not in NEVER:
            if name == "a":
                self.link = True
            elif name == "br":
                self.text(" ")
            return
        if name in ("td", "th"):
            self.text(" ")
        if name in BLOCK:
            top = stack[-1][1]
            if top == "p" or (top == name and name in ("li", "tr", "td", "th", "dt", "dd", "option")) or (top in ("dt", "dd") and name in ("dt", "dd")):
                self.close(len(stack) - 1)
            if name not in ("td", "th"):
                self.block += 1
                self.link = False
        if name in VOID:
            return
        _, _, out = stack[-1]
        if name in NEVER or kind == "shut":
            out = "shut"
        elif name in ("article", "main", "h1") and kind != "hint" and out in ("hint", "form", "nav"):
            out = None
        elif out == "header" and name in HEADING and any(self.within.values()):
            out = None
        elif out is None and (kind == "hint" or name in ASIDE):
            out = name if name in ASIDE else "hint"
        element = len(self.elements)
        self.elements.append([name, stack[-1][0], len(self.items), 0, kind])
        if name in self.within:
            if out is None and not self.within["article"]:
                self.marks.append(element)
            self.within[name] += 1
        stack.append((element, name, out))

    def end(self, name: str):
        if name in BLOCK and name not in ("td", "th"):
            self.block += 1
            self.link = False
        elif name == "a":
            self.link = False
        for depth in range(len(self.stack) - 1, 0, -1):      # unclosed elements inside end here too
            if self.stack[depth][1] == name:
                self.close(depth)
                break
            if name not in BLOCK and self.stack[depth][1] in BLOCK:
                break
        self.items.append((name if name in KNOWN else "other", 1, None, self.block, False, self.stack[-1][0]))

    def read(self, html: str):
        i, lost, opened = 0, set(), {}
        while True:
            j = html.find("<", i)
            while j >= 0 and not (html[j + 1:j + 2].isalpha() or html[j + 1:j + 2] in ("/", "!", "?")):
                j = html.find("<", j + 1)
            if (j if j >= 0 else len(html)) > i:
                self.text(html[i:j if j >= 0 else len(html)])
            if j < 0:
                return
            if html.startswith("<!--", j):
                k = html.find("-->", j + 4)
                if k < 0:
                    return
                i = k + 3
                continue
            shut = html[j + 1] == "/"
            m = NAME.match(html, j + 1 + shut)
            k = tag_end(html, m.end(), lost) if m else html.find(">", j)
            if k < 0:
                return
            i = k + 1
            if not m:
                continue
            name = m[0].lower()
            if shut:
                if opened.get(name) or name not in BLOCK:
                    self.end(name)
                    if name in BLOCK:
                        opened[name] -= 1
                continue
            if name in RAW:
                if html[k - 1] != "/":
                    found = re.compile("</" + re.escape(name) + r"(?=[\s/>])", re.I).search(html, i)
                    if not found:
                        return
                    i = html.find(">", found.end())
                    if i < 0:
                        return
                    i += 1
                continue
            if name in BLOCK and name not in VOID:
                opened[name] = opened.get(name, 0) + 1
            self.open(name, html[m.end():k])


KNOWN = BLOCK | FLOW | BOUND | VOID | NEVER | frozenset(["a", "ul", "li"])


def labelled_counts(html: str):
    """``{(class, inside): count}`` of a page with exactly one mark, else nothing."""
    page, out = Page(html), {}
    if len(page.marks) != 1:
        return out
    _, _, first, last, _ = page.elements[page.marks[0]]
    for i, (kind, n, text, _, left_out, _) in enumerate(page.items):
        inside = first <= i < last and not (left_out and text is not None)
        out[kind, inside] = out.get((kind, inside), 0) + n
    return out


def weight(kind: str, inside: float, outside: float, strength: float = 20.0) -> float:
    """A class's score: the log odds seen, from a prior of ``strength`` sightings."""
    if kind.startswith("w "):
        prior, sign, least, most = (-1.0 if kind == "w a" else 2.0), 1, (0.05 if kind == "w a" else 0.3), 4.0
    else:
        prior = -1.0 if kind in FLOW else 4.0 if kind in BOUND else 1.0
        sign, least, most = -1, 0.05, (8.0 if kind in BOUND else 3.0)
        inside, outside = outside, inside
    share = 1 / (1 + math.exp(-prior))
    odds = math.log((inside + strength * share) / (outside + strength * (1 - share)))
    return sign * min(max(odds, least), most)


def train(pages: DataFrame, html: str = "html", sample: int = 5000) -> dict[str, float]:
    """Weights by class, from the marked pages among ``sample`` pages chosen by a hash of their html."""
    read = pages.select(F.col(html).cast("string").alias("html")).where("html is not null")
    share = min(1.0, sample / max(read.count(), 1))
    chosen = read.where(F.shiftrightunsigned(F.xxhash64("html"), 11) < int(share * (1 << 53)))

    def count(batches):
        total: dict = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for key, n in labelled_counts(text).items():
                    total[key] = total.get(key, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([x for _, x in total], pa.bool_()),
                                              pa.array(list(total.values()), pa.int64())], ["kind", "inside", "n"])

    seen: dict = {}
    for r in chosen.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect():
        seen[r["kind"], r["inside"]] = r["n"]
    kinds = {k for k, _ in seen} | KNOWN | {"other", "w a"} | {"w " + b for b in BLOCK}
    return {k: weight(k, seen.get((k, True), 0), seen.get((k, False), 0)) for k in kinds}


def best_region(items, weights: dict[str, float]) -> tuple[int, int, float]:
    """``(first, last, score)`` of the stretch with the greatest sum (the first such; last is inclusive)."""
    best, run, start = (0, -1, 0.0), 0.0, 0
    for i, (kind, n, text, _, out, _) in enumerate(items):
        if run <= 0:
            run, start = 0.0, i
        if text is None:
            run += weights.get(kind, -1.0)
        elif not out:
            run += n * weights.get(kind, 0.3)
            if run > best[2]:
                best = (start, i, run)
    return best


def main_text(html: str, weights: dict[str, float]) -> tuple[str, float]:
    """``(text, score)`` of a page."""
    page = Page(html)
    items, elements = page.items, page.elements
    first, last, score = best_region(items, weights)
    if last < 0:
        return "", 0.0
    # the innermost marked element that holds the region
    at = items[first][5]
    while at and not ((elements[at][0] in ("article", "main") or elements[at][4] == "content") and elements[at][2] <= first and last < elements[at][3]):
        at = elements[at][1]
    if at:
        first, last = min(first, elements[at][2]), max(last, elements[at][3] - 1)
    lo, hi = items[first][3], items[last][3]
    while first and items[first - 1][3] == lo:
        first -= 1
    while last + 1 < len(items) and items[last + 1][3] == hi:
        last += 1
    blocks: dict[int, list[str]] = {}
    for _, _, text, block, out, _ in items[first:last + 1]:
        if text is not None and not out:
            blocks.setdefault(block, []).append(text)
    said = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in said if t), score


def extract(pages: DataFrame, weights: dict[str, float], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``<key>, <url>, text, score`` of every page; ``score``: the region's sum."""
    read = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    kind = read.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [main_text(h, weights) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    ["key", "url", "text", "score"])

    out = read.mapInArrow(run, f"key {kind}, url string, text string, score double")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "score")
