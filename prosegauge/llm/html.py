"""Main text of web pages by consensus paths of each host.

Every page scores its containers (text outside links and page furniture, handed
to the enclosing containers) and votes for the generalised path (tags and
classes, digits masked) of its best one.  Votes are summed per host in Spark;
all pages of the host are then extracted again with the winning path, which a
single odd page can't change.  A page without a container of that path falls
back on its own best.

Furniture is told by tag, role, hidden state and class or id words; it counts
neither for votes nor for text.

Defined results: a null or blank page has an empty text; a null or hostless url
votes under the empty host; broken and cut-off markup is read to its end; equal
votes go to the path that sorts first; repeated rows are extracted alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, materialise, small_batches

#: Most winning paths that are broadcast; more are joined by shuffle.
BROADCAST = 100_000
_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|title|select"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_BOXES = frozenset("article body center div main section table tbody td tr blockquote ul ol li dl dd figure details".split())
_CLOSES_P = _BLOCK - {"br", "html", "body"}
_FURNITURE = frozenset("head nav footer header aside form button menu dialog label input fieldset datalist optgroup option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup subscription "
    "share sharing social sidebar side rail related recommended recommendations recirculation comment comments commentlist disqus reply replies respond responses nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar pagination pager widget widgets login search "
    "toolbar disclaimer copyright skip hidden tags tagcloud teaser outbrain taboola paywall feedback".split()
)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_CONTENT = frozenset("html body article main".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _drop(tag: str, at: dict[str, str]) -> bool:
    if tag in _FURNITURE:
        return True
    if not at or tag in ("html", "body"):
        return False
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or at.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I):
        return True
    if tag in _CONTENT:
        return False
    return any(w.lower() in _NAMES for w in _SPLIT.split(f"{at.get('class', '')} {at.get('id', '')}"))


def _step(tag: str, at: dict[str, str]) -> str:
    names = sorted({re.sub(r"\d+", "#", c.replace(">", "")) for c in at.get("class", "").split()})
    return ".".join([tag, *names])


class Boxes:
    """The containers of a page in order of their beginning: each one's parent (-1 for none), tag, and number of its path.

    Paths are interned as (number of the parent's path, step), so deep nesting
    costs no more than its tags.
    """

    def __init__(self):
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.path: list[int] = []
        self.number: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = []

    def add(self, parent: int, tag: str, step: str) -> int:
        key = (self.path[parent] if parent >= 0 else -1, step)
        at = self.number.setdefault(key, len(self.steps))
        if at == len(self.steps):
            self.steps.append(key)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(at)
        return len(self.parent) - 1

    def name(self, at: int) -> str:
        steps = []
        while at >= 0:
            at, step = self.steps[at]
            steps.append(step)
        return ">".join(reversed(steps))

    def find(self, path: str) -> int:
        """The number of a path, -1 if the page has none."""
        at = -1
        for step in path.split(">"):
            at = self.number.get((at, step), -2)
            if at == -2:
                return -1
        return at


def blocks(page: str | None, boxes: Boxes) -> Iterator[tuple[int, str, int]]:
    """(innermost container, -1 for none; text with references decoded; characters inside links) of each block outside furniture."""
    stack: list[tuple[str, bool, int]] = []  # tag, furniture, container around what follows
    opened: Counter = Counter()
    dropped = links = 0
    text: list[str] = []
    linked, at = 0, 0
    page = page or ""

    def flush():
        nonlocal linked
        joined = " ".join(references.unescape("".join(text)).split())
        text.clear()
        n, linked = linked, 0
        return (stack[-1][2] if stack else -1, joined, n) if joined else None

    def pop() -> None:
        nonlocal dropped, links
        tag, furniture, _ = stack.pop()
        opened[tag] -= 1
        dropped -= furniture
        links -= tag == "a"

    for m in _TOKEN.finditer(page):
        if m.start() > at and not dropped:
            part = page[at : m.start()]
            text.append(part)
            linked += len(part) * (links > 0)
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        block = tag in _BLOCK
        if block and (got := flush()):
            yield got
        if m[2]:
            if opened[tag]:
                # an end tag inside a container doesn't close what lies outside it
                if not block:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            break
                        if stack[k][0] in _BLOCK:
                            k = -1
                            break
                    if k < 0:
                        continue
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _BOXES or stack[k][0] in _FURNITURE:
                    break
        if tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
            like = {"li": ("li",), "tr": ("tr", "td", "th")}.get(tag, ("td", "th") if tag[0] == "t" else ("dd", "dt", "option"))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in like:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("ul", "ol", "table", "dl", "menu"):
                    break
        if tag in _VOID or m[4].endswith("/") and tag not in _BLOCK:
            continue
        attributes = _attributes(m[4])
        furniture = _drop(tag, attributes)
        above = stack[-1][2] if stack else -1
        stack.append((tag, furniture, boxes.add(above, tag, _step(tag, attributes)) if tag in _BOXES else above))
        opened[tag] += 1
        dropped += furniture
        links += tag == "a"
    if at < len(page) and not dropped:
        text.append(page[at:])
    if got := flush():
        yield got


_SHARES = (1.0, 0.9, 0.5, 0.25)
_LOW = frozenset("li ul ol dl dd table tbody tr blockquote figure details".split())


def best(boxes: Boxes, found: list[tuple[int, str, int]]) -> tuple[int, float] | None:
    """The number of the path whose containers score best, and its score.

    A block's text counts for its container and those around it, less with
    every level; sums per level are handed up once, so depth costs nothing.
    """
    n = len(boxes.parent)
    sums = [[0.0] * n for _ in _SHARES]  # text by how many levels below the container it lies, the last for all deeper
    seen = [False] * n
    for at, text, linked in found:
        if at >= 0:
            sums[0][at] += max(0, len(text) - 2 * linked) * (1.0 if len(text) > 40 else 0.4)
            seen[at] = True
    for at in range(n - 1, -1, -1):
        up = boxes.parent[at]
        if up >= 0 and seen[at]:
            seen[up] = True
            sums[1][up] += sums[0][at]
            sums[2][up] += sums[1][at]
            sums[3][up] += sums[2][at] + sums[3][at]
    score: dict[int, float] = {}
    for at in range(n):
        if seen[at]:
            tag = boxes.tag[at]
            if tag in ("article", "main"):
                own = 1.25 * (sums[0][at] + sums[1][at] + sums[2][at] + sums[3][at])
            else:
                own = sum(share * level[at] for share, level in zip(_SHARES, sums, strict=True)) * (0.5 if tag in _LOW else 1.0)
            score[boxes.path[at]] = score.get(boxes.path[at], 0.0) + own
    if not score:
        return None
    top = max(round(v, 3) for v in score.values())
    at = min((p for p, v in score.items() if round(v, 3) == top), key=boxes.name)
    return at, score[at]


def votes(page: str | None) -> tuple[str, float] | None:
    """The path of the page's best container and the weight of its vote."""
    boxes = Boxes()
    own = best(boxes, list(blocks(page, boxes)))
    return (boxes.name(own[0]), math.log1p(own[1])) if own else None


def extract(page: str | None, path: str | None) -> str:
    """The text inside containers of that path, or of the page's own best one."""
    boxes = Boxes()
    found = list(blocks(page, boxes))

    def within(wanted: int) -> list[str]:
        inside = []
        for parent, own in zip(boxes.parent, boxes.path, strict=True):
            inside.append(own == wanted or parent >= 0 and inside[parent])
        return [text for at, text, _ in found if at >= 0 and inside[at]]

    wanted = boxes.find(path) if path else -1
    inside = within(wanted) if wanted >= 0 else []
    if not inside:
        own = best(boxes, found)
        inside = within(own[0]) if own else [text for _, text, _ in found]
    return " ".join(inside)


def host(url):
    """The lower-case host of a url column, without user, port and a leading www."""
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(name, r"^www\.", "")


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, pages (of the host): the path with the most votes of each host."""

    @F.pandas_udf("path string, weight double")
    def vote(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([votes(p) or (None, 0.0) for p in part], columns=["path", "weight"])

    cast = pages.select(host(F.col(url_col)).alias("host"), vote(F.col(html_col)).alias("v")).select("host", "v.path", "v.weight")
    total = cast.groupBy("host", "path").agg(F.sum(F.round("weight", 4)).alias("votes"), F.count("*").alias("pages"))
    best = Window.partitionBy("host").orderBy(F.col("path").isNull(), F.desc(F.round("votes", 3)), "path")
    sized = total.withColumn("rank", F.row_number().over(best)).withColumn("pages", F.sum("pages").over(Window.partitionBy("host")))
    return sized.where("rank = 1 and path is not null").select("host", "path", "pages")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path (the host's) of every page."""
    small_batches(pages.sparkSession)
    winners = materialise(consensus(pages, url_col, html_col), "html-paths")
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    if winners.limit(BROADCAST + 1).count() <= BROADCAST:
        told = slim.join(F.broadcast(winners.drop("pages")), "host", "left")
    else:
        told = lookup(slim, winners, ["host"], "pages")

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, path in parts:
            yield pd.Series([extract(p, w) for p, w in zip(page, path, strict=True)], dtype=object)

    got = told.select("page_id", "url", run("html", "path").alias("text"), "path")
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
