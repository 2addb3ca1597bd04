"""HTML extraction: the maximum-scoring run of words and tags is the content region."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Columns, map_columns

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title".split())
BOILERPLATE = RAW | frozenset(
    "head nav header footer aside form button select dialog menu".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead "
    "tbody tfoot tr td th blockquote pre figure figcaption address fieldset details summary hr "
    "nav header footer aside form".split())
INLINE = frozenset("a b i em strong span br img u small sub sup code".split())
CONTENT = frozenset(("article", "main"))
# Words in class, id and role that mark what is not content.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor|sponsored|promo|promotion|"
    r"banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|"
    r"subscribe|signup|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|"
    r"topbar|footer|copyright|comments?|commentlist|disqus|replies|respond|share|sharing|social|"
    r"related|recommended|toolbar|pagination|pager|login|search|complementary|contentinfo)"
    r"(?:$|[\s_-])", re.I)
COMMENT_MARKS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|promo|ads?)"
                           r"(?:$|[\s_-])", re.I)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
    r"((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?=[a-zA-Z/])[^<>]*(?:>|\Z)", re.S)
_MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_KNOWN = BLOCK | INLINE | BOILERPLATE | VOID

# Scores before any page is read: words for, tags against, boilerplate elements strongly.
PRIOR = {"word:p": 1.0, "word:a": 0.1, "word": 0.5, "tag:p": -0.05, "tag:br": -0.05}


class Page:
    """A page as a list of tokens: words of one text node, or a tag.

    ``kind`` is what a token's weight hangs on, ``size`` its number of words, ``element`` the
    number of the element it stands in, ``off`` whether that is boilerplate.
    """

    def __init__(self, source: str):
        self.kind: list[str] = []
        self.size: list[int] = []
        self.text: list[str] = []
        self.off: list[bool] = []
        self.element: list[int] = []
        self.parent, self.name, self.first, self.last = [-1], ["#page"], [0], [0]
        stack, off_at, at = [0], None, 0
        opened: Counter[str] = Counter()
        end = len(source)
        while at < end:
            match = _TAG.search(source, at)
            stop = match.start() if match else end
            if stop > at:
                self._words(source[at:stop], stack, off_at is not None)
            if not match:
                break
            at = match.end()
            closing, name = match.group(1), (match.group(2) or "").lower()
            if not name:
                continue
            if closing:
                if opened[name]:
                    while True:
                        e = stack.pop()
                        opened[self.name[e]] -= 1
                        self.last[e] = len(self.kind)
                        if off_at == e:
                            off_at = None
                        if self.name[e] == name:
                            break
                self._tag(name, stack, off_at is not None)
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in BLOCK:
                closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                          "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
                while len(stack) > 1 and self.name[stack[-1]] in ("p", *closes):
                    e = stack.pop()
                    opened[self.name[e]] -= 1
                    self.last[e] = len(self.kind)
                    if off_at == e:
                        off_at = None
            e = len(self.name)
            self.name.append(name)
            self.parent.append(stack[-1])
            self.first.append(len(self.kind))
            self.last.append(len(self.kind))
            off = name in BOILERPLATE or self._marked(name, match.group(3) or "")
            self._tag(name, stack, off_at is not None or off)
            if name in VOID or (match.group(3) or "").rstrip().endswith("/") and name not in BLOCK:
                continue
            stack.append(e)
            opened[name] += 1
            if off and off_at is None:
                off_at = e
            if name in RAW:  # its content is not markup
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                stack.pop()
                opened[name] -= 1
                self.last[e] = len(self.kind)
                if off_at == e:
                    off_at = None
        for e in stack:
            self.last[e] = len(self.kind)

    @staticmethod
    def _marked(name: str, attributes: str) -> bool:
        if not attributes or name in ("html", "body", "main"):
            return False
        marks = COMMENT_MARKS if name == "article" else MARKS
        return any(marks.search("".join(m)) for m in _MARKED.findall(attributes))

    def _add(self, kind: str, size: int, text: str, element: int, off: bool) -> None:
        self.kind.append(kind)
        self.size.append(size)
        self.text.append(text)
        self.element.append(element)
        self.off.append(off)

    def _tag(self, name: str, stack: list[int], off: bool) -> None:
        self._add(f"tag:{name if name in _KNOWN else 'other'}" + (":off" if off else ""), 1,
                  "\n" if name in BLOCK else " " if name == "br" else "", stack[-1], off)

    def _words(self, raw: str, stack: list[int], off: bool) -> None:
        text = entities.unescape(raw)
        names = [self.name[e] for e in stack[-4:]]
        around = "a" if "a" in names else next((n for n in reversed(names) if n in BLOCK), "")
        kind = "off" if off else f"word:{around}"
        self._add(kind, len(text.split()), text, stack[-1], off)

    def within(self, token: int, names: frozenset) -> int:
        """The innermost element of such a name around a token, or -1."""
        e = self.element[token]
        while e >= 0 and self.name[e] not in names:
            e = self.parent[e]
        return e


def region(page: Page, weights: dict[str, float]) -> tuple[int, int]:
    """The run of tokens with the largest sum of weights, in one pass; empty if none is positive."""
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, size) in enumerate(zip(page.kind, page.size)):
        total += size * (weights[kind] if kind in weights else _prior(kind))
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_range = total, (start, i + 1)
    return best_range


def _prior(kind: str) -> float:
    if kind in PRIOR:
        return PRIOR[kind]
    if kind.startswith("word"):
        return PRIOR["word"]
    if kind == "off":
        return -0.5
    return -4.0 if kind.endswith(":off") else -0.5


def main_text(source: str, weights: dict[str, float]) -> str:
    """The text of the content region, block by block.

    The region found by the scan is rounded to the element that holds it: the article or main
    element around it, else its smallest common element below the body.
    """
    page = Page(source)
    lo, hi = region(page, weights)
    words = [i for i in range(lo, hi) if page.size[i] and not page.off[i]
             and page.kind[i].startswith("word")]
    if not words:
        return ""
    lo, hi = words[0], words[-1] + 1
    e = _common(page, page.element[lo], page.element[hi - 1])
    holder = e
    while holder >= 0 and page.name[holder] not in CONTENT:
        holder = page.parent[holder]
    if holder < 0 and page.name[e] not in ("#page", "html", "body"):
        holder = e
        if page.name[e] in ("p", "b", "i", "em", "strong", "span", "a"):
            holder = -1
    if holder >= 0:
        lo, hi = page.first[holder], page.last[holder]
    else:
        while lo and not page.text[lo - 1].startswith("\n"):
            lo -= 1
        while hi < len(page.text) and not page.text[hi].startswith("\n"):
            hi += 1
    blocks, part = [], []
    for i in range(lo, hi):
        if page.kind[i].startswith("tag"):
            if page.text[i] == "\n":
                blocks.append(" ".join("".join(part).split()))
                part = []
            else:
                part.append(page.text[i] if not page.off[i] else "")
        elif not page.off[i]:
            part.append(page.text[i])
    blocks.append(" ".join("".join(part).split()))
    return "\n".join(b for b in blocks if b)


def _common(page: Page, a: int, b: int) -> int:
    above = set()
    while a >= 0:
        above.add(a)
        a = page.parent[a]
    while b not in above:
        b = page.parent[b]
    return b


def learn_weights(
    pages: DataFrame, id_col: str, html_col: str, max_pages: int = 2000
) -> dict[str, float]:
    """Weights of words by their block and of tags, from pages that mark their article.

    A page is labelled if it has an article or main element: what stands in it, outside
    boilerplate elements, is content. A weight is the logarithm of how much more often a token of
    that kind is content than not; words are never against, tags never for it. At most
    ``max_pages`` labelled pages are read, by hash order of their ids. Only one row for each
    token kind (known tag names) goes to the driver.
    """
    ids = (
        pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]") & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(max_pages))
    sample = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).join(
        F.broadcast(ids.distinct()), "id", "left_semi")  # at most max_pages ids

    def prepare():
        def run(c: Columns) -> Columns:
            count: dict[str, list[int]] = {}
            for source in c["html"]:
                page = Page(source or "")
                for i, kind in enumerate(page.kind):
                    if kind != "off":
                        inside = page.within(i, CONTENT) >= 0 and not page.off[i]
                        count.setdefault(kind, [0, 0])[inside] += page.size[i]
            return {"kind": list(count), "outside": [v[0] for v in count.values()],
                    "inside": [v[1] for v in count.values()]}
        return run

    rows = (
        map_columns(sample.select("html"), "kind string, outside long, inside long", prepare)
        .groupBy("kind").agg(F.sum("outside").alias("o"), F.sum("inside").alias("i")).collect())
    outside, inside = sum(r["o"] for r in rows), sum(r["i"] for r in rows)
    if not outside or not inside:
        return {}
    out = {}
    for r in rows:
        odds = math.log((r["i"] + 1) / (inside + len(rows))) - math.log(
            (r["o"] + 1) / (outside + len(rows)))
        if r["kind"].startswith("word"):
            out[r["kind"]] = min(4.0, max(0.05, odds))
        else:
            out[r["kind"]] = max(-8.0, min(-0.05, odds))
    return out


def extract_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 2000
) -> DataFrame:
    """``(id, row, text)`` for every page; ``row`` has the other columns, if any.

    A null or empty page, or one without content, has an empty text. Broken markup never fails:
    unclosed elements end with their parent, a cut tag or comment ends with the page. Repeated
    rows get a row each; null ids are extracted like others. Without labelled pages fixed prior
    weights are used. An empty table gives no rows.
    """
    weights = learn_weights(pages, id_col, html_col, max_pages)
    others = [c for c in pages.columns if c not in (id_col, html_col)]
    row = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    rows = pages.select(F.col(id_col).alias("id"), row.alias("row"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def prepare():
        def run(c: Columns) -> Columns:
            return {"id": c["id"], "row": c["row"],
                    "text": [main_text(h, weights) for h in c["html"]]}
        return run

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_columns(rows, f"id {kinds['id']}, row {kinds['row']}, text string", prepare)
