"""Main text of web pages by a maximum-scoring subsequence.

A page is one sequence of tags and words. Words score positive, more in headings, less in short blocks and inside links;
tags score negative, by kind. The weights are log odds counted on labelled pages: pages whose article element is
marked, which says what is content. Names of classes are not looked at for them; words in elements that are furniture by name lose a fixed amount on top. One linear scan finds the contiguous run of highest total score; it is widened to
the element that holds it, and furniture inside it (menus, forms, adverts, comments, scripts) is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes up to the end of a tag. Quotes count only after an equals sign; nothing is tried twice.
_REST = r"((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*>|<(/?)([a-zA-Z][^\s/>]*)" + _REST, re.S)
#: Elements whose content is no markup of the page; without an end tag, scripts and styles reach to the end and the others are empty.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in "script style noscript template textarea svg iframe object math canvas select title".split()}
_SELF_CLOSED = re.compile(r"(?:^|[\"'\s])/$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A block of fewer words is short: menus, captions and notes are made of these.
SHORT = 8
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav footer aside form header menu dialog button fieldset label input optgroup option head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit banner sponsor sponsored sponsors promo promos promotion promoted "
    "sidebar sidenav sidemenu menu menus nav navbar navigation navi topnav subnav breadcrumb breadcrumbs crumbs pager pagination paging "
    "footer foot sitefooter header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login signin "
    "related recommended recommendations trending popular share sharing social sharebar follow comment comments commentlist disqus discussion replies respond reply "
    "popup modal overlay widget widgets search searchbox tags taglist legal disclaimer copyright skip outbrain taboola teaser poll survey form".split()
)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
COMMENT_NAMES = frozenset("comment comments commentlist disqus discussion replies respond reply ad ads advert sidebar newsletter related share social notice notices".split())
CONTENT_NAMES = frozenset("article main content post story entry body text articlebody".split())
#: With one of these, "header" is the heading of the text and not of the site.
TEXT_NAMES = frozenset("article post entry story".split())
#: ``has-sidebar``, ``no-ads``: such a class speaks of the page around, and wrappers hold more than they are named after.
_AROUND = re.compile(r"^(has|with|without|no|is|not)[-_]|(wrap|wrapper|container|layout|grid|row|columns?)$", re.I)
SPACE = re.compile(r"\s+")
_P_CLOSERS = BLOCK - {"html", "body", "head", "td", "th", "tr"}

#: Words that say nothing in a class name beside one of NAMES: ``article-comments``, ``ad-slot-2``.
NEUTRAL = frozenset("site page global main top bottom left right inline inner outer box slot unit block area bar section list item items link links button buttons icon icons title label reader user post posts entry article articles story stories content body text thread area media network networks count feed panel group set and the email mail us me our more".split())

#: Weights if no page is labelled: counted once on pages of the kind in TESTDATA. ``marked`` and ``content`` are not fitted:
#: what a word costs in elements that are furniture by name or tag, and brings in a marked article, on top of its own weight, which
#: is counted without looking at names.
DEFAULT = {"word": 1.0, "word:short": 0.3, "word:heading": 2.0, "word:link": -0.6, "marked": -4.0, "content": 3.0, "tag": -0.4}


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    """0: plain, 1: furniture, 2: marked content."""
    names: set[str] = set()
    whole: set[str] = set()  # names of tokens that hold nothing but listed and neutral words
    role = prop = ""
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for token in value.split():
                    if token.lower() == "hidden":
                        return 1
                    if not _AROUND.search(token):
                        own = {x.lower() for x in _NAME.findall(token)}
                        names |= own
                        if own <= NAMES | NEUTRAL:
                            whole |= own
            elif key == "role":
                role = value.strip().lower()
            elif key == "itemprop":
                prop = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                return 1
    if tag in ("html", "body"):
        return 0
    if tag in ("article", "main") or role in ("main", "article") or prop == "articlebody":
        return 1 if names & {"comment", "comments", "reply", "teaser", "related"} else 2
    if tag == "header" and in_article:
        return 0
    if tag in FURNITURE or role in ROLES:
        return 1
    found = (whole if in_article else names) & NAMES
    if found == {"header"} and names & TEXT_NAMES:
        return 0
    if found and not (in_article and names & CONTENT_NAMES and not found & COMMENT_NAMES):
        return 1
    return 0


class Page:
    """The scored sequence of a page. ``parts``: (block, text, element) of each text run; ``steps``: tags and runs in order."""

    __slots__ = ("parts", "steps", "elements", "inside", "upto", "has_article")

    def __init__(self, source: str):
        #: steps: (feature, count, part or -1, element)
        self.steps: list[tuple[str, int, int, int]] = []
        self.parts: list[tuple[int, str, int]] = []  # block, text, element
        self.elements: list[tuple[str, int, bool, bool]] = [("", -1, False, False)]  # tag, parent, furniture, content
        self.has_article = False
        block, at, links, in_article, headings = 0, 0, 0, 0, 0
        stack = [0]
        unclosed: set[str] = set()
        open_: Counter[str] = Counter()
        elements, steps, parts = self.elements, self.steps, self.parts

        def close(k: int) -> None:
            nonlocal links, in_article, headings
            for e in stack[k:]:
                open_[elements[e][0]] -= 1
                links -= elements[e][0] == "a"
                headings -= elements[e][0] in HEADINGS
                in_article -= elements[e][3] and not elements[e][2]
            del stack[k:]

        last = source.rfind(">")  # beyond it every start of a tag would be followed to the end in vain
        while at <= last and (m := _TOKEN.search(source, at)):
            if m.start() > at:
                self._text(source[at : m.start()], block, stack[-1], links, headings)
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW and not m[1] and tag not in unclosed and not (tag in ("svg", "math") and _SELF_CLOSED.search(m[3])):
                end = RAW[tag].search(source, at)
                if end or tag in ("script", "style"):
                    at = end.end() if end else len(source)
                    steps.append(("tag:script", 1, -1, stack[-1]))
                    if tag in ("title", "textarea", "select"):
                        block += 1
                    continue
                unclosed.add(tag)  # none further on either: each kind is looked for once
            if tag in BLOCK:
                block += 1
            elif tag == "br":
                parts.append((block, "\n", stack[-1]))
            steps.append(("tag:" + tag, 1, -1, stack[-1]))
            if m[1]:
                if open_[tag]:
                    k = len(stack) - 1
                    while elements[stack[k]][0] != tag:
                        k -= 1
                    close(k)
                continue
            if tag in _P_CLOSERS and open_["p"]:  # an open paragraph ends here, with the inline elements in it
                k = len(stack) - 1
                while k > 0 and elements[stack[k]][0] not in BLOCK:
                    k -= 1
                if k > 0 and elements[stack[k]][0] == "p":
                    close(k)
            kind = _kind(tag, m[3], in_article > 0)
            parent = stack[-1]
            furniture = elements[parent][2] or kind == 1
            content = kind == 2
            if tag in VOID or tag in RAW or (tag not in BLOCK and _SELF_CLOSED.search(m[3])):
                continue
            elements.append((tag, parent, furniture, content))
            stack.append(len(elements) - 1)
            open_[tag] += 1
            if content and not furniture:
                in_article += 1
                self.has_article = True
            links += tag == "a"
            headings += tag in HEADINGS
        rest = source[at:].partition("<!--")[0]  # a comment without an end
        if rest:
            self._text(rest, block, stack[-1], links, headings)
        self._measure()

    def _text(self, raw_text: str, block: int, element: int, links: int, headings: int) -> None:
        text = html.unescape(raw_text) if "&" in raw_text else raw_text
        if not text:
            return
        n = len(text.split())
        self.parts.append((block, text, element))
        if n:
            self.steps.append(("word:link" if links > 0 else "word:heading" if headings > 0 else "word", n, len(self.parts) - 1, element))

    def _measure(self) -> None:
        """Plain words of blocks with fewer than ``SHORT`` words get a feature of their own; ``inside``: elements in a marked article."""
        self.upto = list(range(len(self.elements)))  # the last element within each: they come in the order of their start tags
        for i in range(len(self.elements) - 1, 0, -1):
            parent = self.elements[i][1]
            self.upto[parent] = max(self.upto[parent], self.upto[i])
        self.inside = []
        for _, parent, _, marked in self.elements:
            self.inside.append(marked or (parent >= 0 and self.inside[parent]))
        size: dict[int, int] = {}
        for _, n, part, _ in self.steps:
            if part >= 0:
                size[self.parts[part][0]] = size.get(self.parts[part][0], 0) + n
        self.steps = [("word:short" if f == "word" and size[self.parts[p][0]] < SHORT else f, n, p, e) for f, n, p, e in self.steps]

    def score(self, i: int, weights: dict[str, float]) -> float:
        """What step ``i`` adds to a run."""
        feature, n, part, element = self.steps[i]
        if part < 0:
            return n * weights.get(feature, weights["tag"])
        extra = weights["marked"] if self.elements[element][2] else weights["content"] if self.inside[element] else 0.0
        return n * (weights.get(feature, weights["tag"]) + extra)

    def region(self, weights: dict[str, float]) -> tuple[int, int] | None:
        """First and last step of the best run (None if nothing scores above zero); of equal runs the first."""
        best, total, first, out = 0.0, 0.0, 0, None
        for i in range(len(self.steps)):
            if total <= 0:
                total, first = 0.0, i
            total += self.score(i, weights)
            if total > best:
                best, out = total, (first, i)
        return out

    def _inside(self, element: int, top: int) -> bool:
        return top <= element <= self.upto[top]

    def text(self, weights: dict[str, float]) -> str:
        found = self.region(weights)
        if found is None:
            return ""
        used = [p for _, _, p, e in self.steps[found[0] : found[1] + 1] if p >= 0 and not self.elements[e][2]]
        if not used:
            return ""
        # the innermost element around the run
        top = self.parts[used[0]][2]
        for p in used[1:]:
            e = self.parts[p][2]
            while not self._inside(e, top):
                top = self.elements[top][1]
        lo, hi = used[0], used[-1]
        wide = top
        while wide > 0 and not self.elements[wide][3]:
            wide = self.elements[wide][1]
        if wide > 0:
            top = wide
        if self.elements[top][0] not in ("", "html", "body"):
            while self.elements[top][0] not in BLOCK and top > 0:
                top = self.elements[top][1]
            if self.elements[top][0] in ("p", "li", "h1", "h2", "h3", "td", "blockquote"):  # one block won: its siblings belong to it
                parent = self.elements[top][1]
                top = parent if self.elements[parent][0] not in ("", "html", "body") else top
            if self.elements[top][0] not in ("", "html", "body"):
                while lo > 0 and self._inside(self.parts[lo - 1][2], top):
                    lo -= 1
                while hi + 1 < len(self.parts) and self._inside(self.parts[hi + 1][2], top):
                    hi += 1
        else:  # headings and paragraphs at the page's top level: take whole blocks
            while lo > 0 and self.parts[lo - 1][0] == self.parts[lo][0]:
                lo -= 1
            while hi + 1 < len(self.parts) and self.parts[hi + 1][0] == self.parts[hi][0]:
                hi += 1
        blocks: list[str] = []
        last, held = None, []
        for block, text, element in self.parts[lo : hi + 1]:
            if self.elements[element][2]:
                continue
            if block != last:
                blocks.append("".join(held))
                last, held = block, []
            held.append(text)
        blocks.append("".join(held))
        clean = (SPACE.sub(" ", b).strip() for b in blocks)
        return "\n\n".join(b for b in clean if b)


def count_features(source: str) -> list[tuple[str, int, int]]:
    """(feature, count inside, count outside) of the marked article of a page; nothing for a page without one.

    Inside is what stands in the article and is no furniture by tag or role there; names are not looked at for words.
    """
    page = Page(source)
    if not page.has_article:
        return []
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    content = [False] * len(page.elements)
    for i, (_, parent, furniture, marked) in enumerate(page.elements):
        content[i] = (marked or (parent >= 0 and content[parent])) and not furniture
    for feature, n, _, element in page.steps:
        (inside if content[element] else outside)[feature] += n
    return [(f, inside[f], outside[f]) for f in sorted(inside | outside)]


def weights_of(counts: Iterable[tuple[str, int, int]], tag_ceiling: float = -0.01) -> dict[str, float]:
    """Log odds of each feature inside against outside the marked articles, with add-one counts; tags lie between -6 and ``tag_ceiling``.

    Without any labelled page the defaults are returned.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for f, i, o in counts:
        inside[f] += i
        outside[f] += o
    if not inside.total():
        return dict(DEFAULT)
    n, m = inside.total(), outside.total()
    odds = {f: math.log((inside[f] + 1) / (n + 1)) - math.log((outside[f] + 1) / (m + 1)) for f in inside | outside}
    out = {f: min(max(v, -6.0), tag_ceiling) for f, v in odds.items() if f.startswith("tag:")}
    word = min(max(odds.get("word", 1.0), 0.5), 3.0)
    short = min(odds.get("word:short", DEFAULT["word:short"]), word)
    return DEFAULT | {"word": word, "word:short": max(short, word / 20), "word:heading": max(odds.get("word:heading", 2.0), word), "word:link": min(odds.get("word:link", -0.6), word / 2)} | out


def fit_weights(pages: Iterable[str]) -> dict[str, float]:
    return weights_of(c for source in pages for c in count_features(source))


def extract(source: str | None, weights: dict[str, float]) -> str:
    return Page(source).text(weights) if source else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", label_pages: int = 512) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page, read from the whole html.

    ``label_pages`` bounds the labelled pages that the weights are counted on (the different pages with the smallest hash of their
    html, read whole, so the choice does not depend on partitions); every page is extracted. Null and empty html give the empty
    text; a page of furniture or scripts only does too. Repeated rows are extracted each. Broken or cut-off markup is
    read as far as it goes. An empty table gives an empty result; extra columns are ignored.
    """
    marked = pages.select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("s")).where(F.col("s").isNotNull() & F.lower("s").rlike("<(article|main)[\\s>]"))
    least = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(label_pages).collect()]  # hashes only, ``label_pages`` of them

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [c for x in b.column("s") for c in count_features(x.as_py())]
            if rows:
                f, i, o = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(i, pa.int64()), pa.array(o, pa.int64())], ["f", "i", "o"])

    labelled = marked.where(F.col("h") <= F.lit(max(least))).dropDuplicates(["h"]).select("s") if least else None
    counts = labelled.mapInArrow(count, "f string, i bigint, o bigint").groupBy("f").agg(F.sum("i"), F.sum("o")).collect() if least else []  # one row a feature
    weights = weights_of(map(tuple, counts))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h.as_py(), weights) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(work, f"page_id {dict(slim.dtypes)['page_id']}, url string, text string, n_chars bigint")
