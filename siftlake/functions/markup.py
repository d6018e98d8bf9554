"""HTML to text in two tiers: built-in expressions, and a layout-aware parser for whole pages."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DROP = "(?is)<(script|style|head|nav|footer)(\\s[^>]*)?>.*?</(script|style|head|nav|footer)>"
_ENTITIES = (("&quot;", '"'), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_tags(html_text: Column) -> Column:
    """Scripts, styles, head, menus and footers dropped with their content, other tags as blanks, seven entities decoded, blanks collapsed."""
    out = F.regexp_replace(html_text, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, _DROP, " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r]+", " "))


class _Layout(HTMLParser):
    BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
    DROPPED = frozenset("head script style noscript template title".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool]] = []
        self.held: list[str] = []
        self.hidden = 0
        self.item = False

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if text:
            self.blocks.append((("  \u2022 " if self.item else "") + text, self.item))
            self.item = False
        self.held.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.DROPPED:
            self.hidden += tag not in ("title",) or self.hidden == 0
        if tag == "body":
            self.hidden = 0
        if tag in self.BLOCKS:
            self.flush()
            self.item = tag == "li"
        elif tag == "br":
            self.held.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROPPED and self.hidden:
            self.hidden -= 1
        if tag in self.BLOCKS:
            self.flush()
            self.item = False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)


def layout_text(raw: bytes | str | None) -> str | None:
    """The visible text of a page: blocks apart by a blank line, list items on lines of their own with a bullet; null stays null.

    Bytes are read as UTF-8, or in the charset that the page names; bad bytes become U+FFFD.
    """
    if raw is None:
        return None
    if isinstance(raw, (bytes, bytearray)):
        named = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", raw[:2048])
        try:
            raw = bytes(raw).decode(named[1].decode() if named else "utf-8", "replace")
        except LookupError:
            raw = bytes(raw).decode("utf-8", "replace")
    page = _Layout()
    page.feed(raw)
    page.close()
    page.flush()
    out = ""
    for i, (text, item) in enumerate(page.blocks):
        out += ("\n" if item and page.blocks[i - 1][1] else "\n\n") * (i > 0) + text
    return out


@F.pandas_udf(StringType())
def layout_text_udf(pages: pd.Series) -> pd.Series:
    return pages.map(layout_text)


def unescape(text: str) -> str:
    return html.unescape(text)
