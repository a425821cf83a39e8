"""HTML cleaning: a streaming parse per page, in an Arrow UDF.

A page becomes '# title', its paragraphs, and its code blocks. Script, style, noscript, iframe, footer and nav are dropped;
what counts lies in the first main, else the first article, else the first element of role main, else the body. An open
paragraph ends where the next begins, as HTML says, so that a page of unclosed paragraphs costs no more than its length.
Code inside pre is told for both elements.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DROP = {"script", "style", "noscript", "iframe", "footer", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose start ends an open paragraph.
BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "ol", "p", "pre", "section", "table", "ul"}
#: A text is kept if longer.
PARAGRAPH_CHARS, CODE_CHARS = 40, 20


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []  # tag, and the kind of root that it is
        self.dropped = 0
        self.title: list[str] | None = None
        self.title_done = False
        self.open: list[tuple[str, list[str], list[bool]]] = []  # paragraphs and code being read
        self.found: list[tuple[str, list[str], list[bool]]] = []
        self.roots: dict[str, int] = {}
        self.within: list[str] = []  # root kinds that hold this place, the first of each kind only

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and not self.dropped:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._close(i)
                    break
        if tag in VOID:
            return
        kind = None
        if not self.dropped and tag not in DROP:
            role = dict(attrs).get("role")
            kind = next((k for k in ("main", "article", "role", "body") if k not in self.roots and (k == tag or k == "role" and role == "main")), None)
            if kind:
                self.roots[kind] = 1
                self.within.append(kind)
            if tag in ("p", "pre", "code"):
                self.open.append((tag, [], list(self.within)))
        if tag in DROP:
            self.dropped += 1
        if tag == "title" and not self.title_done and self.title is None:
            self.title = []
        self.stack.append((tag, kind))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                return

    def _close(self, at: int):
        while len(self.stack) > at:
            tag, kind = self.stack.pop()
            if tag in DROP:
                self.dropped -= 1
            elif not self.dropped and tag in ("p", "pre", "code"):
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == tag:
                        self.found.append(self.open.pop(i))
                        break
            if kind:
                self.within.remove(kind)
            if tag == "title" and self.title is not None:
                self.title_done = True

    def handle_data(self, data):
        if self.title is not None and not self.title_done:
            self.title.append(data)
        if not self.dropped:
            for _, parts, _ in self.open:
                parts.append(data)

    def clean(self) -> str:
        self.close()
        self._close(0)
        root = next((k for k in ("main", "article", "role", "body") if k in self.roots), None)
        joined = lambda parts, by: by.join(x for x in (p.strip() for p in parts) if x)
        inside = [(tag, parts) for tag, parts, within in self.found if root in within]
        paragraphs = [t for t in (joined(p, " ") for tag, p in inside if tag == "p") if len(t) > PARAGRAPH_CHARS]
        code = [t for t in (joined(p, "\n") for tag, p in inside if tag != "p") if len(t) > CODE_CHARS]
        title = joined(self.title or [], "")
        return "\n\n".join(x for x in (f"# {title}", "\n".join(paragraphs), "\n\n".join(code)) if x)


def clean_page(html: str | None) -> str | None:
    if html is None:
        return None
    page = Page()
    page.feed(html)
    return page.clean()


@F.pandas_udf(StringType())
def clean_text(html: pd.Series) -> pd.Series:
    return pd.Series([clean_page(h) for h in html], dtype=object)


@F.pandas_udf(StringType())
def page_title(html: pd.Series) -> pd.Series:
    found = (re.search(r"(?is)<title[^>]*>(.*?)</title>", h or "") for h in html)
    return pd.Series([m.group(1).strip() if m else None for m in found], dtype=object)
