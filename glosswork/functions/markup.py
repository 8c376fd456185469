"""Visible text of HTML, tag by tag.

HTML has no expression that would read it: elements nest, tags stay open and
attributes hold angle brackets. So this is an Arrow function that walks the
marks of a page once.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

from pyspark.sql.functions import pandas_udf

# Elements whose text isn't shown, and those that begin and end lines.
IGNORED = frozenset(("script", "style", "noscript", "template", "nav", "footer", "head"))
BLOCKS = frozenset(("address", "article", "br", "dd", "div", "dl", "dt", "h1", "h2", "h3", "h4", "li", "p", "section", "tr"))
#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = ("script", "style")

#: A mark: comment, declaration or instruction, end tag, begin tag (whose quoted attributes may hold ">").
MARK = re.compile(
    r"""<!--.*?--\s*>|<(?:!(?!--)|\?)[^>]*>|</>|</\s*(?P<end>[A-Za-z][^\s/>]*)[^>]*>|</[^>]*>"""
    r"""|<(?P<begin>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["'])|["'])*?)>""",
    re.S,
)
OPENED = re.compile(r"<[A-Za-z!/?]")
#: A reference to a character that ends as it should.
CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+)|[A-Za-z][A-Za-z0-9]*);")


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


def visible(page: str, unclosed: bool = True) -> str:
    """The page's text outside ignored elements, with a line end at each block's begin and end.

    An ignored element that never ends hides what follows; references to
    characters are resolved, as a parser does even where their semicolon lacks
    (unclosed), or else only with it; an element closed at once counts as begun
    and ended.
    """
    parts, depth, at, n, last = [], 0, 0, len(page), page.rfind(">")

    def show(a: int, b: int) -> None:
        if not depth and b > a:
            parts.append(html.unescape(page[a:b]) if unclosed else CLOSED.sub(_closed, page[a:b]))

    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last:  # no mark can end after the last ">"
            show(at, n)
            break
        m = MARK.match(page, start)
        if not m:
            # A mark without an end is text, as far as the next ">"; so is a lone "<".
            stop = page.find(">", start + 1) + 1 if OPENED.match(page, start) else 0
            if not stop and OPENED.match(page, start):
                stop = page.find("<", start + 1)
            stop = stop if stop > 0 else start + 1
            show(at, stop)
            at = stop
            continue
        show(at, start)
        at = m.end()
        if m["end"]:
            name = m["end"].lower()
            if name in IGNORED:
                depth = max(0, depth - 1)
            elif not depth and name in BLOCKS:
                parts.append("\n")
        elif m["begin"]:
            name, closed = m["begin"].lower(), m["rest"].endswith("/")
            if name in IGNORED:
                depth += not closed
            elif not depth and name in BLOCKS:
                parts.append("\n\n" if closed else "\n")
            if name in RAW and not closed:
                end = re.compile(rf"</\s*{name}\s*>", re.I).search(page, at)
                at = end.start() if end else n
    return "".join(parts)


def squashed(text: str) -> str:
    """Blanks within lines as one, empty lines dropped."""
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def visible_text(unclosed: bool = True):
    """A function of HTML: its visible lines."""

    @pandas_udf("string")
    def convert(pages):
        return pages.map(lambda p: None if p is None else squashed(visible(p, unclosed)))

    return convert
