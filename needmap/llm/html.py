"""Main text of web pages by line-block distribution.

A page is read as lines: each block of text between tags that break the flow is one. Markup, scripts, styles and the parts
that markup itself names as boilerplate (navigation, footers, adverts, forms, comments ...) leave lines without text. The
lengths of a few neighbouring lines are summed in a sliding window. Where the sum surges the main text begins, where it dives
to nothing it ends; the text between the first surge and its dive, and between all further ones, is kept. Text of links counts
little, so menus do not surge. Where a page marks its article, the window runs over the article.

Element names hide what they enclose (menus, forms, adverts ...). A class, id or role only hints at that: a hint is judged when the
page has been read, and hides nothing if it encloses a marked article or, unless it names comments, most of the page's text.

NULL and empty pages have an empty text. Cut-off pages, unclosed and unknown tags are read as far as they go: what an
unclosed form list, title or drawing would swallow ends at the next block of text, and ``/>`` closes an element. All rows and
other columns stay; no text is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page (fixed values).
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "textarea", "select", "title"}
#: Elements that are boilerplate by name.
BOILERPLATE = {"nav", "footer", "aside", "menu", "form", "dialog", "button", "fieldset", "header"}
#: Elements that mark the main text.
MAIN = {"article", "main"}
#: Elements that stay within a line of text; all others break it.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that cannot stand inside an unfinished one of RAW that has no end.
_BLOCK = re.compile(r"</?(?:p|div|form|article|main|section|h[1-6]|ul|ol|table|blockquote|pre|body|footer|aside|nav)(?=[\s/>])", re.I)
#: Elements of RAW that run to the end of the page if nothing ends them; the others end at the next block.
_CODE = {"script", "style"}
#: Hints that hide most of a page's text too.
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|disqus)(?=$|[\s_-])", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in a class, id or role that mark boilerplate.
HINTS = re.compile(
    r"(?:^|(?<!has)(?<!with)(?<!no)(?<!without)[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|sidebar|side|"
    r"menu|nav\w*|breadcrumbs?|pagination|pager|footer|header|masthead|comments?|replies|disqus|share|sharing|social|related|recommend\w*|widget|"
    r"login|signup|search|complementary|contentinfo|dialog)(?=$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


@dataclass
class Line:
    text: str
    linked: int  # characters within links
    main: bool  # within an element that marks the main text
    hints: tuple[int, ...] = ()  # the hinting elements that enclose it


def _raw_end(page: str, name: str, at: int) -> int:
    """Where an element without text of the page ends: after its end tag, or where the next block starts if it has none of its own."""
    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
    block = None if name in _CODE else _BLOCK.search(page, at)
    if name in ("select", "title") and found and block and block.start() < found.start():
        found = None  # the end tag is that of a later one
    if found:
        return found.end()
    return block.start() if block else len(page)


def lines(page: str) -> list[Line]:
    """The blocks of text of a page in page order; parts that are no text or boilerplate are empty lines."""
    out: list[Line] = []
    parts: list[str] = []
    linked = link_depth = 0
    open_tags: list[tuple[str, bool, bool, int]] = []  # name, boilerplate, main, hint
    hints: list[int] = []  # of the open tags
    spared: set[int] = set()  # hints that enclose a marked article
    n_hints = 0
    strong: set[int] = set()
    hidden = main = 0

    def close_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            out.append(Line("" if hidden else text, min(linked, len(text)), main > 0, tuple(hints)))
            parts.clear()
            linked = 0

    def close_tag() -> str:
        nonlocal hidden, main
        name, was_hidden, was_main, hint = open_tags.pop()
        hidden -= was_hidden
        main -= was_main
        if hint:
            hints.pop()
        return name

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token.group(2)
        if name is None:
            text = token.group()
            if text[0] != "<" or len(text) == 1:
                parts.append(text)
                if link_depth:
                    linked += len(text)
            continue
        name, closing = name.lower(), token.group(1) == "/"
        if name in INLINE:
            if name == "a":
                link_depth = max(0, link_depth + (-1 if closing else 1))
            continue
        close_line()
        link_depth = 0 if not closing else link_depth
        if closing:
            if any(t[0] == name for t in open_tags):
                while close_tag() != name:
                    pass
            continue
        if token.group(3).rstrip().endswith("/") or name in VOID:
            continue
        if name in RAW:
            if name != "head" or re.compile("</head", re.I).search(page, at):
                at = _raw_end(page, name, at)
            out.append(Line("", 0, main > 0))
            continue
        is_main = name in MAIN
        is_hidden = name in BOILERPLATE and not (name == "header" and main)
        hint = 0
        if not is_main and not is_hidden and name not in ("html", "body"):
            values = [v.strip("\"'") for _, v in _ATTRIBUTE.findall(token.group(3))]
            if any(HINTS.search(v) for v in values):
                n_hints = hint = n_hints + 1
                if any(_COMMENTS.search(v) for v in values):
                    strong.add(hint)
        if name == "p" and open_tags and open_tags[-1][0] == "p":  # a paragraph ends the one before it
            close_tag()
        if is_main and not hidden:
            spared.update(hints)
        open_tags.append((name, is_hidden, is_main, hint))
        hidden += is_hidden
        main += is_main
        if hint:
            hints.append(hint)
        if is_hidden or hint:
            out.append(Line("", 0, main > 0))
    close_line()
    return _without_hinted(out, spared, strong)


def _without_hinted(found: list[Line], spared: set[int], strong: set[int]) -> list[Line]:
    """The lines, emptied where a hint hides them. The outermost hints are judged first; a hint within one that hides is not judged."""
    alive = [line for line in found if line.text]
    shown = sum(len(line.text) for line in alive)
    sizes: dict[int, int] = {}
    for line in alive:
        for hint in line.hints:
            sizes[hint] = sizes.get(hint, 0) + len(line.text)
    hiding: set[int] = set()
    for hint in sorted(sizes):  # numbered in page order, so what encloses comes first
        if hint in spared or 2 * sizes[hint] > shown and (hint not in strong or sizes[hint] == shown):
            continue
        hiding.add(hint)
    return [Line("" if hiding.intersection(line.hints) else line.text, line.linked, line.main) for line in found]


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The text between surge and dive points of the line-block distribution, blocks joined by one space.

    ``window`` lines are summed. A surge is a sum of ``surge`` characters outside links, or of half the largest sum if that is
    less, and a dive a sum below a quarter of a surge. All blocks between surge and dive are kept, links too. Where an article is
    marked, the window runs over its lines, any text of it surges, and only ``window`` lines without text dive.
    """
    found = lines(page or "")
    article = any(line.main and line.text for line in found)
    if article:
        found = [line for line in found if line.main]
        weights = [len(line.text) for line in found]
        rise = fall = 1
    else:
        weights = [max(0, len(line.text) - 2 * line.linked) for line in found]
        sums = [sum(weights[k : k + window]) for k in range(len(weights))]
        rise = min(surge, max(1, max(sums, default=0) // 2))
        fall = max(1, rise // 4)
    kept: list[str] = []
    inside = False
    total = sum(weights[:window])
    for k, line in enumerate(found):
        if not inside and total >= rise and weights[k] > 0:
            inside = True
        elif inside and total < fall:
            inside = False
        if inside and line.text:
            kept.append(line.text)
        total += (weights[k + window] if k + window < len(weights) else 0) - weights[k]
    return " ".join(kept)


def with_main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``df`` and ``text`` (never NULL), which replaces an existing column of that name."""

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(main_text, na_action=None).astype(object)

    rest = [c for c in df.columns if c.lower() != text.lower()]
    return df.select(*(f"`{c}`" for c in rest), extract(F.col(f"`{html}`")).alias(text))
