"""Main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines of a sliding window.
WINDOW = 3
#: Weight in a window from which a stretch is text by itself.
DENSE = 86
#: What a character outside of articles weighs on a page with articles.
OUTSIDE = 0.1

RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "select", "textarea", "button", "canvas", "audio", "video", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SIDE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "fieldset", "label"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
SIDE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply",
    "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget",
}
#: Words that say nothing beside those: a name of other words too, as in share-price, is no side name on a block of text or in an article.
NEUTRAL = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "inner", "item", "items", "links", "list", "main", "outer", "page", "panel", "post", "posts", "section", "site", "slot", "top", "unit", "wrap", "wrapper"}
KEEP = {"html", "body", "main"}
#: Blocks of text, whose parent is the container that they lie in.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tr", "td", "th"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_side(tag: str, raw: str, in_article: bool) -> bool:
    """Whether an element is no part of an article: by its tag, its role or the words of its class and id."""
    if tag in SIDE:
        return True
    if tag == "header" and not in_article:
        return True
    if not raw.strip() or tag in KEEP:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in SIDE_ROLES:
        return True
    names = [[w.lower() for w in _NAME.findall(name)] for k in ("class", "id") for name in found.get(k, "").split()]
    if in_article or tag in TEXT_BLOCKS:
        return any(SIDE_NAMES & set(n) and all(w in SIDE_NAMES or w in NEUTRAL or w.isdigit() for w in n) for n in names)
    words = {w for n in names for w in n}
    return bool(words & SIDE_NAMES) or "header" in words and tag != "article"


def lines_of(page: str) -> list[tuple[str, float, bool, int]]:
    """Lines (text, weight, in article, container) of a page without markup and the frame's elements.

    A line is the text of a block; blank ones stand for what was cut out, and for the rim of
    an article. It weighs its characters outside of links, all of them in an article, and a
    tenth outside of articles if the page has any. Its container is the number of the
    element around its blocks of text, 0 for the page.
    """
    lines: list[tuple[str, float, bool, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, int]] = []  # tag, side, article, container
    side = article = link = made = 0

    def inside() -> int:
        return stack[-1][3] if stack else 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, len(text) if article else max(0, len(text) - linked), article > 0, inside()))
            parts.clear()
        linked = 0

    def cut() -> None:
        end()
        lines.extend([("", 0, False, inside())] * (0 if article else WINDOW))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not side:
            parts.append(text)
            linked += len(text.strip()) if link else 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else size if tag in ("script", "style", "title", "textarea") else at
                if tag not in INLINE and not side:
                    parts.append(" ")
                continue
            if tag in ("br", "hr", "wbr", "img"):
                if not side:
                    parts.append("" if tag == "wbr" else " ")
                    if tag == "hr":
                        end()
                continue
            if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
                continue
            if tag in INLINE:
                if tag == "a":
                    link += 1
                    stack.append((tag, False, False, inside()))
                elif m[3].strip() and _is_side(tag, m[3], article > 0):
                    stack.append((tag, True, False, inside()))
                    side += 1
                elif side:
                    stack.append((tag, False, False, inside()))
                continue
            if not side:
                end()
            hides = _is_side(tag, m[3], article > 0)
            if hides and not side:
                cut()
            if tag == "p":  # it ends an open paragraph
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "font") and not stack[-1][1]:
                    stack.pop()
            own = tag in ("article", "main") and not hides and not side
            if own:
                cut()
            made += tag not in TEXT_BLOCKS
            stack.append((tag, hides, own, inside() if tag in TEXT_BLOCKS or tag in ("html", "body") else made))
            side += hides
            article += own
        else:
            if tag not in INLINE and not side:
                end()
            if any(t[0] == tag for t in stack):
                if tag == "p" and side and not any(t[0] == "p" for t in stack[max(i for i, t in enumerate(stack) if t[1]) :]):
                    continue
                while stack:
                    name, was_side, was_article, _ = stack.pop()
                    side -= was_side
                    if was_article:
                        end()
                    article -= was_article
                    if was_article:
                        cut()
                    link -= name == "a" and link > 0
                    if name == tag:
                        break
                if not side and tag not in INLINE:
                    parts.append("")
    end()
    if any(line[2] for line in lines):
        return [line if line[2] else (line[0], OUTSIDE * line[1], False, line[3]) for line in lines]
    return lines


def stretches(weights: list[float], window: int) -> list[tuple[int, int, float]]:
    """(surge, dive, peak): where the sum of the ``window`` lines from a line on leaves zero and returns to it, and its most between.

    A stretch begins with its first line of any weight.
    """
    out: list[tuple[int, int, float]] = []
    weights = [*weights, *[0] * window]
    surge, peak = None, 0.0
    for i in range(len(weights) - window + 1):
        block = sum(weights[i : i + window])
        if block and surge is None:
            if not weights[i]:
                continue
            surge, peak = i, 0.0
        elif not block and surge is not None:
            out.append((surge, i, peak))
            surge = None
        peak = max(peak, block)
    return out


def main_text(page: str, window: int = WINDOW) -> str:
    """The text between surge and dive points of the distribution, in lines; empty without any.

    The distribution gives each line the weight of itself and the lines after it, ``window``
    in all. Every stretch that reaches ``DENSE`` is text; else it must be the heaviest, the
    earlier of equal ones, or hold lines of an article, or without any of the heaviest line's container.
    Lines without weight between surge and dive stay.
    """
    lines = lines_of(page)
    found = stretches([line[1] for line in lines], window)
    if not found:
        return ""
    best = max(found, key=lambda s: (any(line[2] for line in lines[s[0] : s[1]]), sum(line[1] for line in lines[s[0] : s[1]])))
    home = max(lines[best[0] : best[1]], key=lambda line: (line[2], line[1]))
    own = lambda line: line[2] if home[2] else line[1] and line[3] == home[3]
    kept = [s for s in found if s is best or s[2] >= DENSE or any(own(line) for line in lines[s[0] : s[1]])]
    return "\n".join(line[0] for s in kept for line in lines[s[0] : s[1]] if line[0])


def with_main_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of the html.

    A null or empty page, or one without any text outside of its frame, gives an empty
    text. Other columns pass through; of that name, ``text`` and ``n_chars`` are replaced.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in rest), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(len(rest))]
            columns = [*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "n_chars"])

    return pages.select(*rest, F.col(html_col).cast("string")).mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
