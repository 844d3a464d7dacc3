"""Text blocks of an HTML page and the kind of place each stands in. One forward pass."""

from __future__ import annotations

import html
import re

CONTENT, PLAIN, CHROME = 2, 1, 0

# HTML element and attribute names.
_RAW = frozenset("script style textarea title noframes iframe xmp".split())
_CHROME = frozenset("nav header footer aside form noscript template svg button select dialog menu head object canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "dialog disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pagination pager popup promo promoted related replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split())
_QUALIFIERS = frozenset(
    "article bottom entry footer global header left main mobile page post primary right secondary site sub top".split())
_COMMENT_NAMES = frozenset("comment comments replies reply respond".split())
_CONTENT_NAMES = frozenset("article content post entry story maincontent articlebody".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Place of the ``>`` that ends a tag; quoted values may hold one. Each quote is sought once."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return len(page)
        mark = stop[0]
        if mark == ">":
            return stop.start()
        at = stop.end()
        if mark not in missing and page[max(0, stop.start() - 8):stop.start()].rstrip().endswith("="):
            close = page.find(mark, at)
            if close < 0:
                missing.add(mark)
            else:
                at = close + 1


def _named(value: str, names: frozenset) -> bool:
    """A class or id is one of ``names`` or begins with one, after words that only say where."""
    for token in value.split():
        words = _NAME.findall(token)
        while len(words) > 1 and words[0] in _QUALIFIERS and words[0] not in names:
            words.pop(0)
        if words and words[0] in names:
            return True
    return False


def _place(name: str, attributes: str, nested: bool = False) -> int | None:
    """Kind of place that an element opens, None if it opens none.

    What holds the whole page is never chrome; a main or article element is not by its class or id,
    comments inside other content (``nested``) excepted.
    """
    if name in ("html", "body"):
        return None
    kind = CHROME if name in _CHROME else CONTENT if name in ("article", "main") else None
    for found in _ATTRIBUTE.finditer(attributes):
        key = found[1].lower()
        value = (found[2] or found[3] or found[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return CHROME
        if key == "role":
            if value in _CHROME_ROLES:
                return CHROME
            if value in ("main", "article"):
                kind = CONTENT
        if key in ("class", "id"):
            if name in ("main", "article"):
                # an article's id may be made of its title, so there the whole name counts
                if name == "article" and nested and _named(value, _COMMENT_NAMES) and (
                        key == "class" or set(_NAME.findall(value)) <= _COMMENT_NAMES):
                    return CHROME
                continue
            if _named(value, _CHROME_NAMES) or any(token.startswith("side-bar") for token in value.split()):
                return CHROME
            if kind is None and name in ("div", "section", "td") and set(_NAME.findall(value)) & _CONTENT_NAMES:
                kind = CONTENT
    return kind


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of every non-empty block in page order."""
    out: list[tuple[str, int]] = []
    run: list[str] = []
    dropped: list = []  # [element, open elements of that name] that ends the current chrome, if any
    content: list[list] = []  # enclosing content elements, likewise
    headings = False

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append((text, CHROME if dropped and not headings else CONTENT if content else PLAIN))

    missing: set[str] = set()
    at, n = 0, len(page)
    lower = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            run.append(page[at:])
            break
        if lt > at:
            run.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(page, lt + 1)
        if tag is None:
            run.append("<")
            at = lt + 1
            continue
        end = _tag_end(page, tag.end(), missing)
        at = end + 1
        closing, name = tag[1] == "/", tag[2].lower()
        attributes = page[tag.end():end]
        if name in _RAW and not closing:
            lower = lower if lower is not None else page.lower()
            close = lower.find(f"</{name}", at) if len(lower) == n else page.find(f"</{name}", at)
            at = n if close < 0 else close
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            run.append(" ")
        if name in _VOID:
            continue
        if closing:
            if name in _HEADINGS:
                headings = False
            for stack in (dropped, content):
                if stack and stack[-1][0] == name:
                    stack[-1][1] -= 1
                    if not stack[-1][1]:
                        stack.pop()
            continue
        kind = _place(name, attributes, bool(content))
        if dropped:
            if name == dropped[-1][0] and name not in ("p", "li"):
                dropped[-1][1] += 1
            elif name in ("article", "main") and kind == CONTENT and dropped[-1][2]:
                dropped.clear()  # an element that was never closed does not hold the article
                content.append([name, 1])
            elif name in _BLOCK and dropped[-1][0] == "p":
                dropped.clear()
            elif name in _HEADINGS and dropped[-1][0] == "header" and content and kind is None:
                headings = True
        if not dropped and kind == CHROME:
            dropped.append([name, 1, name in ("nav", "header", "footer", "aside") or bool(content) is False and name == "div"
                            and not re.search(r"comment|repl|respond", attributes, re.I)])
        elif not dropped:
            if kind == CONTENT:
                content.append([name, 1])
            elif content and name == content[-1][0]:
                content[-1][1] += 1
    flush()
    return out
