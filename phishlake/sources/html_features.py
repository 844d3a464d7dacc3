"""Page features and open mails from HTML.

Labels and enclosing elements need the element tree, which SQL cannot express,
so a small tokenizer runs per page inside ``mapInArrow`` (no shuffle, only the
columns it needs). Batches are read and answered in slices of bounded bytes, and a
page's tree has no reference cycles, so that it goes as soon as its row is made:
a worker holds one Arrow batch, one slice of texts and one tree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from phishlake import fixed_values as fv

_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_ANY_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
_HIDDEN = {"script", "style", "title", "noscript", "template", "iframe", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl",
          "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section",
          "table", "tr", "ul"}
_FIELDS = {"input", "select", "textarea"}
_INPUT_TYPES = {"button", "checkbox", "color", "date", "datetime-local", "email", "file",
                "hidden", "image", "month", "number", "password", "radio", "range", "reset",
                "search", "submit", "tel", "text", "time", "url", "week"}


@dataclass(frozen=True)
class Limits:
    """How much of a page is read; None reads all of it."""

    title: int | None = None
    meta: int | None = None
    text: int | None = None
    fields: int | None = None
    label: int | None = None
    anchors: int | None = None


#: What the browser reads of a page, for callers that want the same cut.
BROWSER_LIMITS = Limits(fv.TITLE_CHARS, fv.META_CHARS, fv.TEXT_CHARS, fv.MAX_FIELDS, fv.LABEL_CHARS,
                        fv.MAIL_ANCHORS)


#: Bytes of markup that become Python strings at a time.
SLICE_BYTES = 1_000_000


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text_content(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    def visible_text(self) -> str:
        """Text as shown: blocks on their own lines, blanks collapsed."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(_SPACE.sub(" ", node))
            elif node.tag == "#line":
                out.append("\n")
            elif node.tag not in _HIDDEN:
                if node.tag == "br":
                    out.append("\n")
                elif node.tag in _BLOCK:
                    out.append("\n")
                    stack.append(_LINE)
                    stack.extend(reversed(node.children))
                else:
                    stack.extend(reversed(node.children))
        lines = (re.sub(r" {2,}", " ", x).strip(" ") for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)


_LINE = Node("#line")


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class _Scanner:
    """Markup after a position, in one forward pass: nothing is sought twice in vain."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """Where the tag's ``>`` is; a quote opens a value only where it finds its pair."""
        while True:
            stop = _TAG_STOP.search(self.html, at)
            if stop is None or stop[0] == ">":
                return stop.start() if stop else -1
            close = self._find(stop[0], stop.end())
            at = stop.end() if close < 0 else close + 1

    def next(self, at: int):
        """(start, end, closing, tag, attributes) of the next markup; tag '' for comments."""
        while True:
            start = self.html.find("<", at)
            if start < 0:
                return None
            if self.html.startswith("<!--", start):
                end = self._find("-->", start + 4)
                return start, len(self.html) if end < 0 else end + 3, "", "", ""
            if self.html.startswith(("<!", "<?"), start):
                end = self._find(">", start)
                if end >= 0:
                    return start, end + 1, "", "", ""
            tag = _OPEN_TAG.match(self.html, start)
            if tag is not None and ">" not in self.missing:
                end = self._tag_end(tag.end())
                if end >= 0:
                    return start, end + 1, tag[1], tag[2], self.html[tag.end():end]
                self.missing.add(">")
            at = start + 1


def parse_html(html: str) -> Node:
    """A forgiving element tree: enough for text, attributes and ancestors."""
    root = Node("#root")
    top, above, at, n = root, [], 0, len(html)
    scanner, unclosed, opened = _Scanner(html), set(), Counter()
    while at < n:
        m = scanner.next(at)
        if m is None:
            top.children.append(unescape(html[at:]))
            break
        start, end, closing, tag, attributes = m
        if start > at:
            top.children.append(unescape(html[at:start]))
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if opened[tag]:  # a stray end changes nothing and climbs nowhere
                while top.tag != tag:
                    opened[top.tag] -= 1
                    top = above.pop()
                opened[tag] -= 1
                top = above.pop()
            continue
        if tag in ("p", "li", "option") and top.tag == tag:
            opened[tag] -= 1
            top = above.pop()
        node = Node(tag, _attrs(attributes))
        top.children.append(node)
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _RAW:
            end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if end is None:
                unclosed.add(tag)
            stop = end.start() if end else n
            raw = html[at:stop]
            node.children.append(unescape(raw) if tag in ("title", "textarea") else raw)
            at = end.end() if end else n
        else:
            opened[tag] += 1
            above.append(top)
            top = node
    return root


def _short(text: str, size: int | None) -> str:
    return _ANY_SPACE.sub(" ", text.strip())[:size]


def _field_type(node: Node) -> str:
    if node.tag == "select":
        return "select-multiple" if "multiple" in node.attrs else "select-one"
    if node.tag == "textarea":
        return "textarea"
    kind = node.attrs.get("type", "").lower()
    return kind if kind in _INPUT_TYPES else "text"


def _with_labels(root: Node) -> Iterator[tuple[Node, Node | None]]:
    """Every element with the innermost label that it lies in, itself not counted."""
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, label = stack.pop()
        yield node, label
        inner = node if node.tag == "label" else label
        stack.extend((c, inner) for c in reversed(node.children) if isinstance(c, Node))


def _fields(root: Node, limits: Limits) -> list[dict]:
    labels: dict[str, Node] = {}
    found: list[tuple[Node, Node | None]] = []
    for x, around in _with_labels(root):
        if x.tag == "label" and x.attrs.get("for"):
            labels.setdefault(x.attrs["for"], x)
        if x.tag in _FIELDS:
            found.append((x, around))
    texts: dict[int, str] = {}
    short: dict[str, str] = {}

    def text_of(label: Node | None) -> str:
        if label is None:
            return ""
        if id(label) not in texts:
            texts[id(label)] = label.text_content()
        return texts[id(label)]

    out = []
    # a limit counts every field; those without any descriptor are dropped after
    for x, around in found[:limits.fields]:
        a = x.attrs
        label = text_of(labels.get(a.get("id"))) or text_of(around)
        if label not in short:
            short[label] = _short(label, limits.label)
        row = {
            "name": a.get("name", ""), "id": a.get("id", ""),
            "placeholder": a.get("placeholder", "") if x.tag != "select" else "",
            "type": _field_type(x), "autocomplete": a.get("autocomplete", "").lower(),
            "label_text": short[label],
        }
        if any(v for k, v in row.items() if k != "type"):
            out.append(row)
    return out


def page_features(html: str, limits: Limits = Limits()) -> dict:
    root = parse_html(html or "")
    nodes = list(root.walk())
    title = next((x.text_content() for x in nodes if x.tag == "title"), "")
    meta = next((x.attrs.get("content", "") for x in nodes
                 if x.tag == "meta" and x.attrs.get("name") == "description"), "")
    body = next((x for x in nodes if x.tag == "body"), root)
    return {
        "title": _SPACE.sub(" ", title).strip(" ")[:limits.title],
        "meta_description": meta[:limits.meta],
        "text": body.visible_text()[:limits.text],
        "fields": _fields(root, limits),
    }


FEATURE_SCHEMA = (
    "title string, meta_description string, text string, fields array<struct<name:string,"
    "id:string,placeholder:string,type:string,autocomplete:string,label_text:string>>"
)


_TEXT = pa.string()
_FIELD_TYPE = pa.struct([(k, _TEXT) for k in ("name", "id", "placeholder", "type", "autocomplete", "label_text")])
_ANCHOR_TYPE = pa.struct([("href", _TEXT), ("text", _TEXT)])


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts together stay near ``SLICE_BYTES`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + SLICE_BYTES, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def extract_page_features(pages: DataFrame, id_col: str = "page_id", limits: Limits = Limits()) -> DataFrame:
    """(id, url, html) -> id, url, title, meta_description, text, fields, is_https."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in _slices(batches, "html"):
            rows = [page_features(h, limits) for h in part.column("html").to_pylist()]
            texts = [pa.array([r[c] for r in rows], _TEXT) for c in ("title", "meta_description", "text")]
            fields = pa.array([r["fields"] for r in rows], pa.list_(_FIELD_TYPE))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), part.column("url"), *texts, fields],
                [id_col, "url", "title", "meta_description", "text", "fields"])

    out = pages.select(id_col, "url", "html").mapInArrow(
        run, f"{id_col} {id_type}, url string, {FEATURE_SCHEMA}")
    return out.selectExpr("*", "coalesce(url rlike '(?i)^https:', false) AS is_https")


# --- open mail in a webmail page --------------------------------------------

def _has_class(node: Node, name: str) -> bool:
    return name in node.attrs.get("class", "").split()


def _first(nodes, test) -> Node | None:
    return next((x for x in nodes if test(x)), None)


def _anchors(node: Node) -> list[dict]:
    return [{"href": x.attrs["href"], "text": x.text_content().strip()}
            for x in node.walk() if x.tag == "a" and "href" in x.attrs]


def _layout_one(root: Node, limits: Limits) -> dict | None:
    nodes = list(root.walk())
    head = _first(nodes, lambda x: x.tag == "h2" and _has_class(x, "hP"))
    if head is None:
        return None
    who = _first(nodes, lambda x: "email" in x.attrs and (x.tag == "span" or _has_class(x, "gD")))
    name = who.text_content().strip() if who else ""
    mail = who.attrs.get("email", "") if who else ""
    bodies = [x for x in nodes if _has_class(x, "a3s")]
    return {
        "subject": head.text_content().strip(),
        "sender": f"{name} <{mail}>" if mail else name,
        "body": "".join("\n" + b.visible_text() for b in bodies),
        "anchors": [a for b in bodies for a in _anchors(b)][:limits.anchors],
    }


def _layout_two(root: Node, limits: Limits) -> dict | None:
    main = _first(root.walk(), lambda x: x.tag == "div" and x.attrs.get("role") == "main")
    if main is None:
        return None
    inner = list(main.walk())[1:]
    head = _first(inner, lambda x: x.attrs.get("role") == "heading")
    subject = head.text_content().strip() if head else ""
    if not subject:
        return None
    who = _first(inner, lambda x: x.tag == "span" and (
        "@" in x.attrs.get("title", "") or "@" in x.attrs.get("aria-label", "")))
    doc = _first(inner, lambda x: x.tag == "div" and x.attrs.get("role") == "document") or main
    return {
        "subject": subject,
        "sender": (who.attrs.get("title") or who.text_content()) if who else "",
        "body": doc.visible_text(),
        "anchors": _anchors(doc)[:limits.anchors],
    }


LAYOUTS = {"one": _layout_one, "two": _layout_two}
MAIL_SCHEMA = ("subject string, sender string, body string, "
               "anchors array<struct<href:string,text:string>>")


def extract_mail(html_df: DataFrame, id_col: str = "msg_id", limits: Limits = Limits()) -> DataFrame:
    """(id, provider, html) -> one row per open mail; pages without one give no row."""
    id_type = html_df.schema[id_col].dataType.simpleString()
    columns = ["subject", "sender", "body", "anchors"]

    def run(batches):
        for part in _slices(batches, "html"):
            mails = []
            for provider, html in zip(part.column("provider").to_pylist(), part.column("html").to_pylist()):
                read = LAYOUTS.get(provider)
                mails.append(read(parse_html(html or ""), limits) if read else None)
            open_ = [m for m in mails if m]
            keys = part.column(id_col).filter(pa.array([bool(m) for m in mails], pa.bool_()))
            values = [pa.array([m[c] for m in open_], pa.list_(_ANCHOR_TYPE) if c == "anchors" else _TEXT) for c in columns]
            yield pa.RecordBatch.from_arrays([keys, *values], [id_col, *columns])

    return html_df.select(id_col, "provider", "html").mapInArrow(
        run, f"{id_col} {id_type}, {MAIL_SCHEMA}")
