"""HTML main text by nearest-URL page differencing.

Pages become sequences of text lines (blocks). Distinct pages of a host are put in URL path order
over the whole cluster; each is paired with the neighbour that shares the longer path prefix. The
two line sequences are aligned by longest common subsequence, and lines shared by the pair are
taken for the site's, on every page, whatever its markup.

Lines inside menus, headers, footers, sidebars, notices, adverts, forms and comments go even when
they are unique, and where a page marks an article, text outside it is not main text. Articles of
one site do quote each other, and copies of an article stand at several addresses. So a shared line
of an article goes only after a check over the whole host: it was found shared on most of the host's
distinct pages, ``MIN_PAGES`` of them at least, by pairs whose articles differ in half their lines or
more. Where no article is marked, the pair alone decides. A line that the neighbour lacks stays.

Defined cases: null or empty pages give an empty text; pages of unparsable addresses share the
host ''; exact copies are paired once, as one page; a page alone on its host keeps its plain
lines, as does one whose plain lines are all shared (a copy that differs elsewhere); repeated rows
give repeated results; very long pages take linear memory in the alignment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.frames import materialised
from llm.page_blocks import CONTENT, blocks
from llm.words import Words, by_size, sliced, text_bytes

#: Distinct pages of a host on which a shared line of an article must have been found before it may go.
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)


def _line_hashes(lines: list[str]) -> np.ndarray:
    column = pa.array(lines, pa.string())
    flat, bounds = text_bytes(column)
    return Words(flat, bounds, np.zeros(256, bool)).hash.view(np.int64)


def _outline(batches):
    """(host, path, page, lines, open, marked): hashes of all lines, the places of those that may be main
    text (the article's where one is marked, else plain ones), whether an article is marked."""
    for batch in (part for batch in batches for part in sliced(batch, "html")):
        found = [blocks(p or "") for p in batch.column("html").to_pylist()]
        hashes = _line_hashes([text for page in found for text, _ in page])
        ends = np.concatenate([[0], np.cumsum([len(page) for page in found])])
        best = [max((kind for _, kind in page), default=0) for page in found]
        places = [[i for i, (_, kind) in enumerate(page) if kind and kind == top] for page, top in zip(found, best, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("path"), batch.column("page"),
             pa.array([hashes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64())),
             pa.array(places, pa.list_(pa.int32())), pa.array([top == CONTENT for top in best], pa.bool_())],
            ["host", "path", "page", "lines", "open", "marked"])


def _row_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the common subsequence of ``a`` with every prefix of ``b``, bit-parallel."""
    places: dict[int, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        match = row & places.get(x, 0)
        row = ((row + match) | (row - match)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by halving in linear memory."""
    known = set(b)
    keep = [i for i, x in enumerate(a) if x in known]
    return [keep[i] for i in _common([a[i] for i in keep], b)]


def _common(a: list[int], b: list[int]) -> list[int]:
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        mid = (a0 + a1) // 2
        left = _row_lengths(a[a0:mid], b[b0:b1])
        right = _row_lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int((left + right).argmax())
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def _cut(lines: list[int], other: list[int], places: list[int], marked: bool) -> list[int]:
    """The open places whose lines the paired page has too; none if that is all of them, or most of an article."""
    known = set(other)
    if not any(lines[i] in known for i in places):
        return []
    both = set(common_lines(lines, other))
    cut = [i for i in places if i in both]
    return cut if len(cut) <= (len(places) // 2 if marked else len(places) - 1) else []


def _common_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


_CUT = pa.schema([("host", pa.string()), ("page", pa.int64()), ("marked", pa.bool_()),
                  ("lines", pa.list_(pa.int64())), ("cut", pa.list_(pa.int32()))])
_CUT_DDL = "host string, page long, marked boolean, lines array<long>, cut array<int>"
_WALKED = pa.schema([("kind", pa.string()), *_CUT, ("n", pa.int64()), ("part", pa.int32()), ("at", pa.int64()),
                     ("target", pa.bool_()), ("path", pa.string()), ("open", pa.list_(pa.int32()))])
_WALKED_DDL = f"kind string, {_CUT_DDL}, n long, part int, at long, target boolean, path string, open array<int>"


def _cut_row(row: dict, other: list[int]) -> dict | None:
    cut = _cut(row["lines"], other, row["open"], row["marked"])
    return {"host": row["host"], "page": row["page"], "marked": row["marked"], "cut": cut,
            "lines": [row["lines"][i] for i in cut]} if cut else None


def _walk(batches):
    """Rows in order, each compared with its nearer neighbour.

    Kind ``cut``: lines shared with it. Kind ``host``: how many pages of a host were seen. Kind ``edge``:
    the two outermost rows at each end, as the first and the last (``target``) may have their neighbour
    in another partition.
    """
    part = TaskContext.get().partitionId()
    head, last, n = [], [], 0  # the first two rows, the last three at most, rows so far
    host, pages, out = None, 0, []

    def count():
        if pages:
            out.append({"kind": "host", "host": host, "n": pages})

    for batch in batches:
        sizes = np.diff(batch.column("lines").offsets.to_numpy()) * 8 + 200
        for piece in by_size(batch, np.concatenate([[0], np.cumsum(sizes)])):
            for row in piece.to_pylist():
                if row["host"] != host:
                    count()
                    host, pages = row["host"], 0
                pages += 1
                row["at"], n = n, n + 1
                head += [row] if len(head) < 2 else []
                last = [*last[-2:], row]
                if len(last) == 3 and last[1]["open"]:
                    near = [(_common_path(last[1]["path"], x["path"]), first, x["lines"])
                            for first, x in ((1, last[0]), (0, last[2])) if x["host"] == last[1]["host"]]
                    found = _cut_row(last[1], max(near, key=lambda x: x[:2])[2]) if near else None
                    out += [{"kind": "cut", **found}] if found else []
            yield pa.RecordBatch.from_pylist(out, _WALKED)
            out.clear()
    count()
    for at, row in {x["at"]: x for x in head + last[-2:]}.items():
        out.append({"kind": "edge", "part": part, "target": at in (0, n - 1), **row})
    yield pa.RecordBatch.from_pylist(out, _WALKED)


def _shared(batches):
    """``cut`` rows of pages joined with their neighbour's lines."""
    for batch in batches:
        found = (_cut_row(row, row["other"]) for row in batch.to_pylist())
        yield pa.RecordBatch.from_pylist([x for x in found if x], _CUT)


def _across(edges: DataFrame) -> DataFrame:
    """(host, page, lines, open, marked, other): rows at the ends of partitions and their nearest neighbour's lines."""
    order = edges.select("part", "at").withColumn("next", F.lead(F.struct("part", "at")).over(W.orderBy("part", "at")))
    here = edges.join(F.broadcast(order), ["part", "at"])
    a, b = here.alias("a"), edges.alias("b")
    pairs = a.join(b, (F.col("a.next.part") == F.col("b.part")) & (F.col("a.next.at") == F.col("b.at"))).where("a.host = b.host")
    common = F.expr(
        "size(filter(sequence(1, size(split(a.path, '/'))), "
        "i -> substring_index(a.path, '/', i) = substring_index(b.path, '/', i)))")
    pairs = pairs.withColumn("common", common)

    def side(own: str, far: str, order: int) -> DataFrame:
        return pairs.where(F.col(f"{own}.target") & (F.size(f"{own}.open") > 0)).select(
            *(F.col(f"{own}.{c}").alias(c) for c in ("host", "page", "lines", "open", "marked")),
            F.struct("common", F.lit(order).alias("order"), F.col(f"{far}.lines").alias("other")).alias("near"))

    best = side("b", "a", 1).unionByName(side("a", "b", 0)).groupBy("host", "page").agg(
        *(F.first(c).alias(c) for c in ("lines", "open", "marked")),
        F.max_by("near", F.struct("near.common", "near.order")).alias("near"))
    return best.select("host", "page", "lines", "open", "marked", F.col("near.other").alias("other"))


def site_lines(outlines: DataFrame) -> DataFrame:
    """(host, page, cut): places of the lines of distinct pages that differencing gives to the site.

    Order comes from a range partitioning on (host, path, page), so a host of any size spreads over
    tasks; each task compares the rows it holds, and the few at the ends of partitions meet in a join.
    """
    ordered = outlines.repartitionByRange("host", "path", "page").sortWithinPartitions("host", "path", "page")
    walked = materialised(ordered.mapInArrow(_walk, _WALKED_DDL), "pages-in-order")
    cuts = walked.where("kind = 'cut'").select("host", "page", "marked", "lines", "cut").unionByName(
        _across(walked.where("kind = 'edge'")).mapInArrow(_shared, _CUT_DDL))
    cuts = materialised(cuts, "shared-lines")
    articles = cuts.where("marked")
    votes = articles.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").count()
    hosts = walked.where("kind = 'host'").groupBy("host").agg(F.sum("n").alias("pages"))
    site = votes.join(hosts, "host").where(f"count >= {MIN_PAGES} and 2 * count > pages").select("host", "line")
    lines = articles.select("host", "page", F.explode(F.arrays_zip("lines", "cut")).alias("x")).select(
        "host", "page", F.col("x.lines").alias("line"), F.col("x.cut").alias("place"))
    checked = lines.join(site, ["host", "line"]).groupBy("host", "page").agg(F.collect_list("place").alias("cut"))
    return cuts.where("not marked").select("host", "page", "cut").unionByName(checked)


def _texts(batches):
    for batch in (part for batch in batches for part in sliced(batch, "html")):
        out = []
        for page, cut in zip(batch.column("html").to_pylist(), batch.column("cut").to_pylist(), strict=True):
            found = blocks(page or "")
            best = max((kind for _, kind in found), default=0)
            gone = set(cut or ())
            out.append("\n".join(t for i, (t, kind) in enumerate(found) if kind == best and kind and i not in gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text): one row per input row."""
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(F.col(url)).alias("host"),
        F.xxhash64(page).alias("page"))
    outlines = rows.select("host", path_of(F.col("url")).alias("path"), "page", "html").mapInArrow(
        _outline, "host string, path string, page long, lines array<long>, open array<int>, marked boolean")
    distinct = outlines.groupBy("host", "page").agg(
        F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("lines", "open", "marked")))
    cuts = site_lines(distinct)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.join(cuts, ["host", "page"], "left").select("id", "url", "html", "cut").mapInArrow(
        _texts, f"id {kind}, url string, text string").withColumnsRenamed({"id": key, "url": url})
