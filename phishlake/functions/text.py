"""Text matching with browser-style regular-expression semantics.

Java and browsers disagree on what ``\\s`` and ``\\b`` mean, so the classes are
written out here once and used everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = f"[{SPACE}]+"
WORD_START = r"(?<![0-9A-Za-z_])"
WORD_END = r"(?![0-9A-Za-z_])"
_META = set(".*+?^${}()|[]\\/-&~#")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim_space(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def escape_literal(text: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def term_pattern(term: str) -> str:
    """Regex for a term bounded by anything outside ``[a-z0-9]``.

    White space inside the term matches any run of white space; accented
    letters count as boundaries.
    """
    out: list[str] = []
    in_space = False
    for ch in term.lower():
        if ch.isspace() or ch == "\ufeff":
            if not in_space:
                out.append(SPACES)
            in_space = True
        else:
            out.append(escape_literal(ch))
            in_space = False
    return f"(?:^|[^a-z0-9]){''.join(out)}(?:[^a-z0-9]|$)"


def term_probe(term: str) -> str:
    """Longest blank-free piece: a substring every match must contain."""
    pieces = term.lower().replace("\ufeff", " ").split()
    return max(pieces, key=len) if pieces else ""


def _term_array(terms: Iterable[str]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(t).alias("term"),
            F.lit(term_probe(t)).alias("probe"),
            F.lit(term_pattern(t)).alias("pattern"),
        )
        for t in terms
    ])


def distinct_terms(terms: Iterable[str]) -> list[str]:
    """Non-empty terms, first spelling kept, case-sensitive."""
    return list(dict.fromkeys(t for t in terms if t))


def _is_hit(hay: Column, x: Column) -> Column:
    # the cheap substring test rules out nearly every term before the regex runs
    return hay.contains(x["probe"]) & F.rlike(hay, x["pattern"])


def matched_terms(hay: Column, terms: Iterable[str]) -> Column:
    """Array of the terms found in ``hay`` (already lower-cased), list order kept."""
    terms = distinct_terms(terms)
    if not terms:
        return F.array().cast("array<string>")
    hits = F.filter(_term_array(terms), lambda x: _is_hit(hay, x))
    return F.transform(hits, lambda x: x["term"])


def any_term(hay: Column, terms: Iterable[str]) -> Column:
    """True when at least one term is found in ``hay`` (already lower-cased)."""
    terms = distinct_terms(terms)
    if not terms:
        return F.lit(False)
    if len(terms) <= 8:
        out = F.lit(False)
        for t in terms:
            out = out | (hay.contains(term_probe(t)) & hay.rlike(term_pattern(t)))
        return out
    return F.exists(_term_array(terms), lambda x: _is_hit(hay, x))


def claimed_groups(hay: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Keys of the groups with at least one term in ``hay``, group order kept."""
    rows = [(k, distinct_terms(ts)) for k, ts in groups]
    rows = [(k, ts) for k, ts in rows if ts]
    if not rows:
        return F.array().cast("array<string>")
    table = F.array(*[
        F.struct(F.lit(k).alias("key"), _term_array(ts).alias("terms")) for k, ts in rows
    ])
    hits = F.filter(table, lambda g: F.exists(g["terms"], lambda x: _is_hit(hay, x)))
    return F.transform(hits, lambda g: g["key"])


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | c.endswith(s)
    return out


def contains_any(c: Column, pieces: Iterable[str]) -> Column:
    out = F.lit(False)
    for s in pieces:
        out = out | c.contains(s)
    return out


def host_under(host: Column, entry: str) -> Column:
    """Host equals the entry or is a sub-domain of it."""
    return (host == F.lit(entry)) | host.endswith("." + entry)


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` markers by column values."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), text_or_empty(value))
    return out
