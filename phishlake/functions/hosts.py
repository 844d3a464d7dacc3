"""URL parsing and host features as Column expressions.

Two hosts are kept per URL: ``raw_host`` as typed, for look-alike checks, and
``host`` in canonical form. Canonicalisation runs as a short chain of small
steps so that the same code serves a single column (one projection per step)
and an array of URLs (one ``transform`` per step).

Labels with other letters get their true ``xn--`` form, so hosts that differ stay
different and list entries in that form match. Known gaps, on purpose: no
compatibility folding beyond full-width forms, no dot-segment removal in paths, no
shortening of IPv6 hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.functions.punycode import ascii_label
from phishlake.functions.settle import settled
from phishlake.functions.text import ends_with_any

_FULLWIDTH = "".join(chr(c) for c in range(fv.FULLWIDTH_FIRST, fv.FULLWIDTH_LAST + 1))
_FULLWIDTH_ASCII = "".join(
    chr(c - fv.FULLWIDTH_SHIFT) for c in range(fv.FULLWIDTH_FIRST, fv.FULLWIDTH_LAST + 1)
)
_LETTERS_FROM = "".join(fv.LOOKALIKE_LETTERS)
_LETTERS_TO = "".join(fv.LOOKALIKE_LETTERS.values())
IP_PATTERN = r"^[0-9]{1,3}([.][0-9]{1,3}){3}$"
WEB_SCHEMES = "https?"
ANY_HOST_SCHEMES = "https?|ftp|wss?"


def fold_lookalikes(c: Column) -> Column:
    """Lower-case, then map full-width and look-alike letters to ASCII."""
    return F.translate(
        F.lower(c), _FULLWIDTH + _LETTERS_FROM, _FULLWIDTH_ASCII + _LETTERS_TO
    )


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def is_lookalike(a: Column, b: Column, max_distance: int = fv.MAX_EDIT_DISTANCE) -> Column:
    """Folded edit distance within the limit (the bounded form gives -1 beyond it)."""
    return F.levenshtein(fold_lookalikes(a), fold_lookalikes(b), max_distance) >= 0


def strip_www(c: Column) -> Column:
    return F.regexp_replace(c, r"^www[.]", "")


def labels_of(host: Column) -> Column:
    """Labels as split, empty ones included."""
    return F.split(host, r"[.]")


def suffix_candidates(host: Column) -> Column:
    """The host and every tail left after dropping leading labels."""
    labels = labels_of(host)
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."),
    )


def label_runs(host: Column, depths: list[int]) -> Column:
    """Dot-bounded label runs of the given lengths that do not reach the end."""
    labels = labels_of(host)
    n = F.size(labels)
    none = F.array().cast("array<string>")

    def runs_of(depth: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - depth, F.lit(1)))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, depth), "."))
        return F.when(n > depth, runs).otherwise(none)

    return F.array_distinct(F.flatten(F.array(*map(runs_of, depths)))) if depths else none


def hyphen_count(host: Column) -> Column:
    """Hyphens in the first label (1-2 labels) or in all but the last two."""
    labels = labels_of(host)
    n = F.size(labels)
    part = F.when(n <= 2, F.get(labels, F.lit(0))).otherwise(
        F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))), ".")
    )
    return F.length(F.regexp_replace(part, "[^-]", ""))


def is_ip_host(host: Column) -> Column:
    return host.rlike(IP_PATTERN)


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False))


def raw_host_of(url: Column) -> Column:
    """Host as typed: cut at the first of ``/ ? # : @ [ ]``; '' when none."""
    return strip_www(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:@\[\]]+)", 1)))


# --- canonical host, one small step at a time ------------------------------
# Written as SQL text: each step is one parsed expression, which keeps planning
# fast, and a step reads the same for a column and for a lambda variable.

_TRIM = r"regexp_replace({x}, r'[\t\n\r]|^[\x00-\x20]+|[\x00-\x20]+$', '')"

_HOST_AND_PORT = (
    "regexp_extract(" + _TRIM
    + r", r'(?i)^(?:{schemes}):[/\\]*(?:[^/\\?#]*@)?([^/\\?#@]*)', 1)"
)
_SPLIT_PORT = r"""named_struct(
    'host', regexp_extract({x}, r'^(\[[^\]]*\]|[^:]*)', 1),
    'port', regexp_extract({x}, r'^(?:\[[^\]]*\]|[^:]*):?(.*)$', 1))"""
_FOLD_HOST = r"""named_struct(
    'host', lower(translate(
        CASE WHEN contains({x}.host, '%')
             THEN coalesce(try_url_decode(replace({x}.host, '+', '%2B')), '%')
             ELSE {x}.host END,
        '{full}。｡', '{ascii}..')),
    'port_ok', {x}.port rlike r'^0*[0-9]{0,5}$'
        AND coalesce(try_cast({x}.port AS int), 0) <= 65535)"""
_NUMBERS = r"""named_struct('host', {x}.host, 'port_ok', {x}.port_ok, 'nums',
    CASE WHEN {x}.host rlike r'(?:^|[.])(?:[0-9]+|0x[0-9a-f]*)[.]?$' THEN
        transform(split(regexp_replace({x}.host, r'[.]$', ''), r'[.]'), p -> cast(CASE
            WHEN p rlike r'^0x0*[0-9a-f]{0,8}$' THEN
                conv(concat('0', regexp_extract(p, r'^0x0*([0-9a-f]{0,8})$', 1)), 16, 10)
            WHEN p rlike r'^0+[0-7]{0,11}$' THEN
                conv(concat('0', regexp_extract(p, r'^0+([0-7]{0,11})$', 1)), 8, 10)
            WHEN p rlike r'^[1-9][0-9]{0,10}$' THEN p END AS bigint)) END)"""
# the last number fills all remaining bytes; every other number is one byte
_DOTTED = r"""named_struct('host', {x}.host, 'port_ok', {x}.port_ok,
    'numeric', {x}.nums IS NOT NULL, 'ip', CASE
    WHEN size({x}.nums) <= 4 AND forall({x}.nums, v -> v IS NOT NULL)
        AND forall(slice({x}.nums, 1, size({x}.nums) - 1), v -> v <= 255)
        AND element_at({x}.nums, -1) < pow(256, 5 - size({x}.nums))
    THEN aggregate({x}.nums, named_struct('i', 0, 't', 0L), (a, v) -> named_struct(
        'i', a.i + 1,
        't', a.t + CASE WHEN a.i + 1 = size({x}.nums) THEN v
                        ELSE shiftleft(v, 24 - 8 * a.i) END)).t END)"""
_CANONICAL = r"""CASE
    WHEN NOT {x}.port_ok OR {x}.host = '' THEN NULL
    WHEN startswith({x}.host, '[') THEN
        CASE WHEN {x}.host rlike r'^\[[0-9a-f:.]+\]$' THEN {x}.host END
    WHEN {x}.host rlike r'[\x00-\x20#/:<>?@\[\\\]^|%\x7F]' THEN NULL
    WHEN {x}.numeric THEN CASE WHEN {x}.ip IS NOT NULL THEN concat_ws('.',
        shiftright({x}.ip, 24) & 255, shiftright({x}.ip, 16) & 255,
        shiftright({x}.ip, 8) & 255, {x}.ip & 255) END
    WHEN {x}.host rlike r'[^\x00-\x7F]' THEN array_join(transform(
        split({x}.host, r'[.]'), p -> CASE WHEN p rlike r'[^\x00-\x7F]'
            THEN """ + ascii_label("p") + r""" ELSE p END), '.')
    ELSE {x}.host END"""
_STEPS = (_HOST_AND_PORT, _SPLIT_PORT, _FOLD_HOST, _NUMBERS, _DOTTED, _CANONICAL)


def _sql(step: str, x: str, schemes: str = WEB_SCHEMES) -> str:
    # quote and backslash cannot stand in a host; '#' marks it as broken
    plain = _FULLWIDTH_ASCII.replace("'", "#").replace("\\", "#")
    for marker, text in (("{x}", x), ("{schemes}", schemes), ("{full}", _FULLWIDTH),
                         ("{ascii}", plain)):
        step = step.replace(marker, text)
    return step


def hosts_of_urls(urls: str, schemes: str = WEB_SCHEMES) -> Column:
    """Canonical host of every URL in an array column; NULL where it cannot be parsed."""
    sql = urls
    for step in _STEPS:
        sql = f"transform({sql}, u -> {_sql(step, 'u', schemes)})"
    return F.expr(sql)


def with_canonical_host(
    df: DataFrame, url: str, out: str, schemes: str = WEB_SCHEMES
) -> DataFrame:
    """Add the canonical host of ``url`` (not ``www.``-stripped, NULL if invalid)."""
    df = df.withColumn(out, F.col(url))
    for step in _STEPS:
        df = df.withColumn(out, F.expr(_sql(step, f"`{out}`", schemes)))
    return df


def with_hosts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``is_web, raw_host, host, idna_failed, path`` for URL scoring.

    ``host`` falls back to ``raw_host`` with ``idna_failed`` set when the URL
    cannot be parsed; it is '' when neither exists.
    """
    df = with_canonical_host(df, url, "_canon")
    u = F.col(url)
    path = F.replace(
        F.regexp_extract(F.expr(_sql(_TRIM, f"`{url}`")),
                         r"(?i)^https?:[/\\]*[^/\\?#]*([^?#]*)", 1),
        F.lit("\\"), F.lit("/"),
    )
    failed = F.col("_canon").isNull()
    df = df.withColumns({
        "is_web": is_web_url(u), "raw_host": F.coalesce(raw_host_of(u), F.lit("")),
        "idna_failed": failed,
        "path": F.when(failed, F.lit("")).when(path == "", F.lit("/")).otherwise(path),
    }).withColumn("host", F.coalesce(strip_www(F.col("_canon")), F.col("raw_host"))).drop("_canon")
    return settled(df, ["is_web", "raw_host", "idna_failed", "host", "path"])


def has_risky_tld(host: Column, tlds=fv.RISKY_TLDS) -> Column:
    return ends_with_any(host, tlds)


def has_fake_gov(host: Column, path: Column, keywords=fv.GOV_KEYWORDS,
                 suffixes=fv.GOV_SUFFIXES) -> Column:
    """A plain-substring keyword in host+path while the host is not official."""
    text = F.lower(F.concat(host, path))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | text.contains(k)
    return hit & ~ends_with_any(host, suffixes)


def list_entry(raw: Column) -> Column:
    """Normalise a user list entry: no protocol, no ``www.``, no path."""
    d = F.lower(F.trim(raw))
    d = F.regexp_replace(d, r"^https?://", "")
    d = strip_www(d)
    return F.regexp_extract(d, r"^([^/?#]*)", 1)


def list_entry_is_valid(domain: Column) -> Column:
    return domain.rlike(fv.LIST_DOMAIN_PATTERN)


def host_tails_in(host: Column, domains: tuple[str, ...]) -> Column:
    """The host or a parent domain of it is in a list of bounded size.

    The list becomes one hashed set, so the cost per host is its label count.
    """
    if not domains:
        return F.lit(False)
    known = list(domains)
    return F.exists(
        suffix_candidates(F.coalesce(host, F.lit(""))), lambda t: t.isin(known))


def close_enough_hosts(host: Column, targets: tuple[str, ...]) -> Column:
    """Some target within the edit limit; lengths are compared first."""
    if not targets:
        return F.lit(False)
    table = F.array(*[
        F.struct(F.lit(t).alias("domain"), fold_lookalikes(F.lit(t)).alias("folded"))
        for t in targets
    ])
    folded = fold_lookalikes(host)
    return F.exists(table, lambda t: (
        (F.abs(F.length(folded) - F.length(t["folded"])) <= fv.MAX_EDIT_DISTANCE)
        & (host != t["domain"])
        & (F.levenshtein(folded, t["folded"], fv.MAX_EDIT_DISTANCE) >= 0)
    ))
