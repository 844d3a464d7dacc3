"""ASCII form of host labels with other letters (RFC 3492), as SQL text.

The delta coding walks the label once per distinct code point, smallest first; nested
aggregates carry its state, so it runs inside a projection like any other expression.
"""

from __future__ import annotations

# Parameters of the encoding.
BASE, TMIN, TMAX, SKEW, DAMP, INITIAL_BIAS, INITIAL_POINT = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_LONGEST_NUMBER = 13  # digits of the largest delta


def _digits(delta: str, bias: str) -> str:
    """Variable-length number for ``delta``, in base 36 digits."""
    limit = f"greatest({TMIN}L, least({TMAX}L, {BASE}L * pj - {bias}))"

    def digit(x: str) -> str:
        return f"substring('{DIGITS}', cast({x} AS int) + 1, 1)"
    rest = f"(pd.q - {limit})"
    return (
        f"aggregate(sequence(1, {_LONGEST_NUMBER}), named_struct('q', {delta}, 'done', false, 's', ''), (pd, pj) -> CASE "
        f"WHEN pd.done THEN pd "
        f"WHEN pd.q < {limit} THEN named_struct('q', pd.q, 'done', true, 's', concat(pd.s, {digit('pd.q')})) "
        f"ELSE named_struct('q', {rest} div ({BASE} - {limit}), 'done', false, 's', "
        f"concat(pd.s, {digit(f'{limit} + {rest} % ({BASE} - {limit})')})) END).s"
    )


def _adapted(delta: str, points: str, first: str) -> str:
    """Bias after a number was written."""
    start = f"({delta} div CASE WHEN {first} THEN {DAMP} ELSE 2 END)"
    top = (BASE - TMIN) * TMAX // 2
    return (
        f"aggregate(sequence(1, {_LONGEST_NUMBER}), named_struct('d', {start} + {start} div {points}, 'k', 0L), "
        f"(pr, pj) -> CASE WHEN pr.d > {top} THEN named_struct('d', pr.d div {BASE - TMIN}, 'k', pr.k + {BASE}) ELSE pr END, "
        f"pr -> pr.k + ({BASE - TMIN + 1} * pr.d) div (pr.d + {SKEW}))"
    )


def ascii_label(label: str) -> str:
    """SQL text for the ``xn--`` form of a label that holds a character outside ASCII."""
    points = f"transform(sequence(1, char_length({label})), pi -> ascii(substring({label}, pi, 1)))"
    walk = (
        "flatten(transform(array_sort(array_distinct(filter(pc, px -> px > 127))), pm -> concat("
        "array(named_struct('m', pm, 'c', -1)), transform(pc, px -> named_struct('m', pm, 'c', px)))))"
    )
    basic = "cast(size(filter(pc, px -> px < 128)) AS bigint)"

    def state(delta: str, bias: str, seen: str, point: str, out: str) -> str:
        return (f"named_struct('delta', {delta}, 'bias', {bias}, 'seen', {seen}, 'basic', pa.basic, "
                f"'point', {point}, 'out', {out})")
    start = state(f"pa.delta + CASE WHEN pa.point > {INITIAL_POINT} THEN 1L ELSE 0L END + (pe.m - pa.point) * (pa.seen + 1)",
                  "pa.bias", "pa.seen", "pe.m + 1L", "pa.out")
    skip = state("pa.delta + 1L", "pa.bias", "pa.seen", "pa.point", "pa.out")
    emit = state("0L", _adapted("pa.delta", "(pa.seen + 1)", "pa.seen = pa.basic"), "pa.seen + 1L", "pa.point",
                 f"concat(pa.out, {_digits('pa.delta', 'pa.bias')})")
    zero = (f"named_struct('delta', 0L, 'bias', {INITIAL_BIAS}L, 'seen', {basic}, 'basic', {basic}, "
            f"'point', {INITIAL_POINT}L, 'out', '')")
    coded = (f"aggregate({walk}, {zero}, (pa, pe) -> CASE WHEN pe.c = -1 THEN {start} WHEN pe.c < pe.m THEN {skip} "
             f"WHEN pe.c = pe.m THEN {emit} ELSE pa END).out")
    plain = rf"regexp_replace(regexp_replace({label}, r'[^\x00-\x7F]', ''), r'(.)$', '$1-')"
    return f"concat('xn--', {plain}, transform(array({points}), pc -> {coded})[0])"
