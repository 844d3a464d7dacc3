"""The same label encoding as DuckDB SQL, for the twins."""

from __future__ import annotations

DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def ascii_label(x: str) -> str:
    """DuckDB SQL for the ``xn--`` form of label ``x``; ``CASE`` it for labels that need one."""
    t = "greatest(1, least(26, 36 * pk - pa.bias))"
    number = (
        f"list_reduce(range(1, 14), lambda pd, pk: CASE WHEN pd.done THEN pd WHEN pd.q < {t} THEN "
        f"{{'q': pd.q, 'done': TRUE, 's': pd.s || substr('{DIGITS}', pd.q + 1, 1)}} ELSE "
        f"{{'q': (pd.q - {t}) // (36 - {t}), 'done': FALSE, "
        f"'s': pd.s || substr('{DIGITS}', {t} + (pd.q - {t}) % (36 - {t}) + 1, 1)}} END, "
        "{'q': pa.delta, 'done': FALSE, 's': ''}).s"
    )
    first = "(pa.delta // CASE WHEN pa.seen = pa.basic THEN 700 ELSE 2 END)"
    shrunk = (
        "list_reduce(range(1, 14), lambda pd, pk: CASE WHEN pd.d > 455 THEN {'d': pd.d // 35, 'k': pd.k + 36} ELSE pd END, "
        f"{{'d': {first} + {first} // (pa.seen + 1), 'k': 0::BIGINT}})"
    )
    bias = f"({shrunk}.k + 36 * {shrunk}.d // ({shrunk}.d + 38))"

    def state(delta, bias_, seen, point, out):
        return (f"{{'delta': ({delta})::BIGINT, 'bias': ({bias_})::BIGINT, 'seen': ({seen})::BIGINT, 'basic': pa.basic, "
                f"'point': ({point})::BIGINT, 'out': {out}}}")
    points = f"list_transform(range(1, length({x}) + 1), lambda pi: unicode(substr({x}, pi, 1))::BIGINT)"
    walk = (
        f"flatten(list_transform(list_sort(list_distinct(list_filter({points}, lambda px: px > 127))), lambda pm: "
        f"list_concat([{{'m': pm, 'c': -1::BIGINT}}], list_transform({points}, lambda px: {{'m': pm, 'c': px}}))))"
    )
    basic = f"len(list_filter({points}, lambda px: px < 128))::BIGINT"
    start = state("pa.delta + CASE WHEN pa.point > 128 THEN 1 ELSE 0 END + (pe.m - pa.point) * (pa.seen + 1)",
                  "pa.bias", "pa.seen", "pe.m + 1", "pa.out")
    skip = state("pa.delta + 1", "pa.bias", "pa.seen", "pa.point", "pa.out")
    emit = state("0", bias, "pa.seen + 1", "pa.point", f"pa.out || {number}")
    zero = (f"{{'delta': 0::BIGINT, 'bias': 72::BIGINT, 'seen': {basic}, 'basic': {basic}, 'point': 128::BIGINT, 'out': ''}}")
    coded = (f"list_reduce({walk}, lambda pa, pe: CASE WHEN pe.c = -1 THEN {start} WHEN pe.c < pe.m THEN {skip} "
             f"WHEN pe.c = pe.m THEN {emit} ELSE pa END, {zero}).out")
    return (f"concat('xn--', regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'), "
            f"CASE WHEN regexp_matches({x}, '[\\x00-\\x7F]') THEN '-' ELSE '' END, {coded})")
