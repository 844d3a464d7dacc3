"""Does a host label or mailbox name look machine-made?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.functions.text import contains_any, ends_with_any

_NEVER = "|".join(fv.NEVER_ENGLISH_PAIRS)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


def english_score(c: Column) -> Column:
    """Share of adjacent letter pairs that are common; 1.0 below four letters."""
    s = letters_only(c)
    n = F.length(s)
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2))
    )
    common = F.size(F.filter(pairs, lambda p: p.isin(fv.COMMON_LETTER_PAIRS)))
    return F.when(n < 4, F.lit(1.0)).otherwise(common / F.greatest(n - 1, F.lit(1)))


def consonant_run(c: Column) -> Column:
    """Longest run without a, e, i, o, u or y."""
    return F.array_max(F.transform(F.split(letters_only(c), "[aeiouy]"), F.length))


def vowel_ratio(c: Column) -> Column:
    """Share of a, e, i, o, u among the letters; 0.0 without letters."""
    s = letters_only(c)
    n = F.length(s)
    vowels = F.length(F.regexp_replace(s, "[^aeiou]", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(vowels / F.greatest(n, F.lit(1)))


def has_never_english_pair(c: Column) -> Column:
    return letters_only(c).rlike(_NEVER)


def has_q_without_u(c: Column) -> Column:
    return letters_only(c).rlike("q[^u]")


def looks_random(c: Column, min_letters: int = fv.RANDOM_MIN_LETTERS) -> Column:
    """Long enough, and one strong or at least two weak signs of randomness."""
    run, ratio = consonant_run(c), vowel_ratio(c)
    strong = has_never_english_pair(c) | (run >= 6) | (ratio == 0)
    weak = (
        (run >= 5).cast("int") + (ratio < 0.25).cast("int")
        + (english_score(c) < 0.30).cast("int") + has_q_without_u(c).cast("int")
    )
    return (F.length(letters_only(c)) >= min_letters) & (strong | (weak >= 2))


def host_labels(host: Column) -> Column:
    """Lower-case labels, empty ones dropped."""
    return F.filter(F.split(F.lower(F.coalesce(host, F.lit(""))), r"[.]"), lambda x: x != "")


def label_count(host: Column) -> Column:
    return F.size(host_labels(host))


def has_gibberish_label(host: Column) -> Column:
    """Any random-looking label; a last label of up to three letters is skipped."""
    labels = host_labels(host)
    n = F.size(labels)
    judged = F.filter(labels, lambda x, i: ~((i == n - 1) & (F.length(x) <= 3)))
    return F.exists(judged, lambda x: looks_random(x))


def is_random_local_part(local: Column) -> Column:
    """Random-looking mailbox name that holds no common role word."""
    s = letters_only(local)
    return ~contains_any(s, fv.ROLE_MAILBOX_WORDS) & looks_random(local)


def has_abused_suffix(host: Column) -> Column:
    return ends_with_any(F.lower(F.coalesce(host, F.lit(""))), fv.ABUSED_SUFFIXES)


def has_digit_mixed_label(host: Column) -> Column:
    """Any label but the last with letters and digits and at least five characters."""
    labels = host_labels(host)
    n = F.size(labels)
    return F.exists(
        F.filter(labels, lambda x, i: i < n - 1),
        lambda x: x.rlike("[a-z]") & x.rlike("[0-9]") & (F.length(x) >= 5),
    )


def sender_signals(domain: Column, local: Column) -> list[tuple[str, int, Column]]:
    """(code, weight, flag) for a sender; all false without a domain."""
    known = domain.isNotNull() & (domain != "")
    flags = {
        "random_sender_domain": has_gibberish_label(domain),
        "random_sender_local_part": is_random_local_part(local),
        "deep_subdomain_chain_sender": label_count(domain) >= fv.DEEP_CHAIN_LABELS,
        "abused_sender_tld": has_abused_suffix(domain),
        "digit_mixed_sender_domain": has_digit_mixed_label(domain),
    }
    return [
        (code, fv.REPUTATION_WEIGHTS[code], F.coalesce(known & flag, F.lit(False)))
        for code, flag in flags.items()
    ]
