"""Term matching against a large dictionary as a join.

For a few hundred terms the expressions in ``functions.text`` are cheaper. For
large dictionaries each text gives its distinct words, words that open a term
become an equality join, and the full bounded pattern decides the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake.functions.text import SPACE, SPACES
from phishlake.operators.lookups import BROADCAST_ROWS, LOCAL_ROWS, lookup_join


def _pattern_column(term: Column) -> Column:
    """The bounded pattern of ``functions.text.term_pattern``, built from a column."""
    escaped = F.regexp_replace(
        F.lower(term), r"([^\p{L}\p{M}\p{N}" + SPACE + "])", r"\\$1")
    spaced = F.regexp_replace(escaped, SPACES, SPACES.replace("\\", "\\\\"))
    return F.concat(F.lit("(?:^|[^a-z0-9])"), spaced, F.lit("(?:[^a-z0-9]|$)"))


def dictionary(terms: DataFrame) -> DataFrame:
    """(group, term) -> plus index word and bounded pattern, one row per spelling.

    The index word is the first run of ASCII letters and digits; a term without one
    files under its first character, behind a blank that no word holds. Patterns are
    built once over the dictionary, never per text.
    """
    lower = F.lower("term")
    word = F.regexp_extract(lower, "([a-z0-9]+)", 1)
    sign = F.concat(F.lit(" "), F.substring(F.regexp_replace(lower, f"[{SPACE}]", ""), 1, 1))
    return (
        terms.filter(F.coalesce(F.col("term"), F.lit("")) != "").dropDuplicates(["group", "term"])
        .select("group", "term", F.when(word != "", word).otherwise(sign).alias("_word"),
                _pattern_column(F.col("term")).alias("_pattern"))
    )


def _index_words(lowered: Column) -> Column:
    """What dictionary entries may file under: words, and other characters one by one."""
    signs = F.array_distinct(F.split(F.regexp_replace(lowered, f"[a-z0-9{SPACE}]+", ""), ""))
    return F.array_distinct(F.concat(
        F.split(lowered, "[^a-z0-9]+"), F.array(F.lit(" ")), F.transform(signs, lambda s: F.concat(F.lit(" "), s))))


def term_hits(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, group, term) for every term found in a text, each once per row of ``texts``.

    Small dictionaries filter the words on the row. Larger ones meet (row, word)
    pairs in a join, and only rows with a candidate meet their text again; the row
    is named by a hash of id and text, so repeated and null ids stay apart.
    """
    dic = dictionary(terms)
    small = dic.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS
    lower = F.lower(F.col(text_col))
    lowered = texts.select(id_col, lower.alias("_text"), _index_words(lower).alias("_words"))
    if not small:
        return _hits_by_join(lowered, id_col, dic)
    # only words that open a term are worth a row next to the text
    openers = [r[0] for r in dic.select("_word").distinct().collect()]
    rows = lowered.select(id_col, "_text", F.explode(
        F.filter("_words", lambda w: w.isin(openers or [""]))).alias("_word"))
    hits = rows.join(F.broadcast(dic), "_word")
    return hits.filter(F.rlike(F.col("_text"), F.col("_pattern"))).select(id_col, "group", "term")


def _hits_by_join(lowered: DataFrame, id_col: str, dic: DataFrame) -> DataFrame:
    """Candidates from (row, word) pairs alone, frequent words salted; texts move once."""
    row = F.struct(F.xxhash64(id_col, "_text").alias("a"), F.xxhash64(F.lit(1), id_col, "_text").alias("b"))
    lowered = lowered.withColumn("_row", row)
    pairs = lowered.select("_row", F.explode("_words").alias("_word")).distinct()
    few = dic.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = lookup_join(pairs, dic, ["_word"], few, how="inner").select("_row", "group", "term", "_pattern")
    hits = lowered.select(id_col, "_row", "_text").join(wanted, "_row")
    return hits.filter(F.rlike(F.col("_text"), F.col("_pattern"))).select(id_col, "group", "term")
