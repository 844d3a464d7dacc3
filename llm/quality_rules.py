"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into ``buckets`` bins. Two multinomials over the bins, one of the
trusted target texts and one of the whole corpus, give every bin a log ratio; a text's ratio is the
mean over its n-grams. A text is kept if the base rules hold and its mean ratio reaches a fixed
threshold: the same text and counts always give the same verdict.

Corpus and target are counted in one pass over all texts (map-side sums over at most ``buckets``
keys). Every trusted text counts: whole ids are told by bitmaps, broadcast while there are at most
``bitmaps`` of 4 KB (each holds 32,768 neighbouring ids); with more, or other ids, texts meet the
trusted ids in a shuffle join, to the same counts. The log ratios are
one array of ``buckets`` doubles, bounded whatever the corpus, that enters the scoring scan as a
scalar subquery.

Defined cases: a null or empty text has no words and fails the base rules (too few words); a text
without n-grams has ratio 0; without trusted texts all ratios are 0 and the base rules decide;
repeated rows are counted and judged each; null ids are never trusted; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RUN = 8  # words of the windows that count as repeated


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row, also where a lambda reads it often."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _joined(hashes: Column, gap: int) -> Column:
    """Hash of every entry with the one ``gap`` places on."""
    return let(hashes, lambda a: F.slice(
        F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + gap))), 1, F.greatest(F.size(a) - gap, F.lit(0))))


def repeated_words(hashes: Column) -> Column:
    """Words inside ``RUN``-word windows that occur twice or more in the text."""
    windows = _joined(_joined(_joined(hashes, 1), 2), 4)
    none = F.lit(0).cast("long")

    def covered(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            def twice(e, i):
                return (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
            return let(F.array_sort(F.transform(F.filter(s, lambda e, i: F.coalesce(twice(e, i), F.lit(False))),
                                                lambda e: e["i"])), total)

        def total(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(RUN), F.coalesce(F.get(at, i + 1) - p, F.lit(RUN)))),
                none, lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(placed, spans)).otherwise(none)

    return let(windows, covered)


def grams_of(hashes: Column, buckets: int) -> Column:
    """Bins of all words and word pairs."""
    return F.transform(F.concat(hashes, _joined(hashes, 1)), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _marked(docs: DataFrame, trusted: DataFrame, key: str, text: str, bitmaps: int) -> DataFrame:
    """(_text, _good): every text, ``_good`` 1 for trusted ids and null for others."""
    known = trusted.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    bucket = F.bitmap_bucket_number("_id").alias("_bucket")
    whole = all(f.schema["_id"].dataType.simpleString() in ("int", "bigint") for f in (known, texts))
    if not whole or known.select(bucket).distinct().limit(bitmaps + 1).count() > bitmaps:
        good = known.distinct().withColumn("_good", F.lit(1))
        return texts.join(good, "_id", "left").select("_text", "_good")
    bits = known.groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("_bits"))
    hit = F.expr(
        "shiftright(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) & 1 = 1")
    return (
        texts.withColumns({"_bucket": F.bitmap_bucket_number("_id"), "_at": F.bitmap_bit_position("_id")})
        .join(F.broadcast(bits), "_bucket", "left").select("_text", F.when(hit, 1).alias("_good"))
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str, text: str, buckets: int, prior: float,
               bitmaps: int) -> DataFrame:
    """One row, one array: log of target over corpus probability for every bin.

    The target is smoothed with ``prior`` pseudo-counts per seen corpus bin in corpus proportions.
    """
    marked = _marked(docs, trusted, key, text, bitmaps)
    counts = (
        marked.select("_good", F.explode(let(_hashes(F.col("_text")), lambda h: grams_of(h, buckets))).alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    )
    rows = F.struct("bin", "raw", "good")
    total = F.aggregate("all", F.struct(F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("good")),
                        lambda a, x: F.struct((a["raw"] + x["raw"]).alias("raw"), (a["good"] + x["good"]).alias("good")))
    def ratio(x: Column) -> Column:
        even = x["raw"] / F.col("sum.raw")
        mass = prior * F.size("all")
        return F.when(F.col("sum.good") > 0,
                      F.log((x["good"] + mass * even) / (F.col("sum.good") + mass) / even)).otherwise(F.lit(0.0))

    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").select(
        "bin", F.coalesce("raw", F.lit(0)).cast("long").alias("raw"), F.coalesce("good", F.lit(0)).cast("long").alias("good"))
    one = full.agg(F.array_sort(F.collect_list(rows)).alias("all")).select("all", total.alias("sum"))
    return one.select(F.transform("all", lambda x: F.when(x["raw"] > 0, ratio(x)).otherwise(F.lit(0.0))).alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 1 << 16,
          prior: float = 1.0, threshold: float = -0.2, least_words: int = 20, most_repeated: int = 30,
          bitmaps: int = 10_000) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept)."""
    ratios = log_ratios(docs, trusted, key, text, buckets, prior, bitmaps).scalar()
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")

    mean = F.aggregate(grams_of(F.col("_h"), buckets), F.lit(0.0), lambda a, b: a + F.get("_ratios", b)) / (
        F.greatest(2 * F.col("n_words") - 1, F.lit(1)))
    # the scan's projection takes the subquery into the sum, so no row carries the array
    rows = (
        docs.select(F.col(key), F.col(text).alias("_text"), _hashes(F.col(text)).alias("_h"))
        .select(
            key, "_h", F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: _count(x) - _count(F.array_distinct(x))).alias("n_dup_lines"),
            _count(F.col("_h")).alias("n_words"), repeated_words(F.col("_h")).alias("n_repeat_words"))
        .withColumn("_ratios", ratios)
        .withColumn("ratio", mean)
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return rows.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "ratio", (~failed & (F.col("ratio") >= threshold)).alias("kept"))
