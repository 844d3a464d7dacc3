"""Corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Toxic documents go; of each class of near duplicates the smallest id stays; words that an earlier
document has in a passage of 13 or more go; documents that hold a benchmark item go; the rest is
encoded. A stage sees all rows its predecessor kept. All but the last return the columns of
``documents``; ``n_chars`` follows the text. Rows with null ids are kept by every stage; an empty
table passes through all of them; a document whose words all go stays with an empty text. Rows that
repeat an id with another text are documents of their own in every stage; long texts are worked on
whole; columns other than those of ``documents`` are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.byte_bpe import tokenize
from llm.frames import table, with_twin
from llm.ngram_jaccard_join import near_duplicates
from llm.substring_dedup import dedup_substrings
from llm.template_decontam import remove_contaminated
from llm.toxicity import fit, keep_clean
from phishlake.sources.workdir import materialised

BPE_RANKS = "byte_bpe_50k.tiktoken"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    return keep_clean(docs.select(*COLUMNS), model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one id with different texts are documents of their own; of rows equal in id and text
    the smallest by the other columns stays."""
    docs = docs.select(*COLUMNS)
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        first = near_duplicates(known).where("doc_id = class_id").select("doc_id")
        return known.join(first, "doc_id", "left_semi").unionByName(unknown)
    known = with_twin(known, "doc_id", "text")
    # numbers in the order of (id, twin), so the smallest id of a class still stays
    numbers = materialised(known.select("doc_id", "twin").distinct().orderBy("doc_id", "twin").withColumn(
        "number", F.monotonically_increasing_id()), "numbers")
    known = known.join(numbers, ["doc_id", "twin"]).drop("twin")
    first = near_duplicates(known, key="number").where("number = class_id").select("number")
    one = known.join(first, "number", "left_semi").groupBy("number").agg(
        F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return one.select("row.*").select(*COLUMNS).unionByName(unknown)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(docs, carry=("lang", "source"), rejoin=False)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                      F.length("kept").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BPE_RANKS)
    coded = tokenize(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: No SQL: trained weights and tokenizer merges have no SQL form. Tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what the last one returns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
