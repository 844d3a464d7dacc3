"""Registered queries of the package and the pipeline over the smallest tables, against their SQL where there is some."""

import pytest
from pyspark.sql import functions as F
import public_tokenizers
import tiktoken

import corpus_pipeline
from checks.compare import check, duck
from llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows, problem = check(spark, duck(SF), SF, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    assert rows > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialised(stage(spark, docs, SF), name)
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    texts = {r.doc_id: r.text for r in seen[-2].collect()}
    ranks = public_tokenizers.path(corpus_pipeline.BPE_RANKS)
    from tiktoken.load import load_tiktoken_bpe
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(ranks), special_tokens={})
    for r in seen[-1].collect():
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id] or ""))
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(texts)


def test_pipeline_passes_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialised(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    other = "quite another text with nothing in common but the number it came under in the table of all the texts"
    same = "one text that stands in the table twice under one number and once more under a larger number than that"
    rows = [(2, same, "en", "b", 1), (2, other, "en", "a", 1), (2, same, "en", "a", 1), (7, same, "en", "a", 1),
            (1, None, None, None, None), (1, "", "en", "a", 0), (None, same, "en", "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("number", F.lit(1))
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, SF)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [r for r in rows if r not in ((2, same, "en", "b", 1), (7, same, "en", "a", 1))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
