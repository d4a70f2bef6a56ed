"""Corpus pipeline: from raw documents to packed training sequences.

Five stages, each one operator of `tickloom.llm` over everything that the stage before has kept:

1. quality      documents that the compression classifier scores below 0.3 go
2. exact        of equal texts (white space aside) the longest, then smallest doc_id stays
3. near         of documents linked at a similarity of 0.8 on five-word shingles the smallest doc_id stays
4. substrings   words of 50-word passages that also start in a document with a smaller doc_id are cut out
5. packing      documents become sequences of at most 4,096 tokens

Null texts count as empty: they pass stage 1 if the curve at zero does, are one group in stage 2, and pack into one token each.
Extra columns travel through stages 1 to 4 untouched, whatever their names.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.functions import lineage
from tickloom.functions.lineage import cut
from tickloom.llm.exact_dedup import drop_exact_duplicates
from tickloom.llm.near_dedup import drop_near_duplicates
from tickloom.llm.packing import pack_documents
from tickloom.llm.quality import score, train
from tickloom.llm.substrings import remove_repeated_passages


_LEFT: list[str] = []


def _stage(function):
    """Each stage but the first deletes the intermediate tables of the stages before it, whose results are written by then.

    What `docs` itself is read from stays, and so does what the last stage leaves: its result may still be read.
    """
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if function.__name__ != STAGES[0][0]:
            read = " ".join(docs.inputFiles())
            lineage.remove(spark, [p for p in _LEFT if p.rsplit("/", 1)[1] not in read])
        _LEFT.clear()
        before = len(lineage.WRITTEN)
        result = function(spark, docs, sf_dir)
        _LEFT.extend(lineage.WRITTEN[before:])
        return result

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, threshold=0.3, keep_row=True).filter("predicted = 1").select("row.*")


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, words=5, percent=80)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(docs, window=50)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("packing", packing)]

#: Compression, banded comparison and bin completion are not SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        lineage.remove(spark, before)
        before = lineage.WRITTEN[-1:]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _LEFT.clear()
    return packed
