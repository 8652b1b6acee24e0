"""From raw documents to pieces: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import decontaminate, langid, secret_scan, simhash, unigram
from vecspark.llm.registry import documents
from vecspark.llm.tables import Tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from a bounded sample of the labelled ones."""
    return langid.with_language(docs, langid.training_texts(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: shingles of four words, at most four differing bits."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, decontaminate.indexes(decontaminate.benchmark(spark, sf_dir)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.without_secrets(docs, secret_scan.train(secret_scan.labelled_tokens(docs)))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids): the texts as pieces; decoding gives the texts back."""
    encoded = unigram.encode(docs.select("doc_id", "lang", "source", "text"), unigram.load_pieces(unigram.MODEL_PATH))
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("pieces", pieces)]

#: fingerprints, cross-parsing and Viterbi are not SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Stage tables lie in the shared folder; one goes once the next is written."""
    tables, docs = Tables(spark), documents(spark, sf_dir)
    before = None
    for _, stage in STAGES[:-1]:
        docs = tables.store(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
