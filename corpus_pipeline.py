"""From raw documents to token ids, in five stages of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import boilerplate, byte_bpe, near_duplicates, quality_model
from tallywork.llm.queries import BYTE_BPE, held_out, mix_documents
from tallywork.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3

#: SQL can't express the classifier and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def as_pages(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumnsRenamed({"doc_id": "page_id", "text": "html"})


def as_documents(pages: DataFrame) -> DataFrame:
    """Page records as documents again, their length that of the text as it is now."""
    return pages.withColumnsRenamed({"page_id": "doc_id", "html": "text"}).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from labelled ones of these documents."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").filter(~held_out())
    network = quality_model.fit_quality(as_pages(docs), labels.select(F.col("doc_id").alias("page_id"), "quality"))
    return docs.select(*COLUMNS).filter(quality_model.score_column(F.col("text"), network) >= LEAST_SCORE)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; each such line stays at its first place."""
    return as_documents(boilerplate.remove_boilerplate(as_pages(docs).withColumn("site", F.col("source"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return as_documents(near_duplicates.one_of_each(as_pages(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of domains, languages and sources; one in two epochs comes twice."""
    return mix_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): the ids, and whether they decode to the text's bytes."""
    rules = BYTE_BPE, public_tokenizers.PATTERN
    coded = byte_bpe.round_trip_pages(as_pages(docs), *rules, "lang", "source", "html")
    return coded.select(
        F.col("page_id").alias("doc_id"), "lang", "source", "n_tokens", "ids",
        (F.col("decoded") == F.encode("html", "utf-8")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; each stage's result is a written table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
