"""Corpus pipeline: quality rules, near-duplicate removal, passage dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of `documents`; a stage's result is written as Parquet and
read again as the next stage's docs.

Every stage takes null ids, texts, languages and sources, empty and very long
texts (whole), repeated rows, extra columns of any name (which it drops) and
empty tables, which give no rows. What each stage makes of them, and of ties:

quality rules      null and empty texts fail the base rule and go; repeated rows
                   are judged alike and stay or go together
near-duplicates    one row of each class stays, that of the smallest id (of rows
                   without one, if no other is there); of equal rows, any one
repeated passages  null text becomes empty; rows without an id count as the last
                   document; of a passage, the smallest id's copy stays
source mix         null is a source of its own; texts without words get whole
                   copies only; ties in the draw go by id, then by all columns,
                   then by the row's number in the written table
packing            a null or empty text is one piece with the end token alone
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import dropped, written
from tallyloom.llm.mixing import mixed_rows
from tallyloom.llm.neardup import first_of_class
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.quality import keep_good
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.suffixdedup import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and threshold rules keep."""
    return keep_good(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id."""
    return first_of_class(docs).select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id also has; n_chars follows."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("repeated passages", passage_dedup),
    ("source mix", mix),
    ("packing", pack),
]

#: SQL can't express near-duplicate classes by sampled sketches nor this tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        dropped(*before)  # a stage's table goes as soon as the next one stands
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
