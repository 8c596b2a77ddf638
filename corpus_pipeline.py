"""The corpus pipeline: quality votes, fuzzy line dedup, n-gram near-duplicates, source mix, subword round trip.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
calls one operator of tidemark.llm over all rows that its predecessor kept; the stages add no other filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.line_minhash import dedup_lines
from tidemark.llm.mixing import repeat_by_mix
from tidemark.llm.neighbour_quality import keep_good
from tidemark.llm.ngram_join import keep_one
from tidemark.llm.piece_prefix import encode_decode
from tidemark.llm.queries import held_out
from tidemark.llm.shared import materialise

#: A document goes if its score is lower.
LEAST_SCORE = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; learnt as in its own query."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_SCORE, learn_from=~held_out())


def dedup_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines removed that are similar to an earlier one; n_chars follows the text."""
    return dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows of a document that is taken twice are equal."""
    return repeat_by_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_line),
    ("n-gram Jaccard join", dedup_near),
    ("source mix", mix_sources),
    ("subword encoding", encode),
]

#: The classifier, the fuzzy lines and the subword encoding cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
