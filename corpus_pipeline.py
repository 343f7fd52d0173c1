"""Corpus pipeline: quality classifier, exact dedup, MinHash near-dedup,
personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet to the shared checkpoint folder and reads again for the next
one. All stages but the last return the columns of documents; every document a
stage keeps goes on whole.

Cases: a document without id is judged and packed like any other; documents that
share an id are told apart by their text, of rows that share both the first by its
other columns stays; extra columns go along, whatever their names; empty texts are equal to each other, so
one of them stays; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.llm import block_naming, bottomk_dedup, nbsvm, pseudonyms, queries
from cinerank.llm.common import documents, spare_name
from cinerank.session import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score at least 0.5). It learns
    from the labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))
    model = nbsvm.train(docs, labels, usable)
    score = spare_name(docs, "_score")
    return nbsvm.score(docs, model, column=score).where(F.col(score) >= 0.5).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts, the one with the least id."""
    return block_naming.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard
    0.8 or more), the one with the least id."""
    return bottomk_dedup.keep_first(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data; n_chars follows the text."""
    done = pseudonyms.pseudonymise(docs, key=queries.pii_key(spark))
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return queries.packed_digests(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("personal_data", personal_data),
          ("packing", packing)]

# Models, tokenizers and keyed permutations are beyond SQL; tests/llm compares
# every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
