"""Language identification, toxicity, near copies, secrets and packing over the documents table.

Each stage works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import copies, langid, packing, secrets, toxicity
from tidemark.llm.common import held_out, read, rows_where
from tidemark.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language by a clear margin, their ``lang`` set to the language found."""
    learn = docs.where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.dictionaries(learn), whole=True)
    columns = [F.col("lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.where("accepted").select(*columns)


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; labels are learned from this stage's documents that are not held out."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return rows_where(toxicity.score(docs, model, whole=True), F.col("predicted") == 0, docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the document with the least id."""
    return copies.representatives(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask and ``n_chars`` set to the new length."""
    clean = secrets.redacted(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("toxicity", clean_speech),
    ("near_copies", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Compression, cosine votes and MinHash bands are not SQL: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
