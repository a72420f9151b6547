"""Documents to packed training sequences, in four stages of the llm package.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads it from Parquet.  All
stages but the last return documents with their columns, so each works on all that its predecessor kept:

1. toxicity: documents scored 0.7 or more go;
2. n-gram Jaccard join: one document of each near-duplicate component stays;
3. mixing: documents are drawn for the production targets by source, language and topic;
4. packing: the documents as pieces in sequences of at most 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glazier.llm.mixing import sample_mix
from glazier.llm.ngram_join import drop_near_duplicates
from glazier.llm.packing import pack_documents
from glazier.llm.toxicity import drop_toxic
from glazier.plans.session import shared_path


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", sample_mix),
    ("packing", _pack),
]

# Hashing, learning and tokenizing stages: SQL cannot express them; tests check the operators
# (README says how far) and that the stages run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
