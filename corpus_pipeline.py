"""From raw documents to packed training sequences, in five stages of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Its result is
written as Parquet and read again as the next one's docs; all but the last return the columns of documents.

Null and empty texts go as far as mixing, which takes words and so none of them; toxicity scores them from its
intercept. Very long texts are worked on whole. Rows with null or repeated ids are documents of their own,
repeated texts are one class of near_duplicates. Columns beside those of documents are carried along to mixing,
whatever their names. An empty table passes all stages and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import new_path, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 10)."""
    from tidemark.llm.toxicity import score, train

    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.filter("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class stays, that with the smallest id (operator 5)."""
    from tidemark.llm.jaccard import one_of_each

    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates (operator 9)."""
    from tidemark.llm.pii import replace

    return replace(docs, "key of the registered pipeline")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken at their target weights; a document as often and as far as its blocks are scheduled (operator 1)."""
    from tidemark.llm.mixing import mixed_documents

    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence, with its ids (operator 2)."""
    from tidemark.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: The stages have no form in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
