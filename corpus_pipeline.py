"""Corpus preparation: toxicity, quality rules, near duplicates, repeated passages, packing.

Every stage works on all that its predecessor kept, is written as Parquet in the shared folder and
read again. Counted as part of the ``llm`` subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepkit.llm.names import named
from seepkit.llm.near import one_of_each
from seepkit.llm.packing import pack
from seepkit.llm.quality import good_documents
from seepkit.llm.staging import materialize
from seepkit.llm.substrings import without_duplicates
from seepkit.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic (operator 2).

    Null and empty texts get what the chain says without words, which is not toxic unless most labelled
    documents are; rows that repeat go or stay together; an empty table stays empty; extra columns stay.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules keep (operator 7).

    Null, empty and short texts go; rows that repeat go or stay together; an empty table stays empty;
    extra columns stay.
    """
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id (operator 3).

    Rows that repeat an id and a text are one; null ids, null and empty texts stay; an empty table stays
    empty; extra columns stay.
    """
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that repeat (operator 10).

    Null and empty texts stay as they are, rows that repeat lose all words if they have a window's length;
    an empty table stays empty; extra columns stay, but ``n_chars`` is counted anew.
    """
    cut = without_duplicates(docs)
    return cut.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else named(c) for c, t in cut.dtypes))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens (operator 5).

    Null and empty texts are an end id alone; rows that repeat are packed each; a null doc_id stays null;
    an empty table gives no pieces; extra columns are left out.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: A trained classifier and tokenizers are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
