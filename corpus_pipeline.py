"""Corpus pipeline: the documents of a training set, stage by stage.

Every stage works on all that the one before kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import langid, mixing, neardup, packing, secrets
from corpusloom.llm.queries import TOKENIZER
from corpusloom.llm._session import materialize

#: Least Jaccard similarity of near copies, in percent; op5's query has a figure of its own.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no mixture of the known languages explains go.

    Null texts, texts without a letter and noise go; null and repeated ids, ties
    and columns of any name stay as they are; an empty table gives no rows.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays.

    The smallest doc_id of a group stays, one row of it. Null and empty texts and
    null ids all stay, columns of any name keep their values; an empty table gives no rows.
    """
    return neardup.drop_near_duplicates(docs, NEAR_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays.

    Null and empty texts, repeated rows and columns of any name stay as they are; an
    empty table gives no rows.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them, repeats as rows of their own.

    Null and wordless texts have no words to be taken and go; a null source counts as
    the last one; every row goes by its own decision, also where ids repeat or are
    null; columns of any name keep their values; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences.

    Null and empty texts are one-id documents, repeated rows and null ids documents of
    their own; other columns are left; an empty table gives no rows.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses neither the language model, the token ids nor the rounds of packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result materialised for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
