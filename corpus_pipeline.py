"""A corpus pipeline: toxicity, near copies, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents. Stages work on all rows their predecessor kept.
Empty documents, labels or benchmark tables are no fault: a stage then passes on
what it gets. Texts of any length are read whole, one row or a few megabytes at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.common import materialise, table
from seqspark.llm.decontaminate import clean
from seqspark.llm.pii import pseudonymise
from seqspark.llm.queries import PII_KEY, piece_model
from seqspark.llm.sentencepiece import encode_decode
from seqspark.llm.simhash import keep_one
from seqspark.llm.toxicity import accepted, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, doesn't reject.
    Null texts are scored as empty; repeated rows and null ids stay or go by their text."""
    model = fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return accepted(docs, model)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (of equal
    ids, the text of least hash, once). Rows with a null id stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text (null stays null)."""
    out = pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and their round trip; a null text counts as empty."""
    return encode_decode(docs, piece_model(), ids=True, text=False)


STAGES = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: The classifier, the fingerprints and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
