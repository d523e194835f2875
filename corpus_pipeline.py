"""A training-corpus pipeline over ``documents``: each stage is written and read again by the next.

Rules, classifier, near-duplicate removal and decontamination drop documents and keep the
columns of ``documents``; the last stage turns what is left into SentencePiece ids.

Defined cases: an empty table gives no rows; columns beyond those of ``documents`` are left
behind by the first stage, whatever their names; null, empty and very short texts fail the
base rules; very long texts are taken whole by every stage; of rows equal in doc_id and text
one stays; rows of one doc_id with different texts are judged each on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.decontaminate import decontaminated
from corvane.llm.piece_codec import Vocabulary, encoded
from corvane.llm.quality_gam import classify
from corvane.llm.quality_rules import quality_rules
from corvane.llm.queries import PIECE_MODEL
from corvane.llm.simhash_dedup import without_similar
from corvane.session import load, written

COLUMNS = ("text", "lang", "source", "n_chars")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are likely enough under the trusted rows."""
    trusted = load(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(docs, trusted, carry=COLUMNS).where("kept").select("doc_id", *COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model takes for good."""
    return classify(docs, load(spark, sf_dir, "labels"), carry=COLUMNS).where("predicted = 1").select("doc_id", *COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingle sets at a Jaccard similarity of 0.8 or more.

    The first by doc_id stays; rows are told apart by doc_id and text.
    """
    return without_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that is left, under seeded merge-dropout."""
    return encoded(docs, Vocabulary.load(PIECE_MODEL), carry=("lang", "source"))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("piece_encoding", encoding_stage),
]

#: Hash buckets, a fitted model and a merge agenda aren't SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
