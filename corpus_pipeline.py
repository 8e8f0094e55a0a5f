"""From raw documents to packed training sequences, in five stages.

Every stage gets what its predecessor kept; all but the last return the columns of documents, whatever others
are there. Null and empty texts pass all filters and are packed as their end token alone; texts of any length count
whole. Rows without a doc_id are scored and packed, and no stage takes them for copies. Of rows that repeat a
doc_id one stays in the n-gram Jaccard join. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import lines, ngram_jaccard, packing, quality, toxicity
from lodestrata.llm.common import keep, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without labels none does."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; without labels none does."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and near copies of earlier lines go.

    A document of which nothing is left goes with them: all that it said stands in earlier documents. Texts
    that were null, empty or blank before lose no line and stay.
    """
    return lines.dedup(docs, drop_emptied=True)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; empty texts link with nothing."""
    return ngram_jaccard.dedup(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its place in a sequence of at most 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("best-fit packing", best_fit_packing),
]
#: Trained classifiers and token ids have no SQL form; tests compare small runs with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each table written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, "stage")
    return docs
