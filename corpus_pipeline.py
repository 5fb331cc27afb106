"""A corpus pipeline: quality rules, near-dedup, decontamination, PII, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents, and any others that docs has. Each stage takes empty tables, and says what it does with nulls,
repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common, decontamination, near_dedup, pii, quality, sentence_pieces


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or the trees, which learn from the labels of docs.

    Null and short texts fail the base rule. Repeated rows have one fate. A score at the threshold is kept.
    """
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8.

    Texts without words (or null) link with nothing and stay, as do rows without doc_id. Equal rows leave one.
    """
    return near_dedup.keep_one(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs: for training data one item is one too many.

    (The query op6 calls a document contaminated at two.) Null and empty texts stay; repeated rows have one fate.
    """
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data and secrets; every row stays, and null texts stay null."""
    return pii.surrogates(docs, pii.key_of(spark), None)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of every row; null and empty texts have no pieces."""
    import public_tokenizers

    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", without_benchmark), ("PII", without_pii), ("SentencePiece", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = common.materialize(out, "stage")
            common.discard(docs)
        docs = out
    return docs
