"""The corpus pipeline: documents in, encoded documents out.

Each stage takes the documents that its predecessor kept and returns rows with the columns of documents; the last returns the
digests of the encoding. The driver writes each stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needmap.llm import bpe, classifier, decontamination, line_chunks, near_duplicates
from needmap.llm.common import fresh, importable, table
from needmap.llm.queries import bpe_digests


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    importable(spark)
    score, held_out, predicted = fresh(docs, "quality_score", "quality_held_out", "quality_predicted")
    scored = classifier.with_scores(docs, table(spark, folder, "labels"), score=score, held_out=held_out, predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(*(f"`{c}`" for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the chunks of lines that an earlier place has; ``n_chars`` follows the text."""
    importable(spark)
    lighter = line_chunks.deduplicated(docs)
    return lighter.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else lighter


def copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.80 or more (query op2 takes 0.85)."""
    importable(spark)
    return near_duplicates.deduplicated(docs)


def leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    importable(spark)
    return decontamination.decontaminated(docs, table(spark, folder, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The encoding of each document, and what it decodes to, as digests."""
    importable(spark)
    return bpe_digests(bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("near duplicates", copies), ("decontamination", leaks), ("byte-pair encoding", tokens),
]
#: Stages rest on trained scores, minwise paths and merges, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, folder)
    return docs
