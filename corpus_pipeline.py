"""Four stages over the documents: toxic ones go, copies go, near copies go, and the rest is packed.

Every stage takes any documents frame with doc_id and text and, but for the last, returns all its columns, whatever their
names.  Defined cases, beside those of the operators: a null or empty text is never toxic, and null and empty texts are
copies of each other; a row without id takes part in every stage (it stays as a copy only where no copy has an id, and is
never dropped as a near copy, as nothing could name it); repeated rows are copies; without labels nothing is toxic; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bagminhash, exact_dedup, hilbert_packing, toxicity
from lodestar.llm._scratch import written
from lodestar.llm.queries import table, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is under one half; the scorer learns from the stage's own documents."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the document with the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id."""
    return bagminhash.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 ids."""
    return hilbert_packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: The first and third stage are learnt and hashed, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
