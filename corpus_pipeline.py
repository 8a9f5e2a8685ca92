"""From raw documents to packed token sequences: five stages, each on all that the one before kept.

language ID (rejects texts of no language) -> SimHash near-dedup (one document of each group
stays) -> benchmark decontamination -> PII masking -> best-fit packing.

Stages judge rows by what they hold, not by their id: rows with null or repeated ids are
judged one by one. Input columns may have any names; those beyond the columns of documents
stay until packing. Null text counts as empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import content_key, cut, fresh, mark, read, tidy
from veristrata.llm.decontaminate import leaks
from veristrata.llm.langid import identify
from veristrata.llm.near_copies import keep_one
from veristrata.llm.packing import pack
from veristrata.llm.pii import mask


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those that language identification rejects go, so null, empty and letterless texts.

    Rows of equal text, declared language and source are judged alike; repeated rows stay.
    """
    key, other = fresh(docs, "key", "kept")
    keyed = docs.withColumn(key, content_key(F.col("text"), F.col("lang"), F.col("source")))
    kept = identify(keyed, id_col=key).where("keep").select(F.col(key).alias(other)).distinct()
    return keyed.join(kept, F.col(key) == F.col(other), "left_semi").drop(key)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact or near copies, the document with the smallest id; a null id comes last. Texts without words are one group."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows of equal text are judged alike; texts without words hold none."""
    key, other = fresh(docs, "key", "leak")
    keyed = docs.withColumn(key, content_key(F.col("text")))
    found = leaks(keyed, read(spark, sf_dir, "benchmark"), id_col=key).select(F.col(key).alias(other)).distinct()
    return keyed.join(found, F.col(key) == F.col(other), "left_anti").drop(key)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text. Null text stays null."""
    return mask(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048; a null or empty text is its closing token."""
    return pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: The stages use trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages, in order, to ``documents``; each result is written and read again, and what its stage wrote meanwhile is removed."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        since = mark()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            tidy(spark, since, keep=(docs,))
    return docs
