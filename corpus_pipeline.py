"""Corpus pipeline over documents: language, near-duplicates, benchmark passages, personal data, tokens.

Every stage takes the session, the rows that its predecessor kept, and the folder of the tables; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import bpe, decontam, langid, orderminhash, pii
from cladeframe.llm.common import stash, unstash
from cladeframe.llm.queries import BYTE_BPE, PIECES, table


def _sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts among them, or whose language is in doubt, go. Repeated rows
    go or stay together; other columns are not read, whatever they hold; no rows give none."""
    return langid.keep_identified(docs, PIECES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least id (null last), then of the least
    MD5 of its text; of rows equal in both any one. Null texts count as empty; no rows give none."""
    return orderminhash.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single passages of benchmark are cut from the others. Null texts stay null,
    repeated rows are treated alike, items without text match nothing; no rows give none."""
    return _sized(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in angle brackets. All rows stay, null texts null; no rows give none."""
    return _sized(pii.mask_pii(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them, of every
    row; a null text is empty, null and repeated ids pass through; no rows give none."""
    return bpe.decode_ids(bpe.encode_docs(docs, BYTE_BPE), BYTE_BPE)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: SQL cannot express language scores, sketches or byte-pair merges; tests/llm holds brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the rows that the one before has written; rows that the next
    stage has taken over are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, f"stage-{name}")
            if before is not None:
                unstash(before)
            before = docs
    return docs
