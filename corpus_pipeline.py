"""From raw documents to packed training sequences: five stages, each by one of the operators of inkplan.llm.

Every stage takes all that the one before kept and returns the columns of documents, but the last, which returns the places of the
packed pieces. run() writes each stage's rows as Parquet to the shared folder and reads them again for the next.

Defined cases, for every stage: an empty table gives an empty one; other columns pass unchanged, whatever their names; rows without a doc_id, or with
the doc_id of another row, are documents of their own; a text of any length is taken whole. What nulls, empty texts, ties and repeated rows come to is
said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplan.llm import neardup, packing, pseudonyms, quality, suffixes
from inkplan.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules don't reject. The fixed limits of the op5 query (fewest words and so on) don't apply here:
    short clean documents stay. Null and empty texts have no words and stay unless a rule rejects short documents; repeated rows share their fate; labels that contradict one another
    aren't learned from, and without labels of both kinds all documents stay."""
    return quality.accepted(docs, quality.learn(docs, documents(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group at similarity 0.8 over five-word shingles. Documents without words are linked with nothing and stay;
    a row without a doc_id stays only where no row of its group has one; of rows with the least doc_id the one with the least text_key() stays, and of
    repeated rows one."""
    return neardup.one_of_each(spark, docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier: in a lesser doc_id (none comes first), or of one doc_id in the lesser text_key(), or
    earlier in the text. Null texts stay null and short ones whole; of repeated rows the first keeps its text; a text that loses all stays, empty."""
    return suffixes.rewritten(spark, docs)


def key(spark: SparkSession) -> str:
    """The session's key for pseudonyms; for the synthetic tables, where none is set, one for tests that protects nothing."""
    return spark.conf.get(pseudonyms.SETTING, None) or "a test key"


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal numbers, dates, addresses and keys. Null and empty texts stay; equal values have equal pseudonyms in all rows,
    repeated ones included; overlapping finds go to the first."""
    out = pseudonyms.pseudonymise(docs, key=key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence. A null or empty text is one piece, its end; repeated rows are packed once each; which of equal lengths goes to
    which sequence is open."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("pseudonyms", personal_data),
    ("packing", packed),
]

#: Learned rules, transitive near-duplicates, suffixes and packing have no SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
