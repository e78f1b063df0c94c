"""A corpus made ready for training: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import langid, mixing, packing, simhash, suffix_dedup
from skirmish.llm.common import DOCUMENT_COLUMNS, materialize, table
from skirmish.llm.tokens import tokenizer_path


#: Bytes of a repeated passage: what 50 words have at least, but for very short ones.
PASSAGE = 256


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' languages and drops those whose text has none: null, or without a letter."""
    model = langid.train(docs)
    found = langid.predict(spark, docs, model, keep=docs.columns)
    return found.where(F.col(found.columns[len(docs.columns)]) != langid.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose texts share four fifths of their five-word shingles."""
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte of passages of ``PASSAGE`` bytes that start anywhere else too.

    Of passages of over 50 words that documents share, a third are shorter than the
    400 bytes at which the operator's own query is fixed, and one in thirty than this.
    """
    return suffix_dedup.remove_repeats(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as pieces of documents."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express hashing n-grams, suffix arrays or tokenizers: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
