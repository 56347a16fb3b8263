"""The corpus pipeline: documents through five of the training-data operators, each stage on all that the last one kept.

Stages take ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``; ``run`` writes each stage's
result to the shared folder as Parquet, hands it on from there, and drops the one before.

In every stage rows that repeat one another are treated alike, texts are read whole however long, and no rows give no
rows. Null and empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderlake.llm import bpe, decontaminate, language, simhash, suffixes
from cinderlake.llm.common import Stored
from cinderlake.llm.queries import table, tokenizer_path

#: Mean word marginal below which a text counts as in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the languages that the labelled rows of ``docs`` teach; all rows where none is labelled.

    A text without a letter, a null one too, is in none.
    """
    tagger = language.fit(docs)
    return docs if tagger is None else language.keep_identified(docs, tagger, LEAST_LANGUAGE_SCORE)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows without an id stay; rows that share an id are one document."""
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of documents with smaller ids; what loses all its text goes. Rows without an id stay whole."""
    return suffixes.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts have none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of the ids and of the decoded text; a null text has no ids."""
    return bpe.encode_digests(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: A trained model and a graph's components: SQL cannot express them. ``tests/llm`` has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs, was = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = Stored(stage(spark, docs, sf_dir), name)
        if was:
            was.drop()
        docs, was = now.df, now
    return docs
